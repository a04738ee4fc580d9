"""Document quality by Bradley-Terry ranking: scores learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import name, saved, text_or_empty, unfold, whole_rows
from .quality_rules import STOP_WORDS

#: Bounds of the learning: labelled rows of each kind, preference pairs for each rejected row, and the ridge.
SAMPLE_PER_LABEL, PAIRS_PER_ROW, RIDGE, STEPS = 5000, 8, 1e-3, 40
#: A document is predicted good from this score on.
CUT = 0.3

NAMES = ["length", "word_chars", "upper", "digits", "symbols", "marks", "bars", "no_letters", "wide", "different_words", "top_word",
         "next_equal", "repeat_pairs", "repeat_lines", "stop_words", "line_words", "long_word", "shouts"]


def features(text: Column) -> Column:
    """Shape features of each whole text as an array of doubles, in Arrow batches. Nothing but the text is looked at."""
    stop = {w.encode() for some in STOP_WORDS.values() for w in some}

    @pandas_udf("array<double>")
    def of(texts):
        import numpy as np
        import pandas as pd
        classes = np.zeros((6, 256))
        for row, chars in enumerate([bytes(range(65, 91)), b"0123456789", b"#*$%&<>@\\^_~{}=+", b"!?", b"|", bytes(range(128, 256))]):
            classes[row, list(chars)] = 1
        out = []
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass")
            parts = raw.split()
            n = len(parts)
            if not n:
                out.append(np.zeros(len(NAMES)))
                continue
            size = max(1, sum(map(len, parts)))
            upper, digits, symbols, marks, bars, wide = classes @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            seen: dict = {}
            for w in parts:
                seen[w] = seen.get(w, 0) + 1
            pairs = set(zip(parts, parts[1:]))
            lines = [x for x in raw.split(b"\n") if x.strip()]
            plain = sum(c for w, c in seen.items() if w.lower().rstrip(b".,;:!?") in stop)
            shouts = sum(c for w, c in seen.items() if len(w) > 2 and w.isupper())
            bare = sum(c for w, c in seen.items() if not (w[:1].isalpha() or w[:1] >= b"\x80"))
            out.append(np.array([
                math.log1p(n) / 10, size / n / 10, upper / size, digits / size, symbols / n, marks / n, bars / n, bare / n, wide / size,
                math.log(len(seen)) / math.log(n + 1), max(seen.values()) / n, sum(a == b for a, b in zip(parts, parts[1:])) / n,
                1 - len(pairs) / max(1, n - 1) if n > 1 else 0, 1 - len(set(lines)) / len(lines), plain / n,
                math.log1p(n / len(lines)) / 10, math.log(max(map(len, seen))) / 10, shouts / n]))
        return pd.Series(out)
    return of(text)


@dataclass
class Ranking:
    """A learned score: weights of standardised features, and the raw score where documents are cut."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    cut: float

    def raw(self, column: Column) -> Column:
        """The Bradley-Terry strength of a feature array, as one sum of products; features count up to 8 deviations."""
        terms = [F.lit(w / s) * F.greatest(F.lit(-8.0 * s), F.least(F.lit(8.0 * s), column[i] - F.lit(m)))
                 for i, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights))]
        return sum(terms[1:], terms[0])

    def score(self, column: Column) -> Column:
        """Between 0 and 1, `CUT` where documents are cut."""
        return 1 / (1 + F.exp(-(self.raw(column) - F.lit(self.cut) + F.lit(math.log(CUT / (1 - CUT))))))


def pair_weights(good, bad, pairs: int = PAIRS_PER_ROW, ridge: float = RIDGE):
    """Weights that rank ``good`` rows over ``bad`` ones: logistic loss on the feature differences of pairs.

    Every row of the rarer kind meets ``pairs`` rows of the other. Newton steps on the pairs; no intercept, since only
    differences count.
    """
    import numpy as np
    rng = np.random.default_rng(7)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    other = many[rng.integers(0, len(many), (len(few), pairs))]
    d = (other - few[:, None, :]).reshape(-1, good.shape[1])
    d = d if few is bad else -d
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d * p[:, None]).mean(axis=0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL) -> Ranking:
    """A ranking from featured rows (``id``, ``f``) and labels (``id``, ``label`` 1 or 0).

    Up to ``sample`` labelled rows of each kind, those with the smallest hash of their id, give the preference pairs. The
    cut is a quantile of the scores of all labelled rows: the share of 0 among them, taken in the gap just around it. Labels of one
    id that disagree or are null are left out. Without rows of both kinds there is no preference: all scores are equal and pass.
    """
    import numpy as np
    clear = labels.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    known = saved(rows.join(clear.select(F.col("id").alias("i"), "label"), F.col("id") == F.col("i")).select("id", "f", "label"), "bt-labelled")
    some = [np.array([r["f"] for r in known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id", F.hash("f")).select("f").limit(sample).collect()])
            for k in (1, 0)]
    width = len(NAMES)
    if not (len(some[0]) and len(some[1])):
        return Ranking([0.0] * width, [1.0] * width, [0.0] * width, 0.0)
    every = np.concatenate(some)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    good, bad = (np.clip((x - mean) / scale, -8, 8) for x in some)
    weights = pair_weights(good, bad)
    made = Ranking(mean.tolist(), scale.tolist(), weights.tolist(), 0.0)
    scored = known.select(made.raw(F.col("f")).alias("raw"), "label")
    share = scored.agg(F.avg(F.when(F.col("label") == 0, 1.0).otherwise(0.0))).head()[0]
    near = F.array(*[F.lit(min(1.0, max(0.0, share + d))) for d in (-0.002, 0.002)])
    below, above = scored.agg(F.percentile_approx("raw", near, 1_000_000)).head()[0]
    made.cut = (below + above) / 2
    return made


def training_part(key: Column) -> Column:
    """Whether a row may be learned from: the others (a fifth, by CRC-32 of the key as text) are held out."""
    return F.crc32(key.cast("string").cast("binary")) % 5 != 0


def score_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                    sample: int = SAMPLE_PER_LABEL) -> DataFrame:
    """One row per document: ``key held_out score predicted``.

    Features of all texts are written once (18 numbers a document); learning, cutting and scoring read only them. A null
    text counts as empty and gets a score like any other; a row without key is not held out, and never learned from. Repeated rows
    are scored alike. An empty table gives an empty table.
    """
    rows = saved(df.select(name(key).alias("id"), features(text_or_empty(text)).alias("f")), "bt-features")
    ranking = learn(rows, _training_labels(labels, key, label), sample)
    score = ranking.score(F.col("f"))
    return rows.select(F.col("id").alias(key), F.coalesce(~training_part(F.col("id")), F.lit(False)).alias("held_out"), score.alias("score"),
                       F.when(score >= CUT, 1).otherwise(0).alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
              sample: int = SAMPLE_PER_LABEL) -> DataFrame:
    """The rows predicted good, with the columns of the frame. Labels are joined to features, not to texts."""
    rows = saved(df.select(whole_rows(df).alias("row"), name(key).alias("id"), features(text_or_empty(text)).alias("f")), "bt-rows")
    ranking = learn(rows.select("id", "f"), _training_labels(labels, key, label), sample)
    return unfold(rows.where(ranking.score(F.col("f")) >= CUT), "row", df.columns, [], [])


def _training_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    return labels.where(training_part(name(key))).select(name(key).alias("id"), name(label).alias("label"))
