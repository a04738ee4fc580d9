"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, unfold, whole_rows, words

#: Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "be", "this"],
    "de": ["der", "die", "und", "das", "von", "nicht", "ist", "mit", "ein", "zu", "im", "den"],
    "fr": ["le", "la", "les", "de", "et", "des", "est", "que", "un", "une", "dans", "pour"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "una", "por", "con", "para", "del"],
}
#: name, counted part, out of, least percent, most percent (None: no bound). A text is kept if every ratio is
#: inside its bounds.
THRESHOLDS = [
    ("mean_word_chars", "word_chars", "n_words", 200, 1200),
    ("symbols_per_word", "n_symbols", "n_words", None, 10),
    ("stop_words", "n_stop_words", "n_words", 2, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 30),
    ("shouted_words", "n_shouts", "n_words", None, 10),
    ("lettered_words", "n_lettered", "n_words", 60, None),
]
LEAST_WORDS, MOST_REPEATED = 50, 50


def _count(parts: Column, pattern: str) -> Column:
    return F.size(F.filter(parts, lambda x: x.rlike(pattern))).cast("bigint")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame's rows as a struct ``row`` with one long column per measure."""
    base = df.select(whole_rows(df).alias("row"), text_or_empty(text).alias("t"))
    base = base.select("row", "t", words(F.col("t")).alias("w"), F.filter(
        F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    # every 3-word window with its place; words hold no space, so joined windows are equal only if their words are
    many = F.greatest(F.size("w") - 2, F.lit(0))
    joined = F.arrays_zip(*[F.slice("w", i, many).alias(c) for i, c in ((1, "a"), (2, "b"), (3, "c"))])
    windows = F.transform(joined, lambda x, i: F.struct(F.concat_ws(" ", x["a"], x["b"], x["c"]).alias("g"), i.alias("i")))
    stop = "|".join(sorted({x for some in STOP_WORDS.values() for x in some}))
    flat = base.select(
        "row", F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        _count(F.col("w"), f"^(?iu:{stop})\\P{{L}}*$").alias("n_stop_words"),
        _count(F.col("w"), r"^\P{L}*\p{Lu}{2,}\P{L}*$").alias("n_shouts"),
        _count(F.col("w"), r"\p{L}").alias("n_lettered"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array(windows).alias("s"))
    # equal windows are neighbours now; the places that they cover are counted once
    again = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["g"] == x["g"], F.lit(False))
                     | F.coalesce(F.get("s", i + 1)["g"] == x["g"], F.lit(False)))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return flat.select(*[c for c in flat.columns if c != "s"],
                       F.size(F.array_distinct(covered)).cast("bigint").alias("n_repeat_words"))


def compiled(thresholds=THRESHOLDS) -> Column:
    """The thresholds as one boolean expression over whole numbers; a ratio out of nothing passes."""
    tests = [F.lit(True)]
    for _, part, whole, least, most in thresholds:
        if least is not None:
            tests.append(100 * F.col(part) >= least * F.col(whole))
        if most is not None:
            tests.append(100 * F.col(part) <= most * F.col(whole))
    return reduce(lambda x, y: x & y, tests)


def judge(df: DataFrame, text: str = "text", thresholds=THRESHOLDS, least_words: int = LEAST_WORDS,
          most_repeated: int = MOST_REPEATED) -> DataFrame:
    """Add the measures, ``base_failed`` (too short, or too many words in repeated windows) and ``kept``.

    A null text counts as empty: all measures are 0, it fails on its length. Texts are taken whole; the work
    grows with n log n of a text's words. Every row is judged alone, so nothing is shuffled, and repeated rows
    get the same verdict. Input columns with the name of a result give way.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_shouts",
             "n_lettered", "n_lines"]
    return unfold(measures(df, text), "row", df.columns,
                  [*[F.col(n) for n in names], failed, ~failed & compiled(thresholds)], [*names, "base_failed", "kept"])
