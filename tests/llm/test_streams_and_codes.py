"""Streamed BPE, the filter audit and vector codes against plain versions, and on rows with every odd case."""

import hashlib
import math
import random
from collections import Counter
from itertools import permutations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabwright.llm import bpe_stream, filter_audit, queries, vector_codes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(bpe_stream.VOCABULARY))


# ---- BPE

def hashes(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_query_equals_the_library(spark, library):
    rows = queries.op11_bpe(spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}
    assert len(rows) == len(texts)
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == hashes(library, texts[r["doc_id"]]) for r in rows)


BITS = ["a", "b", " ", "'", "'s", "'re", "'ll", "<|endoftext|>", "<|start", "<", "|", "é", "é", "́", "Σ", "İ", "각", "\xa0", "\x1c",
        "\n", "1", "²", "½", "😀", "한", "中", "!!", "<|startoftext|>", "ΑΣ", "ß", "A", "ͅ", "ᲊ", "𐵐"]


@pytest.mark.parametrize("block,hold", [(7, 30), (100, None), (1 << 16, None)])
def test_bpe_in_blocks_equals_the_library(library, block, hold):
    rng = random.Random(block)
    encoder = bpe_stream.Encoder(block=block, hold=hold)
    words = [w for t in encoder.of.strings if (w := t.removesuffix("</w>")).isascii() and w.isalpha()]
    texts = ["".join(rng.choices(BITS, k=rng.randrange(60))) for _ in range(300)]
    texts += ["".join(rng.choices(rng.choice([words, ["a", "ha"], ["sun", "day", "mon", "motivation"], ["!", "!!", "'"]]), k=900)) for _ in range(15)]
    for t in texts:
        parts = list(encoder.ids(t))
        assert [i for p in parts for i in p] == library.encode(t, add_special_tokens=False).ids
        back = bpe_stream.Decoder(encoder.of)
        assert "".join(back.push(p) for p in parts) + back.end() == library.decode([i for p in parts for i in p], skip_special_tokens=False)


def test_bpe_keeps_little_of_a_long_piece(library):
    run, kept = bpe_stream.Transducer(bpe_stream.encoder().of), 0
    text, out = "abandonmotivation" * 20_000, []
    for at in range(0, len(text), 5000):
        out += run.push(bpe_stream.encoder().symbols(text[at:at + 5000]))
        kept = max(kept, len(run.kept))
    assert out + run.end() == library.encode(text, add_special_tokens=False).ids
    assert kept <= 2 * run.hold + run.of.lookahead


def test_sufficient_lookahead_of_small_lists():
    assert bpe_stream.sufficient_lookahead([("a", "b")], len) == 1
    # c d, then b cd, then a bcd: a change behind d reaches a
    assert bpe_stream.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")], len) == 3
    with pytest.raises(ValueError):
        bpe_stream.sufficient_lookahead([("ab", "c"), ("a", "b")], len)


def test_lookahead_holds_for_random_lists():
    rng = random.Random(5)
    for _ in range(60):
        tokens, merges = list("abc"), []
        while len(merges) < 12:
            pair = (rng.choice(tokens), rng.choice(tokens))
            if len(pair[0] + pair[1]) <= 6 and pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        need = bpe_stream.sufficient_lookahead(merges, len)
        for _ in range(60):
            known = "".join(rng.choices("abc", k=30))
            ends = [plain_ends(known + "".join(rng.choices("abc", k=12)), merges) for _ in range(6)]
            assert len({tuple(e for e in some if e <= 30 - need) for some in ends}) == 1


def plain_ends(text, merges):
    tokens = list(text)
    for a, b in merges:
        made, i = [], 0
        while i < len(tokens):
            if tokens[i:i + 2] == [a, b]:
                made.append(a + b)
                i += 2
            else:
                made.append(tokens[i])
                i += 1
        tokens = made
    ends, at = [], 0
    for t in tokens:
        at += len(t)
        ends.append(at)
    return ends


def test_bpe_on_odd_rows(spark, library):
    odd = [(1, None, "x"), (2, "", "x"), (None, " \t\n", None), (3, "Déjà vu's 12!", "x"), (3, "Déjà vu's 12!", "x"), (4, "x" * 200_000, "x"), (5, "word " * 40_000, "x")]
    df = spark.createDataFrame(odd, "doc_id int, text string, `ids` string")
    assert Counter(tuple(r) for r in bpe_stream.round_trip(df).collect()) == Counter((k, *hashes(library, t)) for k, t, _ in odd)
    coded = bpe_stream.encode(df)
    assert sorted(coded.columns) == ["doc_id", "ids", "text"]
    again = {r["doc_id"]: r["decoded"] for r in bpe_stream.decode(coded).collect()}
    assert again[3] == "déjà vu 's 1 2 ! " and again[1] == again[2] == "" and again[4].rstrip() == "x" * 200_000
    empty = spark.createDataFrame([], df.schema)
    assert bpe_stream.round_trip(empty).count() == bpe_stream.encode(empty).count() == 0
    loose = spark.createDataFrame([(None,), ([],), ([64, None, -1, 10 ** 6],), ([128],)], "ids array<int>")
    assert [r["decoded"] for r in bpe_stream.decode(loose).collect()] == [None, "", "a", "�"]


# ---- filter audit

def plain_audit(docs, labels):
    good, toxic = ({x["doc_id"] for x in labels if x[c] == 1 and x["doc_id"] is not None} for c in ("quality", "toxic"))
    least = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            least[t] = min(least.get(t, d["doc_id"]), d["doc_id"])
    parts = {}
    for d in docs:
        t = d["text"] or ""
        w = t.encode().split()
        fails = {f for f, hit in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t),
            d["doc_id"] is not None and d["doc_id"] > least[t])) if hit}
        parts.setdefault(d["source"] or "", []).append((fails, d["doc_id"] in good, d["doc_id"] in toxic))
    rows = set()
    for part, held in parts.items():
        removals = {}
        for order in map("".join, permutations("ABCDE")):
            left = held
            for step, f in enumerate(order, 1):
                lost, kept = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                removals[order, step] = (len(kept), len(lost), sum(f in x[0] for x in held) - len(lost), sum(x[0] == {f} for x in held),
                                         sum(x[1] for x in lost), sum(x[2] for x in lost))
                left = kept
        total = Counter()
        for (order, step), r in removals.items():
            total[order[step - 1]] += r[1]
        rows |= {(part, o, s, *r, total[o[s - 1]]) for (o, s), r in removals.items()}
    return rows


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_rows(spark):
    many = "abc def " * 150
    docs = [(1, None, None, 1), (2, "", "", 1), (3, many, "a", 1), (2, "", "a", 1), (None, many, "a", 1), (None, many, "b", 1), (4, many, "b", 1), (4, many, "b", 1),
            (5, " ".join(f"w{i}" for i in range(30_000)), "b", 1), (6, "SHOUT # " * 300, "b", 1), (7, " ".join(f"w{i}" for i in range(250)), "c", 1)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string, n int").repartition(3)
    tags = spark.createDataFrame(labels, "doc_id int, quality int, toxic int")
    made = filter_audit.audit(filter_audit.masked(df, tags)).select(COLUMNS).collect()
    expected = plain_audit([dict(zip(("doc_id", "text", "source"), d)) for d in docs], [dict(zip(("doc_id", "quality", "toxic"), x)) for x in labels])
    assert len(made) == 4 * 600 and set(map(tuple, made)) == expected
    assert filter_audit.audit(filter_audit.masked(df.limit(0), tags)).count() == 0
    assert set(map(tuple, filter_audit.audit(filter_audit.masked(df, tags.limit(0))).select("good_lost", "toxic_lost").distinct().collect())) == {(0, 0)}


def test_audit_of_two_filters(spark):
    cells = spark.createDataFrame([("p", 3, 2, 1, 0), ("p", 1, 4, 0, 0), ("p", 0, 7, 0, 0)], "part string, mask int, n int, good int, toxic int")
    made = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in filter_audit.audit(cells, "XY").collect()}
    assert made == {("XY", 1): (7, 6, 0, 10), ("XY", 2): (7, 0, 2, 2), ("YX", 1): (11, 2, 0, 2), ("YX", 2): (7, 4, 2, 10)}
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "XX")


# ---- vector codes

def plain_codes(rows, parts=16, entries=64, rounds=2):
    whole = [(k, label, v) for k, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    if not whole:
        return set()
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[2]), r[2]))
    width = len(whole[0][2])
    cut = [(k, label, [[math.floor(256 * x) for x in v[p:p + width // parts]] for p in range(0, width, width // parts)])
           for k, label, v in whole if len(v) == width]
    books = [[list(r[2][p]) for r in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        found = [[near(p, r[2][p])[1] for p in range(parts)] for r in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                if mine := [r[2][p] for r, f in zip(cut, found) if f[p] == e]:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[near(p, r[2][p]) for p in range(parts)] for r in cut]
    errors = [sum(d for d, _ in f) for f in last]
    by_label = Counter()
    for r, e in zip(cut, errors):
        by_label[r[1]] += e if e < 1 << 63 else 0
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    small = lambda e: e if e < 1 << 63 else None                              # noqa: E731
    return Counter((r[0], "".join(f"{e:02x}" for _, e in f), small(err), small(by_label[r[1]]), digest) for r, f, err in zip(cut, last, errors))


SCHEMA = "vec_id bigint, label int, embedding array<float>"


def test_codes_equal_the_plain_ones(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()]
    made = queries.op13_vector_codes(spark, FOLDER).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert Counter(map(tuple, made)) == plain_codes(rows)


def test_codes_of_odd_vectors(spark, monkeypatch):
    rng = random.Random(3)
    v = lambda spread=1.0, n=32: [rng.choice([-1, 0, 0.25, rng.uniform(-spread, spread)]) for _ in range(n)]
    same = v()
    rows = [(i % 300 if i % 7 else None, rng.choice([None, 1, 2]), same if i % 3 == 0 else v()) for i in range(700)]
    rows += [(1, 1, None), (2, 1, [None] * 32), (3, 1, [float("nan")] * 32), (4, 1, [float("inf")] + [0.0] * 31), (5, 1, []), (6, 1, [1.0] * 31), (7, None, [1.0] * 48)]
    rows = [(k, label, x and [None if c is None else float(F_(c)) for c in x]) for k, label, x in rows]
    made = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).repartition(3)).collect()
    assert Counter(map(tuple, made)) == plain_codes(rows)


def F_(x):
    import numpy as np
    return np.float32(x)


def test_codes_of_large_few_and_no_vectors(spark):
    rows = [(i, None, [float(F_((-1) ** i * i * 10.0 ** (3 * (i % 5)))) for _ in range(16)]) for i in range(40)]     # beyond 64 bits
    made = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=8).collect()
    assert Counter(map(tuple, made)) == plain_codes(rows, entries=8)
    few = [(i, 1, [i / 8.0] * 16) for i in range(3)]
    assert Counter(map(tuple, vector_codes.compress(spark.createDataFrame(few, SCHEMA)).collect())) == plain_codes(few)
    none = vector_codes.compress(spark.createDataFrame([(1, 1, None)], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(spark.createDataFrame([(1, 1, [3e38] * 16), (2, 1, [-3e38] * 16), (3, 1, [0.0] * 16)], SCHEMA), entries=1).count() == 3


def test_hilbert_neighbours_touch():
    import numpy as np
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)]).T
    keys = vector_codes.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[:, np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_shortlists_keep_every_nearest_entry():
    import numpy as np
    rng = np.random.default_rng(2)
    vectors = rng.integers(-50, 50, (20_000, 8))
    chunk = vector_codes.Chunk.of(vectors, 2)
    book = rng.integers(-50, 50, (20, 4))
    for part in range(2):
        listed = vector_codes.shortlists(chunk.low[part], chunk.high[part], book)
        entry, distance = vector_codes.nearest(chunk.values[part], listed, book)
        plain = ((vectors.reshape(20_000, 2, 4)[chunk.order[part], part][:, None] - book[None]) ** 2).sum(axis=2)
        assert (entry.ravel()[:20_000] == plain.argmin(axis=1)).all() and (distance.ravel()[:20_000] == plain.min(axis=1)).all()
    assert listed.mean() < 0.6
