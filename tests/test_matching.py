"""Scores, candidate pairs and assignment against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tabwright.functions.similarity import lcs_length, partial, ratio, score_pair, token_set, token_sort
from tabwright.operators.assign import assign
from tabwright.operators.candidates import similar_texts
from tabwright.operators.fuzzy import fuzzy_compare


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_scores():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randrange(9))) for _ in range(2))
        assert lcs_length(a, b) == slow_lcs(a, b)
        assert ratio(a, b) == ratio(b, a) and 0 <= ratio(a, b) <= 100 and ratio(a, a) == 100
    assert round(ratio("hilview", "hillview")) == 93
    assert token_sort("blue river", "river blue") == 100
    assert token_set("blue river steel", "steel blue") == 100
    assert token_set("blue a", "blue b") == pytest.approx(max(100 * (1 - 2 / 12), 100 * (1 - 2 / 10)))
    assert partial("steel", "blue steel river") == 100
    assert partial("stel", "blue steel") == 75      # windows are never longer than the shorter text
    assert score_pair("silver line", "silverline", "token_sort") == 100


WORDS = ["north", "star", "blue", "river", "steel", "apex", "cement", "line", "ab", "x"]


def typo(rng, text):
    i = rng.randrange(len(text))
    return rng.choice([text[:i] + text[i + 1:], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1:]]).strip() or "z"


@pytest.mark.parametrize("method,threshold", [("token_sort", 85), ("token_sort", 60), ("simple", 90), ("token_set", 85),
                                              ("token_set", 60), ("partial", 85), ("partial", 70)])
def test_candidates_lose_nothing(spark, method, threshold):
    rng = random.Random(threshold)
    left = sorted({" ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(40)})
    right = sorted({typo(rng, t) if rng.random() < 0.7 else t for t in left for _ in range(2)} | {"a", "stel"})
    expected = {(a, b): s for a in left for b in right if (s := score_pair(a, b, method)) >= threshold}
    made = [spark.createDataFrame([(i, "", t) for i, t in enumerate(x)], "id bigint, block string, text string")
            for x in (left, right)]
    got = {(left[r.id_a], right[r.id_b]): r.score for r in similar_texts(*made, threshold, method).collect()}
    assert got == expected


def test_word_sets_score_little_that_does_not_match(spark, monkeypatch):
    """Only pairs whose words stand in each other are scored, not all that share a few letter pairs."""
    from tabwright.operators import candidates
    left = [f"brand {b} {n} {k}" for b in range(20) for n in ("large ring", "small bolt", "blue plate") for k in ("economy", "promo")]
    right = [f"{n} brand {b}" for b in range(20) for n in ("large ring", "small bolt", "blue plate")]
    expected = sum(score_pair(a, b, "token_set") >= 95 for a in left for b in right)
    made = [spark.createDataFrame([(i, "", t) for i, t in enumerate(x)], "id bigint, block string, text string") for x in (left, right)]
    monkeypatch.setattr(candidates, "similarity", lambda *args: F.lit(100))      # every pair that would be scored
    assert expected == 120 <= similar_texts(*made, 95, "token_set").count() <= 240


def test_fuzzy_texts_are_worked_out_once(spark):
    a, b = [spark.createDataFrame([(0, "Blue River Co."), (1, "Apex")], f"_row bigint, {c} string") for c in ("x", "y")]
    made = fuzzy_compare(a, b, ["x"], ["y"])
    for members in (made.members_a, made.members_b):
        assert "regexp" not in members._jdf.queryExecution().toString().lower()


def greedy(edges, a, b):
    """Row pairs by (score descending, row of A, row of B)."""
    pairs = sorted((-s, i, j) for (u, v), s in edges.items() for i in a[u] for j in b[v])
    used_a, used_b, out = set(), set(), set()
    for s, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            out.add((i, j, -s))
    return out


@pytest.mark.parametrize("seed,finish", [(1, 0), (2, 0), (3, 0), (4, 20_000), (5, 20_000)])
def test_assignment_is_the_sequential_one(spark, seed, finish):
    rng = random.Random(seed)
    groups = 5
    rows = {side: {g: [] for g in range(groups)} for side in "ab"}
    for side in "ab":
        for row in range(24):
            rows[side][rng.randrange(groups)].append(row)
    edges = {(u, v): rng.choice([85, 90, 90, 95]) for u in range(groups) for v in range(groups) if rng.random() < 0.5}
    frame = spark.createDataFrame([(u, v, s) for (u, v), s in edges.items()], "u bigint, v bigint, score int")
    members = [spark.createDataFrame([(g, r) for g, x in rows[side].items() for r in x], f"{name} bigint, row bigint")
               for side, name in (("a", "u"), ("b", "v"))]
    got = {tuple(r) for r in assign(frame, *members, most_in_task=finish).collect()}
    assert got == greedy(edges, rows["a"], rows["b"])


def test_many_equal_rows_take_one_round(spark):
    """A text that fills the table on both sides pairs up first with first."""
    edges = spark.createDataFrame([(1, 1, 100)], "u bigint, v bigint, score int")
    a = spark.range(3000).select(F.lit(1).cast("bigint").alias("u"), (F.col("id") * 2).alias("row"))
    b = spark.range(2500).select(F.lit(1).cast("bigint").alias("v"), (F.col("id") * 3).alias("row"))
    got = assign(edges, a, b, most_in_task=0)
    assert got.count() == 2500 and got.where("row_a / 2 <> row_b / 3").count() == 0


NAMES_A = ["Amber Quartet Inc.", "Bass Brothers Ltd", "Copper Kettle Band", "Dulcimer House LLC", "Even Song Choristers",
           "Fife and Drum Players", "Gable Organ Society", "Harbour Wind Ensemble"]
TOWNS_A = ["Linden", "Marsh", "Old Port", "Linden", "Marsh", "Old Port", "Linden", "Old Prt"]
FEES_A = [640.0, 1380.25, 720.0, 415.0, 2060.0, 98.0, -155.0, 3300.0]
ROWS_B = [("AMBER QUARTET COMPANY", "Linden", 640.0), ("Bass Brothers", "Marsh", 1380.25), ("Copper Ketle Band", "Old Port", 725.0),
          ("Dulcimer House", "Linden", 415.0), ("Evensong Choristers", "Marsh", 2060.0), ("Fife and Drum Player Co", "Marsh", 98.0),
          ("Violet Lute Society", "Old Port", 51.0), ("Harbour Winds Ensemble", "Old Port", 3300.0)]


def test_fuzzy_compare_of_two_lists_of_names(spark):
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(NAMES_A, TOWNS_A, FEES_A))],
                              "_row bigint, Borrower string, Town string, Fee double")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS_B)], "_row bigint, Client string, Town string, Paid double")
    r = fuzzy_compare(a, b, ["Borrower"], ["Client"], {"Fee": "Paid", "Town": "Town"},
                      ignore_words=["co", "company", "ltd", "llc", "inc", "the"])
    matches = r.matches.orderBy("row_in_a_file").collect()
    assert [(m.row_in_a_file, m.row_in_b_file, m.similarity_pct, m.match_type) for m in matches] == [
        (2, 2, 100, "Same after cleaning"), (3, 3, 100, "Same after cleaning"), (4, 4, 97, "Similar"),
        (5, 5, 100, "Same after cleaning"), (6, 6, 100, "Same after cleaning"), (7, 7, 98, "Similar"), (9, 9, 98, "Similar")]
    assert {(d.column, d.value_a, d.value_b, d.difference) for d in r.diffs.collect()} == {
        ("Fee <-> Paid", "720.0", "725.0", 5.0), ("Town", "Old Port", "Marsh", None), ("Town", "Old Prt", "Old Port", None)}
    # 19 letters each, sorted words "gable organ society" and "lute society violet": 10 letters in common
    assert [x.closest for x in r.only_a.collect()] == ["Violet Lute Society"]
    assert [x.closest for x in r.only_b.collect()] == ["Gable Organ Society"]
    assert tuple(r.stats.first()) == (8, 8, 7, 0, 3, 1, 1)


def test_nothing_in_common_and_empty_names(spark):
    a = spark.createDataFrame([(0, "abc", "x"), (1, None, "x"), (2, "ghi", "y")], "_row bigint, n string, k string")
    b = spark.createDataFrame([(0, "ddd", "x"), (1, "eee", "x"), (2, "!!", "y")], "_row bigint, n string, k string")
    r = fuzzy_compare(a, b, ["n"], ["n"], must_match={"k": "k"})
    assert r.pairs.count() == 0
    assert {(x.row_in_file, x.closest, x.closest_pct) for x in r.only_a.collect()} == {
        (2, "ddd", 0), (3, None, None), (4, None, None)}


def test_a_chain_of_ties_takes_few_rounds(spark, monkeypatch):
    """Every row ties with two of the other side; the first of each pair decides all others, one after the other."""
    from tabwright.operators import assign as module
    rounds = []
    found = module.components
    monkeypatch.setattr(module, "components", lambda links: rounds.append(1) or found(links))
    n = 1000
    chain = [(u, v, 90) for u in range(n) for v in (u - 1, u) if v >= 0]
    members = [spark.range(n).selectExpr(f"id as {g}", "999 - id as row" if g == "u" else "id as row") for g in ("u", "v")]
    edges = spark.createDataFrame(chain, "u bigint, v bigint, score int")
    got = {tuple(r) for r in module.assign(edges, *members).collect()}
    plain = greedy({(u, v): s for u, v, s in chain}, {u: [999 - u] for u in range(n)}, {v: [v] for v in range(n)})
    assert got == plain and len(rounds) <= 12


def test_an_empty_key_column_in_the_middle_hides_no_match(spark):
    a = spark.createDataFrame([(0, "Smith", None, "John")], "_row bigint, x string, y string, z string")
    b = spark.createDataFrame([(0, "john smith")], "_row bigint, n string")
    assert [tuple(r) for r in fuzzy_compare(a, b, ["x", "y", "z"], ["n"], threshold=97).pairs.collect()] == [(0, 0, 100)]


def test_batches_score_like_single_pairs():
    import random
    import sys
    scoring = sys.modules["tabwright.functions.similarity"]
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdé😀", k=rng.randrange(1, 9))) for _ in range(rng.choice([0, 1, 2, 4, 25]))) for _ in range(600)]
    others = [t if rng.random() < 0.2 else rng.choice(texts) for t in texts]
    pairs = list(zip(texts, others))
    assert scoring.lcs_lengths(texts, others).tolist() == [lcs_length(x, y) for x, y in pairs]
    assert scoring.ratios(texts, others).tolist() == [ratio(x, y) for x, y in pairs]
    assert scoring.set_ratios(texts, others).tolist() == [token_set(x, y) for x, y in pairs]
    assert scoring.partial_ratios(texts[:150], others[:150]).tolist() == [partial(x, y) for x, y in pairs[:150]]


def test_similarity_of_columns_scores_like_single_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from tabwright.functions import similarity
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 7))) for _ in range(rng.choice([0, 1, 2, 4]))) for _ in range(300)]
    rows = [(t, rng.choice([t, *texts])) for t in texts]
    df = spark.createDataFrame(rows, "a string, b string")
    for method in ("token_sort", "token_set", "simple", "partial"):
        got = [r[0] for r in df.select(similarity(F.col("a"), F.col("b"), method)).collect()]
        assert got == [score_pair(a, b, method) for a, b in rows]


def closest_plain(nodes, others, method):
    made = {}
    for i, block, text in nodes:
        if held := [(-score_pair(text, t, method), row) for _, b, t, row in others if b == block]:
            made[i] = (-min(held)[0], min(held)[1])
    return made


def test_closest_texts_equal_all_pairs(spark, monkeypatch):
    import random

    from tabwright.operators import closest
    monkeypatch.setattr(closest, "CHUNK", 20)
    monkeypatch.setattr(closest, "GROUP", 4)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("aabcdexyz", k=rng.randrange(1, 8)))       # noqa: E731
    make = lambda n: [(i, rng.choice(["", "p", "q"][:1 + i % 3]), " ".join(word() for _ in range(rng.randrange(1, 5)))) for i in range(n)]
    nodes, others = make(60) + [(60, "none", "a"), (61, "", "ÿÿÿ")], [(*o, (o[0] * 37) % 150) for o in make(150)]
    a = spark.createDataFrame(nodes, "id int, block string, text string")
    b = spark.createDataFrame(others, "id int, block string, text string, first_row int")
    for method in ("token_sort", "token_set", "simple", "partial"):
        got = {r["id"]: (r["score"], r["row"]) for r in closest.closest_texts(a, b, method).collect()}
        assert got == closest_plain(nodes, others, method)


def test_closest_texts_score_few_pairs():
    import random

    import numpy as np

    from tabwright.operators import closest
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(200)]
    share = []
    for size in (500, 5000):
        texts = sorted(" ".join(rng.choices(words, k=3)) for _ in range(size))
        asked = [t[:-2] + "zz" for t in rng.sample(texts, 100)]
        best, rows = np.zeros(100, dtype=np.int64), np.zeros(100, dtype=np.int64)
        share.append(closest.closest_in(closest.Seen(asked, "simple"), best, rows, closest.Seen(texts, "simple"), np.arange(size)) / size / 100)
        assert best.min() >= 80
    assert share[1] < share[0] < 0.3
