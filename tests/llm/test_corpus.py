"""The corpus operators against plain versions, on the smallest tables and on rows with every odd case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare_sql import differences, open_tables
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tabwright.llm import bloom_dedup, bt_quality, mixing, packing, pii, quality_rules, queries, sharding, simhash, token_counts, url_filter
from tabwright.operators.components import components

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, row string, size int, t int, `a.b` int"


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [(1, None, None, "x", 1, 1, 1), (2, "", "b", "x", 1, 1, 1), (None, "a b c d", "b", "x", 1, 1, 1), (3, " \t\n ", None, "x", None, 1, 1),
       (4, "Same  text here", "a", "x", 1, 1, 1), (5, "Same text\there", "a", "x", 1, 1, 1), (5, "Same text\there", "a", "x", 1, 1, 1),
       (6, LONG, "ü", "x", 1, 1, 1), (7, "x" * 200_000, "a", "x", 1, 1, None), (None, "a b c d", "b", "x", 1, 1, 1), (8, "\u00a0😀 é", "a", None, 1, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_sql_at_the_next_scale(spark, name):
    folder = "/root/testdata/sf0.01"
    fn, sql = queries.QUERIES[name]
    assert not differences(spark, open_tables(folder), folder, name, fn, sql)


# ---- quality classifier

def test_quality_ranks_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.op1_quality(spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    assert len(rows) == pq.read_table(f"{folder}/documents.parquet", columns=["doc_id"]).num_rows
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
               for k, r in rows.items())
    held = [(rows[x["doc_id"]]["score"], x["quality"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([np.mean(np.array(good) > b) + np.mean(np.array(good) == b) / 2 for b in bad])
    right = np.mean([(s >= 0.3) == bool(q) for s, q in held])
    print("held out:", len(held), "auc", auc, "right", right)
    assert auc > 0.97 and right > 0.95


def test_pair_weights_minimise_the_pairwise_loss():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (300, 3)), rng.normal(0, 1, (40, 3))
    w = bt_quality.pair_weights(good, bad, pairs=50)
    assert np.mean((good @ w)[:, None] > (bad @ w)[None, :]) > 0.85 and w.min() > 0.4


def test_quality_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (6, 1), (6, None), (None, 1), (7, 1), (7, 0)], "doc_id bigint, quality int")
    assert bt_quality.score_documents(odd, labels).count() == len(ODD)
    none = bt_quality.score_documents(odd, labels.where("quality = 1")).collect()
    assert {r["predicted"] for r in none} == {1}
    assert bt_quality.score_documents(empty, labels).count() == 0
    kept = bt_quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


# ---- URL filters

def test_url_rules_on_odd_urls(spark):
    urls = [None, "", "example.com/en/x", "http://EXAMPLE.com/en/a?b#c", "http://www.example.com/en/", "http://notexample.com/en/", "ftp://a.net/es/x",
            "x://net/fr/", "http://a.net:80/es/", "http://net", "http://a.com?x/", "a://b://c.com/", "http://" + ".".join(["l"] * 3000) + ".com/" + "p/" * 3000]
    df = spark.createDataFrame([(1, u, "v", 1) for u in urls + urls], "page_id int, url string, verdict string, row int")
    rules = spark.createDataFrame([*queries.URL_RULES, ("com", "/", "block"), (None, "/", "block"), ("c.com", None, "block"), ("COM", "/", "allow")],
                                  "host string, path string, verdict string")
    made = url_filter.filter_urls(df, rules)
    assert made.columns == ["page_id", "url", "row", "host", "path", "rule", "verdict"]
    got = Counter((r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in made.collect())

    plain = [("com", "/", "block"), ("c.com", "", "block")] + queries.URL_RULES[1:]

    def expected(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in plain if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (url, host, path, *(max(fit)[1:] if fit else (None, "allow")))

    assert got == Counter(expected(u) for u in urls + urls)
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, rules.limit(0), default="block").collect()} == {"block"}


# ---- quality rules

def plain_rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if counts[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w)}


def test_rules_on_odd_rows(odd, empty):
    made = quality_rules.judge(odd)
    got = [{k: r[k] for k in plain_rules("")} for r in made.collect()]
    assert Counter(map(str, got)) == Counter(str(plain_rules(r[1])) for r in ODD)
    assert not any(r["base_failed"] and r["kept"] for r in made.collect())
    assert "row" in made.columns and "a.b" in made.columns and quality_rules.judge(empty).count() == 0


def test_rules_keep_good_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = [(labels[r["doc_id"]], r["kept"], r["base_failed"]) for r in queries.op3_quality_rules(spark, folder).collect() if r["doc_id"] in labels]
    good = [k for q, k, b in rows if q and not b]
    bad = [k for q, k, b in rows if not q]
    print("kept of good", np.mean(good), "kept of bad", np.mean(bad))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2


# ---- mixing

def plain_targets(sizes, weights):
    total, full, weights = sum(sizes), set(), weights[:len(sizes)]
    while True:
        left = total - sum(3 * sizes[i] for i in full)
        share = sum(w for i, w in enumerate(weights) if i not in full)
        new = {i for i in range(len(sizes)) if i not in full and 3 * sizes[i] < left * weights[i] / share}
        if not new:
            return [3 * s if i in full else left * weights[i] / share for i, s in enumerate(sizes)]
        full |= new


def test_mixing_on_odd_rows(odd, empty):
    made = mixing.mix(odd, rows_per_range=2).collect()
    assert len(made) == len(ODD)
    by = defaultdict(int)
    for r in ODD:
        by[r[2]] += len(WORD.findall(r[1] or ""))
    names = sorted((k for k in by if k is not None), key=lambda k: k.encode()) + [None]
    aims = dict(zip(names, plain_targets([by[k] for k in names], [1, 2, 3] * 3)))
    assert sorted({r["target"] for r in made}) == pytest.approx(sorted(set(aims.values())))
    assert sum(r["taken"] for r in made) == sum(int(a + 1e-9) for a in aims.values())
    assert all(r["taken"] <= 3 * r["size"] for r in made)
    again = mixing.mix(odd.repartition(5), rows_per_range=1000).collect()
    assert sorted(made, key=str) == sorted(again, key=str)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_mixed_rows_hold_the_words_taken(odd, spark):
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    assert sum(len(WORD.findall(r["text"])) for r in rows.collect()) == sum(r["taken"] for r in mixing.mix(odd).collect())
    d = docs(spark)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(d).collect() if r["taken"]}
    got = defaultdict(int)
    for r in mixing.mixed_rows(d).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == taken


# ---- personal data

PRIVATE = ["Write to Ann.B@mail.example.com or ANN.B@MAIL.EXAMPLE.COM, call +1 (017) 555-7713 or (017) 555-7713.",
           "Card 4111 1111 1111 1111, 4111111111111111!! and 7536784127813050 4845168114407329 from 97.51.17.173 or 97.51.17.173.",
           "Frau Greta Maier met Mr. Smith; г-жа Анна Петрова and Mrs JANE DOE. GREEN",
           'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!',
           "SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00.", "Nothing private: 12 apples, 1999-2001, version 3.4.5 of a@b."]


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def test_surrogates(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*PRIVATE, None, ""])], "doc_id int, text string")
    got = {r["doc_id"]: r for r in pii.replace_private(df, "k").collect()}
    a, b, c, d, e, f = (got[i]["text"] for i in range(6))
    assert [got[i]["n_replaced"] for i in range(8)] == [4, 6, 4, 2, 2, 0, 0, 0] and f == PRIVATE[5] and got[6]["text"] is None and got[7]["text"] == ""
    low, up = re.findall(r"[\w.]+@[\w.]+\w", a)
    assert low.upper() == up.upper() and up.isupper() and len(low) == 22 and low.lower() != "ann.b@mail.example.com" and low.endswith(".com")
    with_code, without = re.search(r"\+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4})\.", a).groups()
    assert with_code == without != "(017) 555-7713"
    spaced, plain, one, two, ip1, ip2 = re.fullmatch(r"Card (\d{4} \d{4} \d{4} \d{4}), (\d{16})!! and (\d{16}) (\d{16}) from (\S+) or (\S+)\.", b).groups()
    assert spaced.replace(" ", "") == plain != "4111111111111111" and luhn(plain) == 0 and len({plain, one, two}) == 3 and ip1 == ip2 != "97.51.17.173"
    assert re.fullmatch(r"Frau \w+ \w+ met Mr. \w+; г-жа [А-Яа-я]+ [А-Яа-я]+ and Mrs [A-Z]+ [A-Z]+\. GREEN", c)
    assert re.search(r"Frau (\w+)", c)[1] in pii.GIVEN[("latin", "f")] and "Maier" not in c and "Smith" not in c
    assert re.fullmatch(r'token = "[0-9a-f]{40}" TOKEN = "[0-9A-F]{40}"!!', d) and "2abc3ff" not in d
    assert re.fullmatch(r"SSN \d{3}-\d{2}-\d{4}, IBAN DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d\.", e) and "123-45" not in e
    assert {r["text"] for r in pii.replace_private(df, "k").collect()} == {r["text"] for r in got.values()}
    assert pii.replace_private(df, "other").where("doc_id = 0").head()["text"] != a


def test_phones_are_one_entity_with_any_separator(spark):
    texts = ["+1 (017) 555-7713", "+10175557713", "+1-017-555-7713", "(017) 555-7713", "+49 170 5557713", "+491705557713", "+421 905 123 456", "+421905123456"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    made = [r["text"] for r in pii.replace_private(df, "k").sort("doc_id").collect()]
    digits = [re.sub(r"\D", "", t) for t in made]
    assert digits[0] == digits[1] == digits[2] == "1" + digits[3] and digits[4] == digits[5] and digits[6] == digits[7]
    assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) and a != b for a, b in zip(texts, made))
    assert all(t.startswith(c) for t, c in zip(made, ["+1", "+1", "+1", "(", "+49", "+49", "+421", "+421"]))


def test_surrogates_that_collide_try_again(spark):
    """Fourteen of the hundred two-digit entities: some first surrogates are real ones or shared."""
    entities = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(14)], "kind string, canon string")
    tries = {r["canon"]: r["attempt"] for r in pii.attempts(entities, "k").collect()}
    assert tries
    tried = spark.createDataFrame([("ssn", f"{i:02d}", tries.get(f"{i:02d}", 0)) for i in range(14)], "kind string, canon string, attempt int")
    made = [r[0] for r in tried.select(pii.surrogate("k", F.col("kind"), F.col("canon"), F.col("attempt"))).collect()]
    assert len(set(made)) == 14 and not set(made) & {f"{i:02d}" for i in range(14)}


def test_surrogates_of_a_full_shape_are_longer(spark, monkeypatch):
    """All values of a shape are real entities, so no attempt in that shape can do."""
    monkeypatch.setattr(pii, "SAME_SHAPE", 2)
    entities = [("ssn", str(i)) for i in range(10)] + [("email", f"{i}@{j}.com") for i in range(10) for j in range(10)]
    tries = {(r["kind"], r["canon"]): r["attempt"] for r in pii.attempts(spark.createDataFrame(entities, "kind string, canon string"), "k").collect()}
    assert set(tries) == set(entities)
    tried = spark.createDataFrame([(*e, tries[e]) for e in entities], "kind string, canon string, attempt int")
    made = {(r["kind"], r["made"]) for r in tried.select("kind", pii.surrogate("k", F.col("kind"), F.col("canon"), F.col("attempt")).alias("made")).collect()}
    assert len(made) == len(entities) and not made & set(entities) and all(m.endswith(".com") for k, m in made if k == "email")
    odd = [("ip", "1.2.3.4"), ("name", "m/a b"), ("card", "4111111111111111"), ("iban", "DE89370400440532013000")]
    grown = spark.createDataFrame([(*e, 3) for e in odd], "kind string, canon string, attempt int").select(
        "kind", pii.surrogate("k", F.col("kind"), F.col("canon"), F.col("attempt")).alias("made"))
    assert {k: bool(re.fullmatch(p, m)) for (k, m), p in zip(grown.collect(), [r"(\d+\.){4}\d\d", r"m/[a-z]+ [a-z]{16}", r"\d{18}", r"DE\d{22}"])} == dict.fromkeys(
        ["ip", "name", "card", "iban"], True)
    texts = spark.createDataFrame([(i, t.upper()) for i, t in enumerate(["1@2.com", *(f"{i}@{j}.com" for i in range(10) for j in range(10))])], "doc_id int, text string")
    shown = [r["text"] for r in pii.replace_private(texts, "k").sort("doc_id").collect()]
    assert len(set(shown)) == 100 and shown[0] == shown[1 + 12] and all(t.isupper() and t.endswith(".COM") for t in shown)


def test_collided_surrogates_reach_the_texts(spark, monkeypatch):
    names = ["Mr. " + c + "o" for c in "ABCDEFGHIJKLMNOP"]
    monkeypatch.setattr(pii, "SYLLABLES", {"latin": ["ba", "do"], "cyrillic": ["ба"]})
    df = spark.createDataFrame([(i, f"{n} and {n}") for i, n in enumerate(names)], "doc_id int, text string")
    made = [r["text"].split(" and ") for r in pii.replace_private(df, "k").collect()]
    assert all(x == y for x, y in made) and len({x for x, _ in made}) == len(names)


def test_surrogates_on_documents(spark, odd, empty):
    rows = {r["doc_id"]: r for r in queries.op5_surrogates(spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    for k, t in texts.items():
        hidden = re.findall(r"[^\s@]+@mail\d+\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{15,16}\b|\b[0-9a-fA-F]{40}\b|\b\d+\.\d+\.\d+\.\d+\b", t)
        assert not any(h in rows[k]["text"] for h in hidden) and rows[k]["n_replaced"] >= len(hidden)
        if not hidden:
            assert rows[k]["text"] == t, t
    assert pii.replace_private(odd, "k").columns == [c for c in odd.columns if c != "text"] + ["text", "n_replaced"]
    assert pii.replace_private(odd, "k").where("text is not null").count() == len(ODD) - 1 and pii.replace_private(empty, "k").count() == 0


# ---- sharding

@pytest.mark.parametrize("which", ["documents", "odd"])
def test_shards(spark, odd, which):
    df = odd if which == "odd" else docs(spark)
    made = sharding.shard(df).collect()
    n = df.count()
    slots = defaultdict(list)
    for r in made:
        slots[r["shard"]].append(r["slot"])
    assert len(made) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(24)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(24))
    assert Counter(r["text"] for r in made) == Counter(r["text"] for r in df.collect())
    again = sharding.shard(df.repartition(2)).collect()
    assert Counter(map(str, again)) == Counter(map(str, made))


def test_shards_are_mixed(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    means = [r[0] for r in sharding.shard(rows).groupBy("shard").agg(F.avg("doc_id")).select("avg(doc_id)").collect()]
    assert len(means) == 24 and max(means) - min(means) < 1200
    assert sharding.shard(rows.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs(spark), path)
    assert spark.read.parquet(path).count() == docs(spark).count()


# ---- packing

def plain_ids(text):
    from tokenizers import Tokenizer

    from tabwright.llm.tokens import TOKENIZERS
    made = plain_ids.__dict__.setdefault("made", Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json"))
    return made.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, texts):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for k, t in texts.items():
        ids, pieces = np.array([*plain_ids(t), 0], dtype="<u4"), sorted(by_doc[k], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            part = ids[at:at + p["length"]]
            assert p["start"] == at and zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["ids"] == part.tobytes()
            at += p["length"]
        assert at == len(ids) and all(p["length"] == 2048 for p in pieces[1:]) and (len(pieces) == 1 or len(ids) > 2048)
    for some in bins.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return len(bins), sum(r["length"] for r in rows)


def test_packing(spark):
    made = packing.pack(docs(spark)).collect()
    bins, tokens = check_packing(made, {r["doc_id"]: r["text"] for r in table("documents")})
    assert bins <= 1.02 * -(-tokens // 2048) + 1


def test_packing_in_groups(spark):
    """Lengths of many pieces: groups lose next to nothing against the least number of sequences."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, "a " * int(n)) for i, n in enumerate(rng.integers(1, 900, 3000))], "doc_id int, text string")
    made = packing.pack(rows, group=512).select("sequence_id", "length").collect()
    assert len({r["sequence_id"] for r in made}) <= 1.02 * sum(r["length"] for r in made) / 2048 + 1


def test_packing_on_odd_rows(spark, odd, empty):
    rows = packing.pack(odd).collect()
    by = {i: r[1] for i, r in enumerate(ODD)}
    check_packing(packing.pack(spark.createDataFrame(list(by.items()), "doc_id int, text string")).collect(), by)
    assert sum(r["start"] == 0 for r in rows) == len(ODD) and packing.pack(empty).count() == 0
    special = "a<|endoftext|> b" + " " * 50_000 + "é😀"
    check_packing(packing.pack(spark.createDataFrame([(1, special)], "doc_id int, text string")).collect(), {1: special})


def test_best_fit_keeps_every_capacity():
    lengths = np.random.default_rng(5).integers(1, 60, 500)
    caps = (100, 3, 5000)
    bins, offsets = packing.best_fit(lengths, caps)
    for b in set(bins):
        some = lengths[bins == b]
        assert some.sum() <= 100 and len(some) <= 3 and (some ** 2).sum() <= 5000
        assert sorted(offsets[bins == b]) == [0, *np.cumsum(some[np.argsort(offsets[bins == b])])[:-1]]
    with pytest.raises(ValueError):
        packing.best_fit([101], caps)


# ---- SimHash

def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id per component, from {id: fingerprint}."""
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in ids}


def test_simhash(spark):
    prints = {r["doc_id"]: plain_print(r["text"]) for r in table("documents")}
    found = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, FOLDER).collect()}
    assert got == {k: (f"{p:016x}", found[k]) for k, p in prints.items()}
    kept = {r["doc_id"] for r in simhash.keep_first(docs(spark)).collect()}
    assert kept == set(found.values()) and 0 < len(kept) < len(found)


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_links_miss_none(spark, distance):
    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(0, 2 ** 63, 12)]
    prints = {0, 2 ** 64 - 1, 7, 2 ** 63}
    for b in base:
        for _ in range(25):
            p = b | (1 << 63) if rng.random() < 0.5 else b
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                p ^= 1 << int(bit)
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    got = {(r["a"], r["b"]) for r in simhash.links(df, distance).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= distance}


def test_simhash_on_odd_rows(odd, empty):
    made = simhash.near_groups(odd).collect()
    assert len(made) == len(ODD) and {r["fingerprint"] for r in made if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    assert {r["component_id"] for r in made if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in made if r["doc_id"] in (4, 5)} == {4}
    assert {r["component_id"] for r in made if r["doc_id"] is None} == {None}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(kept.collect(), key=str) and kept.count() == len({r["fingerprint"] for r in made})
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def plain_similar(texts):
    """All pairs with a Jaccard similarity of 0.8 or more of their 5-word shingles, from {id: text}."""
    sets = {}
    for k, t in sorted(texts.items()):
        w = (t or "").encode().lower().split()
        sets[k] = {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    n, held, pairs = Counter(x for s in sets.values() for x in s), defaultdict(list), set()
    for k, s in sets.items():    # such a pair shares one of the rarest fifth of either set, and one more
        for x in sorted(s, key=lambda x: (n[x], x))[:len(s) - -(-4 * len(s) // 5) + 1]:
            held[x].append(k)
    for v in held.values():
        pairs |= {(a, b) for i, a in enumerate(v) for b in v[i + 1:] if (a, b) not in pairs
                  and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    return pairs


def plain_groups(pairs):
    """The least of each group of pairs with each other member."""
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {(r, x) for x, r in root.items() if x != r}


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """300 copies of one text with words of their own, in chains and around it, beside texts of their own: no pairs of the group remain
    for the last step, and what is joined is what brute force joins."""
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(10 ** 6)}"                                   # noqa: E731
    base = [word() for _ in range(300)]
    texts = {}
    for i in range(300):
        w = list(texts[i - 20].split() if i % 3 == 0 and i > 20 else base)
        w[rng.integers(280)] = word()
        if i % 3 == 1:
            w[rng.integers(280)] = word()
        texts[i] = " ".join(w)
    texts |= {1000 + i: " ".join(word() for _ in range(100)) for i in range(100)}
    looked_at, rest = [], simhash._rest
    monkeypatch.setattr(simhash, "_rest", lambda *a: looked_at.append(made := rest(*a)) or made)
    kept = simhash.keep_unlike(spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(4))
    groups = plain_groups(plain_similar(texts))
    assert {r["doc_id"] for r in kept.collect()} == texts.keys() - {b for _, b in groups}
    assert len(groups) > 250 and looked_at[0].count() < 600
    # without any joining beforehand, the last join still has each pair once
    monkeypatch.setattr(simhash, "ROUNDS", 0)
    simhash.keep_unlike(spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(4))
    every = [(r["a"], r["b"]) for r in looked_at[1].collect()]
    assert len(every) == len(set(every)) > 600 and all(a < b for a, b in every)


def test_near_dedup_against_brute_force(spark):
    """The pipeline's stage on sf0.1 without exact copies: all 48 pairs are brought together."""
    import corpus_pipeline
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}
    plain = {min(m)[3] for m in plain_dedup(texts.items()).values()}
    frame = frame.join(spark.createDataFrame([(k,) for k in plain], "doc_id bigint"), "doc_id", "left_semi")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").select("doc_id").collect()}
    pairs = plain_similar({k: texts[k] for k in plain})
    assert len(pairs) == 48
    linked, missed = {x for p in pairs for x in p}, [p for p in pairs if p[0] in kept and p[1] in kept]
    assert plain - kept <= linked and not missed and not {9710, 7711, 7818} & kept


def test_near_dedup_on_odd_rows(odd, empty, spark):
    kept = simhash.keep_unlike(odd)
    assert kept.columns == odd.columns and simhash.keep_unlike(empty).count() == 0
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "6", "7", "8", "None"])
    w = LONG.split()[:200]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-2] + ["x"]).upper()), (3, " ".join(w[:100])), (None, " ".join(w)), (4, "a b"), (5, "a c")]
    made = simhash.keep_unlike(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in made.collect()) == [1, 3, 4, 5]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(500, 500), (601, 600), (600, 601), (601, 600)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 600: 600, 601: 600}


# ---- token counts

def test_token_counts(spark):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op9_token_counts(spark, FOLDER).collect()}
    assert got == {r["doc_id"]: len(plain_ids(r["text"])) for r in table("documents")}


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_boundaries_are_stitched(spark, tmp_path, block_bytes):
    rng = np.random.default_rng(block_bytes)
    plain = {}
    for k in range(3):
        ids = rng.choice([5, 6, 9], 200, p=[0.1, 0.5, 0.4]).astype("<u2")
        ids[60:120] = 7                      # many blocks without a separator
        (tmp_path / f"f{k}").write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == 5)
        for i, n in enumerate(np.diff(ends, prepend=-1) - 1):
            plain[f"f{k}", i] = (n, True)
        if ends[-1] < 199:
            plain[f"f{k}", len(ends)] = (199 - ends[-1], False)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "stray").write_bytes(b"\1\0\1\0")
    files = spark.createDataFrame([(f"f{k}",) for k in range(3)] + [("empty",)], "file string")
    got = token_counts.count_tokens(spark, f"file://{tmp_path}", files, separator=5, block_bytes=block_bytes).collect()
    assert {(r["file"], r["ordinal"]): (r["n_tokens"], r["closed"]) for r in got} == plain


def test_token_counts_on_odd_rows(odd, empty):
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.document_tokens(odd, block_bytes=64).collect())
    assert got == Counter((r[0], len(plain_ids(r[1]))) for r in ODD) and token_counts.document_tokens(empty).count() == 0


# ---- exact deduplication

def plain_dedup(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups["".join(WORD.findall(t or ""))].append((-len(t or ""), k is None, k or 0, k))
    return groups


@pytest.mark.parametrize("most_bytes", [1 << 16, 64 << 20])
def test_exact_dedup_on_odd_rows(odd, empty, most_bytes):
    groups = plain_dedup([(r[0], r[1]) for r in ODD])
    got = bloom_dedup.duplicate_table(odd, most_bytes=most_bytes).collect()
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == len(groups)
    expected = {(hashlib.sha256(g.encode()).hexdigest(), min(m)[3], len(m)) for g, m in groups.items()}
    assert {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in got} == expected
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = bloom_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(min(m)[3] for m in groups.values())
    assert bloom_dedup.duplicate_table(empty).count() == 0 and bloom_dedup.drop_duplicates(empty).count() == 0


def test_the_filter_misses_no_repeat_and_finds_few_others(spark):
    rows = spark.range(0, 40_000, 1, 6).select(F.xxhash64("id").alias("h"))
    rows = rows.unionByName(rows.limit(500)).unionByName(spark.range(3).select(F.lit(5).cast("bigint").alias("h")))
    made = bloom_dedup.repeated_filter(rows, 40_500)
    hit = rows.where(bloom_dedup.may_repeat(rows, "h", made)).distinct()
    assert rows.groupBy("h").count().where("count > 1").join(hit, "h", "left_anti").count() == 0 and hit.count() < 900


# ---- the pipeline

def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    frame = docs(spark)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    score = {r["doc_id"]: r["predicted"] for r in bt_quality.score_documents(frame, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, frame, FOLDER)
        if name == "quality":
            texts = {k: t for k, t in texts.items() if score[k]}
        elif name == "exact_dedup":
            texts = {min(m)[3]: texts[min(m)[3]] for m in plain_dedup(texts.items()).values()}
        elif name == "near_dedup":
            texts = {k: texts[k] for k in texts.keys() - {b for _, b in plain_groups(plain_similar(texts))}}
        elif name == "mix":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(frame).collect() if r["taken"]}
            got = defaultdict(int)
            for r in made.collect():
                got[r["doc_id"]] += len(WORD.findall(r["text"]))
            assert got == taken
        if name == "pack":
            assert sum(r["length"] for r in made.collect()) == sum(len(plain_ids(r["text"])) + 1 for r in frame.collect())
            break
        assert made.columns == docs(spark).columns
        if name != "mix":
            assert {r["doc_id"]: r["text"] for r in made.collect()} == texts
        made.write.parquet(path := f"{queries_folder(spark)}/{name}")
        frame = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, FOLDER).count() == made.count()


def test_pipeline_stages_keep_what_is_still_read(spark):
    import corpus_pipeline
    frame = docs(spark)
    first = corpus_pipeline.quality(spark, frame, FOLDER)
    n = first.count()
    second = corpus_pipeline.quality(spark, frame.limit(50), FOLDER)
    assert first.count() == n and second.count() <= 50
    chained = corpus_pipeline.exact_dedup(spark, corpus_pipeline.quality(spark, frame, FOLDER), FOLDER)
    assert chained.columns == frame.columns and 0 < chained.count() <= first.count() == n


def test_pipeline_on_odd_and_no_documents(spark, odd, empty):
    import corpus_pipeline
    for frame in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, frame, FOLDER)
            if name != "pack":
                assert made.columns == odd.columns and (name == "mix" or made.count() <= frame.count())
            frame = made
    assert frame.count() == 0


def queries_folder(spark):
    from tabwright.llm.common import new_path
    return new_path(spark, "test")


def test_near_copies_meet_alike_in_any_corpus(spark, monkeypatch):
    widths, entries = set(), simhash._entries
    monkeypatch.setattr(simhash, "_entries", lambda nodes, width: widths.add(width) or entries(nodes, width))
    monkeypatch.setattr(simhash, "ROUNDS", 1)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:-1])), (2, "another text")], "doc_id int, text string")
    sizes, count = [], type(docs).count
    for texts in (3, 1 << 22):           # what the corpus says its size is
        monkeypatch.setattr(type(docs), "count", lambda df, n=texts: n if count(df) == 3 else count(df))
        sizes.append(sorted(r.doc_id for r in simhash.keep_unlike(docs).collect()))
    assert sizes[0] == sizes[1] == [0, 2] and len(widths) == 1
