"""One query per operator over its whole table, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bloom_dedup, bpe_stream, bt_quality, filter_audit, mixing, packing, pii, quality_rules, sharding, simhash,
               token_counts, url_filter, vector_codes)
from .common import read

#: The rules that `op2_url_filter` applies.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
SURROGATE_KEY = "surrogates-2024"


def op1_quality(spark, folder):
    return bt_quality.score_documents(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op2_url_filter(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read(spark, folder, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


def op3_quality_rules(spark, folder):
    return quality_rules.judge(read(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mixing(spark, folder):
    return mixing.mix(read(spark, folder, "documents"))


def op5_surrogates(spark, folder):
    return pii.replace_private(read(spark, folder, "documents"), SURROGATE_KEY).select("doc_id", "text", "n_replaced")


def op6_sharding(spark, folder):
    made = sharding.shard(read(spark, folder, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return made.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_packing(spark, folder):
    return packing.pack(read(spark, folder, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_simhash(spark, folder):
    return simhash.near_groups(read(spark, folder, "documents"))


def op9_token_counts(spark, folder):
    return token_counts.document_tokens(read(spark, folder, "documents"))


def op10_exact_dedup(spark, folder):
    return bloom_dedup.duplicate_table(read(spark, folder, "documents"))


def op11_bpe(spark, folder):
    return bpe_stream.round_trip(read(spark, folder, "documents"))


def op12_filter_audit(spark, folder):
    return filter_audit.audit(filter_audit.masked(read(spark, folder, "documents"), read(spark, folder, "labels")))


def op13_vector_codes(spark, folder):
    return vector_codes.compress(read(spark, folder, "embeddings"))


WS = r"[\x20\x09-\x0D]"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
SQL2 = rf"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM cut),
rules(h, p, v) AS (VALUES {_RULES}),
fits AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC) AS k FROM parts JOIN rules
    ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)"""

_STOP = "|".join(sorted({x for some in quality_rules.STOP_WORDS.values() for x in some}))
_PARTS = {"word_chars": "word_chars", "n_symbols": "n_symbols", "n_stop_words": "n_stop", "n_dup_lines": "n_dup_lines",
          "n_shouts": "n_shouts", "n_lettered": "n_lettered", "n_words": "n_words", "n_lines": "n_lines"}
_TESTS = " AND ".join([f"100 * {_PARTS[a]} >= {low} * {_PARTS[b]}" for _, a, b, low, _ in quality_rules.THRESHOLDS if low is not None]
                      + [f"100 * {_PARTS[a]} <= {high} * {_PARTS[b]}" for _, a, b, _, high in quality_rules.THRESHOLDS if high is not None])
SQL3 = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT n, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d)),
g AS (SELECT n, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY n ORDER BY i)),
r AS (SELECT n, i, count(*) OVER (PARTITION BY n, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
covered AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS s(k) WHERE c > 1 GROUP BY n),
counted AS (SELECT n, count(*) AS n_words, sum(length(w)) AS word_chars,
    count(*) FILTER (regexp_matches(w, '^(?i:{_STOP})\PL*$')) AS n_stop,
    count(*) FILTER (regexp_matches(w, '^\PL*\p{{Lu}}{{2,}}\PL*$')) AS n_shouts, count(*) FILTER (regexp_matches(w, '\pL')) AS n_lettered
    FROM w GROUP BY n),
l AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop, 0) AS n_stop, coalesce(n_shouts, 0) AS n_shouts,
    coalesce(n_lettered, 0) AS n_lettered, coalesce(n_lines, 0) AS n_lines
    FROM d LEFT JOIN counted USING (n) LEFT JOIN lines USING (n) LEFT JOIN covered USING (n)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_TESTS} AS kept FROM f"""


def mixing_sql(documents: str) -> str:
    """CTEs that end in ``mixed``: every row of a table with what the mix takes of it."""
    return rf"""
sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|') AS mix_key FROM {documents}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM sized GROUP BY source),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS most FROM per_source),
level_up AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS share_of,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS shared_by FROM weighted
    WINDOW o AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)),
level AS (SELECT share_of, shared_by FROM level_up WHERE most::HUGEINT * shared_by >= share_of::HUGEINT * weight
    ORDER BY most::DOUBLE / weight, source NULLS LAST LIMIT 1),
aims AS (SELECT source AS aim_source, source_size,
    CASE WHEN most::HUGEINT * shared_by < share_of::HUGEINT * weight THEN most::DOUBLE ELSE (share_of * weight)::DOUBLE / shared_by::DOUBLE END AS target,
    CASE WHEN most::HUGEINT * shared_by < share_of::HUGEINT * weight THEN most ELSE (share_of * weight) // shared_by END AS budget FROM weighted, level),
before AS (SELECT sized.*, source_size, target, budget, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY mix_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM sized JOIN aims ON source IS NOT DISTINCT FROM aim_source),
mixed AS (SELECT *, greatest(0, least(size, budget - epochs * source_size - earlier))::BIGINT AS cut FROM before)"""


SQL4 = f"WITH {mixing_sql('documents')} SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + cut)::BIGINT AS taken FROM mixed"

SQL10 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents),
o AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER w AS k FROM d
    WINDOW w AS (PARTITION BY plain ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(plain) AS text_sha256 FROM o"""

SQL12 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM f LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS o FROM letters v, letters w, letters x, letters y, letters z
    WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
gone AS (SELECT cells.*, o, least(if(a, strpos(o, 'A'), 6), if(b, strpos(o, 'B'), 6), if(c, strpos(o, 'C'), 6), if(d, strpos(o, 'D'), 6),
    if(e, strpos(o, 'E'), 6)) AS gone_at FROM cells, orders),
told AS (SELECT part, o AS filter_order, step, sum(n) FILTER (gone_at > step) AS kept, sum(n) FILTER (gone_at = step) AS removed,
    sum(n) FILTER (gone_at < step AND fails) AS redundant, sum(n) FILTER (fails AND a::INT + b::INT + c::INT + d::INT + e::INT = 1) AS unique_fails,
    sum(good) FILTER (gone_at = step) AS good_lost, sum(toxic) FILTER (gone_at = step) AS toxic_lost
    FROM (SELECT *, substr(o, step, 1) AS letter, [a, b, c, d, e][strpos('ABCDE', substr(o, step, 1))] AS fails
        FROM gone, (SELECT unnest(range(1, 6)) AS step)) GROUP BY part, o, step)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    (sum(coalesce(removed, 0)) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM told"""


def _round_sql(k: int) -> str:
    """CTEs of one round: the parts assigned to the books ``c{k}``, and the books after that."""
    apart = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in range(4))
    means = ", ".join(f"CASE WHEN n IS NULL THEN c.x{i} ELSE (s{i} - ((s{i} % n) + n) % n) // n END AS x{i}" for i in range(4))
    sums = ", ".join(f"sum(x{i})::BIGINT AS s{i}" for i in range(4))
    return f"""
a{k} AS (SELECT p.rid, p.part, min(({apart}) * 64 + c.e) AS m FROM p JOIN c{k} c ON p.part = c.part GROUP BY p.rid, p.part),
s{k} AS (SELECT part, m % 64 AS e, count(*) AS n, {sums} FROM a{k} JOIN p USING (rid, part) GROUP BY part, m % 64),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.e, {means} FROM c{k} c LEFT JOIN s{k} s ON c.part = s.part AND c.e = s.e)"""


#: For vectors of 64 components (parts of four).
SQL13 = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, [floor(256 * x)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT rid, part, v[4 * part + 1] AS x0, v[4 * part + 2] AS x1, v[4 * part + 3] AS x2, v[4 * part + 4] AS x3 FROM kept, range(16) r(part)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x0, x1, x2, x3 FROM p WHERE rid <= 64),{_round_sql(0)},{_round_sql(1)},{_round_sql(2)},
coded AS (SELECT rid, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY rid),
books AS (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), books"""

QUERIES = {
    "op1_quality": (op1_quality, None),
    "op2_url_filter": (op2_url_filter, SQL2),
    "op3_quality_rules": (op3_quality_rules, SQL3),
    "op4_mixing": (op4_mixing, SQL4),
    "op5_surrogates": (op5_surrogates, None),
    "op6_sharding": (op6_sharding, None),
    "op7_packing": (op7_packing, None),
    "op8_simhash": (op8_simhash, None),
    "op9_token_counts": (op9_token_counts, None),
    "op10_exact_dedup": (op10_exact_dedup, SQL10),
    "op11_bpe": (op11_bpe, None),
    "op12_filter_audit": (op12_filter_audit, SQL12),
    "op13_vector_codes": (op13_vector_codes, SQL13),
}


def all_queries() -> dict:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
