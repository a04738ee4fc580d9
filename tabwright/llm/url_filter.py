"""Allow and block rules for URLs, met by an equi-join on short hash prefixes.

Every URL is expanded into host suffix + path prefix expressions; their SHA-256 digests meet the digests of
the rules on the first 32 bits, full digests confirm, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, name, saved, unfold, whole_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8  # hex digits of the digest that are joined on


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    known = F.coalesce(start > 0, F.lit(False))
    return (F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(known, path).otherwise(""))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    ``rules`` has the columns ``host``, ``path`` (compared from its start, empty for all) and ``verdict``. A rule
    fits its host and all subdomains if the URL's path starts with the rule's. Of the rules that fit, the longest
    (host and path together) wins; of equally long ones ``block`` wins. Where none fits, ``rule`` is null
    and the verdict is ``default``. Rules with a null host or verdict are ignored; a null path counts as empty.

    Only shapes that occur among the rules (number of host labels, length of the path) are expanded: no other
    expression can meet a rule, and a very long URL has no more expressions than the rules have shapes. The
    distinct URLs are judged once, so copies of one URL cost nothing, and come back by a left join, whose hot
    keys Spark can split. An empty table gives an empty table; input columns with the name of a result give way.
    """
    made = rules.where("host is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
    made = made.groupBy("r_host", "r_path").agg(
        F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("_block"), F.min("verdict").alias("_any"))
    made = made.select(
        F.concat("r_host", "r_path").alias("rule"), F.when(F.col("_block") == 1, "block").otherwise(F.col("_any")).alias("verdict"),
        _digest(F.concat_ws("\0", "r_host", "r_path")).alias("r_digest"),
        F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("reach"))
    made = saved(made, "url-rules")
    # a shape is (labels of the host, characters of the path): a few numbers, whatever the number of rules
    shapes = [(r[0], r[1]) for r in made.select("labels", "reach").distinct().collect()]

    host, path = url_parts(F.col("u"))
    seen = df.select(name(url).cast("string").alias("u")).where("u is not null").distinct()
    seen = seen.select("u", host.alias("h"), path.alias("p")).where("h <> '' or p <> ''")
    has = F.size(F.split("h", r"\."))
    expressions = [F.when((has >= n) & (F.length("p") >= reach), F.concat(
        F.substring_index("h", ".", -n), F.lit("\0"), F.substring("p", 1, reach))) for n, reach in shapes] or [F.lit(None).cast("string")]
    probes = (seen.select("u", F.explode(F.array_compact(F.array(*expressions))).alias("e"))
              .select("u", _digest(F.col("e")).alias("digest")))
    rules_by_prefix = broadcast_below(made.withColumn("r_prefix", F.substring("r_digest", 1, PREFIX)))
    met = (probes.withColumn("prefix", F.substring("digest", 1, PREFIX)).join(rules_by_prefix, F.col("prefix") == F.col("r_prefix"))
           .where("digest = r_digest"))
    rank = F.struct(F.length("rule"), F.col("verdict") == "block", F.col("rule"))
    # a table of its own, so that the join can split the rows of a frequent URL
    best = saved(met.groupBy("u").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best")), "url-verdicts")
    rows = df.select(whole_rows(df).alias("row"), name(url).cast("string").alias("url_"))
    found = rows.join(best, F.col("url_") == F.col("u"), "left")
    host, path = url_parts(F.col("url_"))
    return unfold(found, "row", df.columns, [host, path, F.col("best.rule"), F.coalesce("best.verdict", F.lit(default))],
                  ["host", "path", "rule", "verdict"])
