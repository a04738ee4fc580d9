"""One-to-one assignment of rows by best score first.

The wanted result is that of going through all row pairs by (score descending, row of A, row of B) and
taking a pair when both rows are still free. Rows with the same text behave alike, so pairs are kept per
distinct text ("group"); a group hands out its rows in order and only its offset changes.

Each round takes, all over the cluster at once, pairs that no other pair can come before:

* blocks: groups that are each other's best choices and no one else's. Their rows, merged in row order,
  pair up first with first, second with second, and so on.
* leaders: two groups whose next rows are each other's first choice. They pair up as long as neither
  side's next row loses to a rival group.

A round always takes at least the first remaining pair, so rounds end. But chains of ties give a round only one
pair each, so before every round the live pairs are split into connected components of groups that compete: what one
component takes never touches another. Components that fit in a task are finished in order, all of them side by side;
only larger ones go through the round, which breaks them up further.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .running import running_count
from .stable import stable

PAIRS = "row_a bigint, row_b bigint, score int"
#: Pairs and rows of one component that a task holds in memory.
MOST_IN_TASK = 200_000


def assign(edges: DataFrame, members_a: DataFrame, members_b: DataFrame, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(row_a, row_b, score) from edges (u, v, score) between groups and their members (u, row) / (v, row).

    ``most_in_task`` bounds the pairs and rows of a component that one task finishes; it does not change the result.
    """
    def ranked(members: DataFrame, g: str) -> DataFrame:
        used = members.join(edges.select(g).distinct(), g, "left_semi")
        return stable(running_count(used, [g], "row").select(g, "row", F.col("_before").alias("at"),
                                                             F.col("_total").alias("size")))

    edges = stable(edges)
    rows_a, rows_b = ranked(members_a, "u"), ranked(members_b, "v")
    state_a = rows_a.where("at = 0").select("u", F.lit(0).cast("bigint").alias("off_u"), F.col("size").alias("size_u"))
    state_b = rows_b.where("at = 0").select("v", F.lit(0).cast("bigint").alias("off_v"), F.col("size").alias("size_v"))
    done: list[DataFrame] = []
    while True:
        live = stable(edges.join(state_a, "u").join(state_b, "v").where("off_u < size_u and off_v < size_v"))
        if live.isEmpty():
            break
        if not most_in_task:    # rounds alone
            taken = stable(_round(live, rows_a, rows_b))
            done.append(taken.select("row_a", "row_b", "score"))
            state_a, state_b = _advance(state_a, taken, "u"), _advance(state_b, taken, "v")
            edges = live.select("u", "v", "score")
            continue
        # nodes of both sides in one numbering
        found = components(live.select((F.col("u") * 2).alias("a"), (F.col("v") * 2 + 1).alias("b")))
        roots = found.where("node % 2 = 0").select(F.expr("node div 2").alias("u"), "root")
        live = stable(live.join(roots, "u"))
        left_a = rows_a.join(live.select("u", "off_u", "root").distinct(), "u").where("at >= off_u").select("root", "u", "row")
        left_b = rows_b.join(live.select("v", "off_v", "root").distinct(), "v").where("at >= off_v").select("root", "v", "row")
        weights = reduce(DataFrame.unionAll, [x.groupBy("root").agg(F.count(F.lit(1)).alias("n")) for x in (live, left_a, left_b)])
        fitting = stable(weights.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") <= most_in_task))
        # many components share a task, as far as it can hold them
        tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                    2 * (fitting.agg(F.sum("n")).first()[0] or 0) // max(1, most_in_task))
        done.append(_finish(*[x.join(fitting, "root", "left_semi") for x in (live, left_a, left_b)], tasks))
        large = stable(live.join(fitting, "root", "left_anti").drop("root"))
        if large.isEmpty():
            break
        taken = stable(_round(large, rows_a, rows_b))
        done.append(taken.select("row_a", "row_b", "score"))
        state_a = _advance(state_a, taken, "u")
        state_b = _advance(state_b, taken, "v")
        edges = large.select("u", "v", "score")
    empty = edges.sparkSession.createDataFrame([], PAIRS)
    return reduce(DataFrame.unionAll, done, empty)


def _advance(state: DataFrame, taken: DataFrame, g: str) -> DataFrame:
    used = taken.groupBy(g).agg(F.count(F.lit(1)).alias("_used"))
    return stable(state.join(used, g, "left").select(
        g, (F.col(f"off_{g}") + F.coalesce("_used", F.lit(0))).alias(f"off_{g}"), f"size_{g}"))


def _round(live: DataFrame, rows_a: DataFrame, rows_b: DataFrame) -> DataFrame:
    """Pairs (u, v, row_a, row_b, score) that can be taken now."""
    # best score of every group, and the edges that reach it on either side
    top_u = live.groupBy("u").agg(F.max("score").alias("top_u"))
    top_v = live.groupBy("v").agg(F.max("score").alias("top_v"))
    best = stable(live.join(top_u, "u").join(top_v, "v").where("score = top_u or score = top_v"))
    fan_u = best.where("score = top_u").groupBy("u").agg(F.count(F.lit(1)).alias("fan_u"), F.min("v").alias("low_v"))
    fan_v = best.where("score = top_v").groupBy("v").agg(F.count(F.lit(1)).alias("fan_v"), F.min("u").alias("low_u"))
    mutual = stable(best.where("score = top_u and score = top_v").join(fan_u, "u").join(fan_v, "v"))

    # blocks: every member is tied with exactly the other side's members
    per_block = mutual.groupBy("low_u", "low_v").agg(
        F.count(F.lit(1)).alias("_edges"), F.count_distinct("u").alias("_p"), F.count_distinct("v").alias("_q"),
        F.min("fan_u").alias("_fu"), F.max("fan_u").alias("_gu"), F.min("fan_v").alias("_fv"),
        F.max("fan_v").alias("_gv"))
    blocks = per_block.where("_edges = _p * _q and _fu = _q and _gu = _q and _fv = _p and _gv = _p").select(
        "low_u", "low_v")
    inside = stable(mutual.join(blocks, ["low_u", "low_v"]))
    side_a = _merged(inside.select("low_u", "low_v", "score", "u", "off_u").distinct(), rows_a, "u")
    side_b = _merged(inside.select("low_u", "low_v", "v", "off_v").distinct(), rows_b, "v")
    from_blocks = side_a.join(side_b, ["low_u", "low_v", "_k"]).select(
        "u", "v", F.col("row_u").alias("row_a"), F.col("row_v").alias("row_b"), "score")

    # leaders among the rest: next rows that choose each other; rivals limit how far they go on
    rest = best.join(inside.select("u").distinct(), "u", "left_anti")
    next_a = rows_a.select("u", F.col("at").alias("off_u"), F.col("row").alias("head_u"))
    next_b = rows_b.select("v", F.col("at").alias("off_v"), F.col("row").alias("head_v"))
    headed = stable(rest.join(next_a, ["u", "off_u"]).join(next_b, ["v", "off_v"]))
    first_u = headed.where("score = top_u").groupBy("u").agg(F.min("head_v").alias("first_v"))
    first_v = headed.where("score = top_v").groupBy("v").agg(F.min("head_u").alias("first_u"))
    headed = headed.join(first_u, "u").join(first_v, "v")
    rival_u = headed.where("score = top_u and head_v > first_v").groupBy("u").agg(F.min("head_v").alias("rival_v"))
    rival_v = headed.where("score = top_v and head_u > first_u").groupBy("v").agg(F.min("head_u").alias("rival_u"))
    lead = (headed.where("score = top_u and score = top_v and head_v = first_v and head_u = first_u")
            .join(rival_u, "u", "left").join(rival_v, "v", "left")
            .withColumn("room", F.least(F.col("size_u") - F.col("off_u"), F.col("size_v") - F.col("off_v"))))
    lead_a = (lead.select("u", "v", "score", "off_u", "rival_u", "room").join(rows_a, "u")
              .where("at >= off_u and at < off_u + room and (rival_u is null or row < rival_u)")
              .select("u", "v", "score", (F.col("at") - F.col("off_u")).alias("_k"), F.col("row").alias("row_a")))
    lead_b = (lead.select("u", "v", "off_v", "rival_v", "room").join(rows_b, "v")
              .where("at >= off_v and at < off_v + room and (rival_v is null or row < rival_v)")
              .select("u", "v", (F.col("at") - F.col("off_v")).alias("_k"), F.col("row").alias("row_b")))
    from_leaders = lead_a.join(lead_b, ["u", "v", "_k"]).select("u", "v", "row_a", "row_b", "score")
    return from_blocks.unionAll(from_leaders)


def _merged(groups: DataFrame, rows: DataFrame, g: str) -> DataFrame:
    """The remaining rows of a block's groups in row order, numbered within the block."""
    left = groups.join(rows.select(g, "row", "at"), g).where(F.col("at") >= F.col(f"off_{g}")).drop("at", f"off_{g}")
    return running_count(left, ["low_u", "low_v"], "row").withColumnRenamed("row", f"row_{g}").withColumn(
        "_k", F.col("_before")).drop("_before", "_total")


def _finish(live: DataFrame, left_a: DataFrame, left_b: DataFrame, tasks: int) -> DataFrame:
    """The pairs of whole components in order, each in one task (their sizes were checked by the caller)."""
    none = F.lit(None).cast("bigint")
    records = (live.select("root", "u", "v", none.alias("row"), F.col("score").cast("int").alias("score"))
               .unionAll(left_a.select("root", "u", none.alias("v"), "row", F.lit(0).alias("score")))
               .unionAll(left_b.select("root", none.alias("u"), "v", "row", F.lit(0).alias("score"))))

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        is_edge = pdf.row.isna()
        waiting_a = sorted(zip(pdf.row[pdf.v.isna()], pdf.u[pdf.v.isna()]))
        free_b = {v: sorted(rows, reverse=True) for v, rows in pdf.row[pdf.u.isna()].groupby(pdf.v)}
        taken, out = set(), []
        levels = pdf[is_edge].groupby("score")
        for score, level in sorted(levels, reverse=True, key=lambda x: x[0]):
            partners = level.groupby("u").v.apply(list).to_dict()
            for row, u in waiting_a:
                options = [] if row in taken else [v for v in partners.get(u, ()) if free_b[v]]
                if options:
                    out.append((row, free_b[min(options, key=lambda v: free_b[v][-1])].pop(), score))
                    taken.add(row)
        return pd.DataFrame(out, columns=["row_a", "row_b", "score"]).astype(
            {"row_a": "int64", "row_b": "int64", "score": "int32"})

    return records.groupBy(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task")).applyInPandas(in_order, PAIRS)
