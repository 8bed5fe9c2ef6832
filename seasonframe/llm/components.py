"""Connected components as joins and aggregates, and the block pairs by which large buckets are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import written


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """(node, component_id) of every node of an undirected edge list; the smallest node names a component.

    Each round lets every node take the smallest label among its neighbours and then the label of its label
    (pointer jumping), so long chains shorten geometrically. Every round is written to the shared folder:
    lost executors cost one round at most. The edge list stays in place and is hot only at hubs, whose
    aggregates combine before the shuffle and whose join sides adaptive execution splits.
    """
    pairs = edges.select(F.col(low).alias("u"), F.col(high).alias("v")).where(F.col("u") != F.col("v"))
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("c").alias("n")), "v").groupBy("u").agg(
            F.min("n").alias("n"))
        taken = labels.join(near, "u").select("u", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        jumped = taken.alias("l").join(labels.alias("r"), F.col("l.c") == F.col("r.u")).select(
            "l.u", "l.old", F.least("l.c", "r.c").alias("c"))
        new = written(jumped)
        moved = new.where("c < old").limit(1).count()
        labels = new.select("u", "c")
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component_id"))


def block_pairs(rows: DataFrame, key: str, spread: Column, limit: int) -> DataFrame:
    """Deal rows so that every two rows of a key meet in one (key, _cell), and no cell holds much more than
    2 * `limit` rows. Adds `_cell` (long) and `_side`: 0 both sides of a plain cell, else 1 or 2.

    A key of at most `limit` rows is one cell. A larger one is cut into n blocks by `spread`, and its rows go
    to the n*(n+1)/2 pairs of blocks: block i is side 1 of the cells (i, j) with i < j, side 2 of (h, i) with
    h < i, and side 0 of (i, i).
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(
        key, F.ceil(F.col("_n") / limit).alias("_blocks"))
    dealt = rows.join(sizes, key, "left").withColumn("_i", F.pmod(spread, F.col("_blocks")))
    cells = F.when(F.col("_blocks").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side")))) \
        .otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda j: F.struct(
            (F.least(F.col("_i"), j) * F.col("_blocks") + F.greatest(F.col("_i"), j)).alias("cell"),
            F.when(j == F.col("_i"), 0).when(j > F.col("_i"), 1).otherwise(2).alias("side"))))
    return dealt.withColumn("_c", F.explode(cells)).select(
        *rows.columns, F.col("_c.cell").alias("_cell"), F.col("_c.side").alias("_side"))
