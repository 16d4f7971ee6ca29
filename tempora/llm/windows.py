"""Placing pieces in windows by a plan over the histogram of their lengths.

Pieces of one length are alike for a packer, so a plan needs only how many there are of each
length: at most ``window`` numbers, however large the corpus. A plan row says where the pieces of
a length with the ranks from ``first`` on go: ``each`` of them to a window, side by side from
``offset`` on, in windows numbered from ``sequence`` on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLAN = "length long, first long, number long, each long, sequence long, offset long"
RANKED_TOGETHER = 500_000


def ranked(pieces: DataFrame, total: int, order: list[str]) -> DataFrame:
    """Adds ``rank``, from 0 within each length. A common length is ranked in shards, whose sizes
    then give each shard its first rank; no length meets in one task."""
    shards = 1 + total // RANKED_TOGETHER * 8
    cut = pieces.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(shards)))
    sizes = cut.groupBy("length", "shard").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(
        Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.row_number().over(Window.partitionBy("length", "shard").orderBy(*order)) - 1
    return (cut.withColumn("local", local).join(before.drop("size"), ["length", "shard"])
            .withColumn("rank", F.col("local") + F.coalesce("before", F.lit(0))).drop("local", "before", "shard"))


def placed(pieces: DataFrame, planner: Callable[[dict[int, int]], list[tuple]], order: list[str]) -> DataFrame:
    """``pieces`` (column ``length``, above 0) with ``sequence_id`` and ``offset`` by the planner's
    plan. Collected and broadcast are the histogram and the plan, which the window bounds."""
    spark = pieces.sparkSession
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = F.broadcast(spark.createDataFrame(planner(counts), PLAN).withColumnRenamed("offset", "at"))
    step = F.col("rank") - F.col("first")
    return (ranked(pieces, sum(counts.values()), order).join(plan, "length")
            .where((step >= 0) & (step < F.col("number")))
            .withColumn("sequence_id", F.col("sequence") + F.floor(step / F.col("each")))
            .withColumn("offset", F.col("at") + step % F.col("each") * F.col("length"))
            .drop("rank", "first", "number", "each", "sequence", "at"))
