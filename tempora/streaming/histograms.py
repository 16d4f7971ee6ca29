"""Rolling value histogram of a stream: the state from which triggers are mined again.

Each micro-batch writes how often each value came in each (workload, day, hour); replica counts are
few, so these counts are small, they add up exactly, and every statistic of the miner, percentiles
included, follows from them. ``compact_histogram`` folds batches into one row a value and leaves out
days beyond the window. The ``*_of_counts`` functions give the same results as those of
``operators.profile`` over the samples themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.config import WL, DetectConfig, ProfileConfig
from tempora.operators import detect as D
from tempora.operators import triggers as G
from tempora.operators.profile import PCTS, daily_means

CELL = [*WL, "day", "hour"]


def value_counts(samples: DataFrame) -> DataFrame:
    """``day, hour, value, n`` of each workload; rows without a value are left out."""
    return (samples.where(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy(*WL, F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "value").agg(F.count(F.lit(1)).alias("n")))


def histogram_refresh(samples: DataFrame, state_dir: str, checkpoint: str, trigger: dict | None = None):
    """Start the refresh query; each micro-batch overwrites its own ``batch_id=`` partition, so a
    retried batch replaces its counts."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (value_counts(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(state_dir))

    w = samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def merge_counts(counts: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Counts of the days in [as_of - days, as_of] (all without ``as_of``), one row a value and cell."""
    if as_of is not None:
        last = F.lit(as_of).cast("date")
        counts = counts.where(F.col("day").between(F.date_sub(last, days), last))
    return counts.groupBy(*CELL, "value").agg(F.sum("n").alias("n"))


def compact_histogram(spark: SparkSession, state_dir: str, to_dir: str, as_of=None, days: int = 30) -> None:
    """All batches of ``state_dir`` as batch -1 of a new folder, without the days that have left the
    window; run between refreshes and go on with that folder."""
    merged = merge_counts(spark.read.parquet(state_dir), as_of, days)
    merged.withColumn("batch_id", F.lit(-1)).write.mode("errorifexists").partitionBy("batch_id").parquet(to_dir)


def clean_counts(counts: DataFrame, cfg: ProfileConfig = ProfileConfig()) -> DataFrame:
    """Merged counts without the outliers of each workload (mean +/- k * population std; std 0 keeps
    all), values raised to the replica floor."""
    v, n = F.col("value"), F.col("n")
    totals = counts.groupBy(*WL).agg((F.sum(v * n) / F.sum("n")).alias("_mu"))
    centred = counts.join(totals, WL)
    spread = centred.groupBy(*WL).agg(F.sqrt(F.sum((v - F.col("_mu")) ** 2 * n) / F.sum("n")).alias("_sd"))
    k = F.lit(cfg.outlier_std)
    near = (F.col("_sd") <= 0) | ((v >= F.col("_mu") - k * F.col("_sd")) & (v <= F.col("_mu") + k * F.col("_sd")))
    return (centred.join(spread, WL).where(near).withColumn("value", F.greatest(v, F.lit(cfg.min_replicas_floor)))
            .groupBy(*CELL, "value").agg(F.sum("n").alias("n")))


def _weighted(counts: DataFrame, keys: list[str], *more) -> DataFrame:
    """avg, max, min, population std and count of the values, weighted by ``n``. A group has a row
    for each cell and distinct value."""
    w = Window.partitionBy(*keys)
    v, n = F.col("value"), F.col("n")
    x = counts.withColumn("_mu", F.sum(v * n).over(w) / F.sum(n).over(w))
    return x.groupBy(*keys).agg(F.first("_mu").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"),
                                F.sqrt(F.sum((v - F.col("_mu")) ** 2 * n) / F.sum("n")).alias("std"), F.sum("n").alias("count"), *more)


def hourly_of_counts(counts: DataFrame) -> DataFrame:
    """``profile.hourly_profile`` of the counted samples."""
    return _weighted(counts.withColumn("dow", F.weekday("day")), [*WL, "dow", "hour"])


def daily_of_counts(counts: DataFrame) -> DataFrame:
    """``profile.daily_profile`` of the counted samples."""
    return _weighted(counts.withColumn("dow", F.weekday("day")), [*WL, "dow"]).select(*WL, "dow", "avg", "max", "min")


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """``profile.workload_stats`` of the counted samples; the percentiles are exact."""
    p = F.percentile("value", F.array(*[F.lit(x) for x in PCTS]), F.col("n")).alias("_p")
    g = _weighted(counts, WL, p)
    return g.select(*WL, "avg", "max", "min", "std", *[F.col("_p")[i].alias(c) for i, c in enumerate(["p25", "p50", "p75", "p90", "p95"])],
                    F.col("count").alias("n"))


def triggers_of_counts(counts: DataFrame, spark: SparkSession, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Triggers mined from the state, as ``triggers.v2_triggers`` mines them from samples."""
    clean = clean_counts(counts)
    stats = stats_of_counts(clean)
    patterns = D.detect(hourly_of_counts(clean), stats, daily_means(daily_of_counts(clean)), spark, cfg)
    return G.v2_triggers(patterns, stats, cfg)
