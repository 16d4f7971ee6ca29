"""Replica profiling: cleaning, 7x24 hourly profile, daily profile, workload statistics.

Inputs are step-reduced series (one value per workload and 5-minute bucket),
so a workload holds at most span / step rows whatever the raw volume. Every
aggregate is keyed by workload plus a time cell, or by workload alone over
algebraic (partially aggregated) functions; exact percentiles buffer one
count per distinct value (``select_percentiles=True`` selects them without a
buffer, ``exact_percentiles=False`` switches to the bounded-memory approximation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.config import WL, ProfileConfig
from tempora.operators.quantiles import grouped_quantiles

PCTS = [0.25, 0.5, 0.75, 0.9, 0.95]


def percentiles(col: str, pcts: list[float], cfg: ProfileConfig = ProfileConfig()) -> Column:
    """Exact linear-interpolation percentiles (array), or the bounded-memory approximation."""
    if cfg.exact_percentiles:
        return F.percentile(F.col(col), F.array(*[F.lit(p) for p in pcts]))
    return F.percentile_approx(F.col(col), [float(p) for p in pcts], cfg.approx_accuracy).cast("array<double>")


def clean(samples: DataFrame, cfg: ProfileConfig = ProfileConfig()) -> DataFrame:
    """Drop missing values, drop values outside mean +/- k*std (population std; std 0 keeps all),
    then clamp to the replica floor. Each row keeps its own instant.

    Input is the step-reduced series (one row per workload and bucket), so one
    workload holds at most span / step rows: the statistics are a window over
    the workload (one pass, no self-join).
    """
    s = samples.where(F.col("value").isNotNull() & ~F.isnan("value"))
    w = Window.partitionBy(*WL)
    mu, sd = F.avg("value").over(w), F.stddev_pop("value").over(w)
    k = F.lit(cfg.outlier_std)
    keep = (sd <= 0) | ((F.col("value") >= mu - k * sd) & (F.col("value") <= mu + k * sd))
    return (s.withColumn("_keep", keep).where("_keep")
             .select(*WL, "ts", F.greatest(F.col("value"), F.lit(cfg.min_replicas_floor)).alias("value")))


def hourly_profile(clean_samples: DataFrame) -> DataFrame:
    """(wl, dow, hour) -> avg, max, min, std (population), count. Only non-empty cells."""
    return (clean_samples
            .groupBy(*WL, F.weekday("ts").alias("dow"), F.hour("ts").alias("hour"))
            .agg(F.avg("value").alias("avg"), F.max("value").alias("max"),
                 F.min("value").alias("min"), F.stddev_pop("value").alias("std"),
                 F.count(F.lit(1)).alias("count")))


def daily_profile(clean_samples: DataFrame) -> DataFrame:
    """(wl, dow) -> avg, max, min. Only non-empty days."""
    return (clean_samples
            .groupBy(*WL, F.weekday("ts").alias("dow"))
            .agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min")))


def workload_stats(clean_samples: DataFrame, cfg: ProfileConfig = ProfileConfig()) -> DataFrame:
    """wl -> avg, max, min, std (population), p25, p50, p75, p90, p95."""
    aggs = [F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"),
            F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n")]
    if cfg.select_percentiles:
        p = grouped_quantiles(clean_samples, WL, "value", PCTS, cfg.approx_accuracy)
        g = clean_samples.groupBy(*WL).agg(*aggs).join(p.select(*WL, F.col("quantiles").alias("_p")), WL)
    else:
        g = clean_samples.groupBy(*WL).agg(*aggs, percentiles("value", PCTS, cfg).alias("_p"))
    return g.select(*WL, "avg", "max", "min", "std",
                    *[F.col("_p")[i].alias(n) for i, n in enumerate(["p25", "p50", "p75", "p90", "p95"])],
                    "n")


def daily_means(daily: DataFrame) -> DataFrame:
    """wl -> mean of the seven daily averages (empty days count as 0) and of the five weekday ones."""
    return (daily.groupBy(*WL)
            .agg((F.sum("avg") / 7).alias("daily_mean"),
                 (F.coalesce(F.sum(F.when(F.col("dow") < 5, F.col("avg"))), F.lit(0.0)) / 5)
                 .alias("weekday_mean")))


def profile_grouping_sets(clean_samples: DataFrame) -> DataFrame:
    """All three grains in one aggregate: (wl, dow, hour), (wl, dow) and (wl).

    ``grain`` is the grouping id (0, 1, 3); keys aggregated away are reported as -1."""
    x = clean_samples.select(*WL, F.weekday("ts").alias("dow"), F.hour("ts").alias("hour"), "value")
    return (x.groupingSets([WL + ["dow", "hour"], WL + ["dow"], WL], *WL, "dow", "hour")
             .agg(F.grouping_id().alias("grain"),
                  F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"),
                  F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("count"))
             .withColumn("dow", F.coalesce("dow", F.lit(-1)))
             .withColumn("hour", F.coalesce("hour", F.lit(-1))))


def segment_report(clean_samples: DataFrame) -> DataFrame:
    """Per workload and load segment (peak / off_peak / weekend): count, avg, min, max."""
    d, h = F.weekday("ts"), F.hour("ts")
    seg = (F.when(d >= 5, F.lit("weekend"))
            .when((h >= 9) & (h < 17), F.lit("peak"))
            .otherwise(F.lit("off_peak")))
    return (clean_samples.groupBy(*WL, seg.alias("segment"))
            .agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("avg"),
                 F.min("value").alias("min"), F.max("value").alias("max")))


def expected_band_check(before: DataFrame, after: DataFrame, slack: float = 0.5) -> DataFrame:
    """Segment report of a later period against the bands of an earlier one: is its range within
    the earlier range, and its mean within ``slack`` of the earlier mean? Segments of both only."""
    bands = before.select(*WL, "segment", F.col("min").alias("exp_min"), F.col("max").alias("exp_max"),
                          F.col("avg").alias("exp_avg"))
    return after.join(bands, WL + ["segment"]).select(
        *WL, "segment", "count", "avg", "min", "max", "exp_min", "exp_max", "exp_avg",
        ((F.col("min") >= F.col("exp_min")) & (F.col("max") <= F.col("exp_max"))).alias("in_band"),
        (F.abs(F.col("avg") - F.col("exp_avg")) <= F.col("exp_avg") * slack).alias("avg_close"))
