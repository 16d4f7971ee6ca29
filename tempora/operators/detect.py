"""Rule-based load-pattern detectors over the 7x24 profile.

The six detectors are one literal membership table ``(pattern_type, dow, hour)``
(at most 6 x 168 rows -- a fixed, proven size, so it is broadcast) joined to
the profile cells by equality on ``(dow, hour)``, then one aggregate per
``(workload, pattern_type)``. The profile has at most 168 rows per workload,
so no group here can grow with the raw data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.config import WL, DetectConfig


def detector_table(spark: SparkSession, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    rows = [(t, i, hrs, days, float(fl), mc, mx) for i, (t, hrs, days, fl, mc, mx) in enumerate(cfg.detectors())]
    return spark.createDataFrame(
        rows, "pattern_type string, det_order int, hours array<int>, days array<int>, "
              "conf_floor double, min_cells int, use_cell_max boolean")


def detector_membership(spark: SparkSession, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    rows = [(t, d, h) for t, hrs, days, _, _, _ in cfg.detectors() for d in days for h in hrs]
    return spark.createDataFrame(rows, "pattern_type string, dow int, hour int")


def detect(hourly: DataFrame, stats: DataFrame, dmeans: DataFrame, spark: SparkSession,
           cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Accepted patterns per workload.

    Columns: namespace, deployment, pattern_type, det_order, hours, days, avg_replicas,
    min_replicas, max_replicas, percentile_25, percentile_75, confidence, sample_count.
    """
    meta = F.broadcast(detector_table(spark, cfg))
    member = F.broadcast(detector_membership(spark, cfg))
    cells = hourly.where(F.col("count") > 0).join(member, ["dow", "hour"])
    cells = cells.join(meta.select("pattern_type", "use_cell_max"), "pattern_type")
    g = (cells.groupBy(*WL, "pattern_type")
         .agg(F.avg("avg").alias("avg_replicas"),
              F.min("avg").alias("min_replicas"),
              F.max(F.when(F.col("use_cell_max"), F.col("max")).otherwise(F.col("avg"))).alias("max_replicas"),
              F.percentile(F.col("avg"), F.array(F.lit(0.25), F.lit(0.75))).alias("_q"),
              F.stddev_pop("avg").alias("_sd"),
              F.count(F.lit(1)).alias("sample_count")))
    ws = stats.select(*WL, F.col("p25").alias("g_p25"), F.col("p50").alias("g_p50"),
                      F.col("p75").alias("g_p75"), F.col("std").alias("g_std"),
                      F.col("max").alias("g_max"))
    j = g.join(meta, "pattern_type").join(ws, WL).join(dmeans, WL, "left")
    avg = F.col("avg_replicas")
    n = F.col("sample_count")
    t = F.col("pattern_type")
    accepted = (F.when(t == "peak", avg >= F.coalesce(F.col("daily_mean"), F.lit(0.0)) * 0.8)
                 .when(t.isin("off-peak", "night"), avg <= F.col("g_p50"))
                 .when(t == "weekend",
                       F.abs(avg - F.coalesce(F.col("weekday_mean"), F.lit(0.0))) >= F.col("g_std") * 0.5)
                 .when(t.isin("morning", "evening"),
                       (n >= F.col("min_cells")) & (avg > F.col("g_p25")) & (avg < F.col("g_p75")))
                 .otherwise(F.lit(False)))
    single = F.when(F.col("min_cells") > 1, F.lit(0.5)).otherwise(F.lit(0.6))
    conf = F.when(n > 1, F.greatest(F.col("conf_floor"), 1 - F.col("_sd") / (avg + F.lit(1e-10)))) \
        .otherwise(single)
    return (j.where(accepted & (F.col("g_max") > 0))
             .withColumn("confidence", conf)
             .where(F.col("confidence") >= cfg.min_confidence)
             .select(*WL, "pattern_type", "det_order", "hours", "days", "avg_replicas", "min_replicas",
                     "max_replicas", F.col("_q")[0].alias("percentile_25"),
                     F.col("_q")[1].alias("percentile_75"), "confidence", "sample_count"))
