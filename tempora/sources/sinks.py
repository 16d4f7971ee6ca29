"""Sinks: CSV samples, trigger JSON, policy documents, run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.config import WL
from tempora.sources.policies import trigger_struct


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header (one folder of part files; no single-file funnel)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def trigger_json(triggers: DataFrame) -> DataFrame:
    """One JSON text per generated trigger, in the policy's trigger format."""
    return triggers.select(*WL, "name", F.to_json(trigger_struct()).alias("trigger_json"))


def policy_documents(triggers: DataFrame, api_version: str = "tempora/v1") -> DataFrame:
    """One nested policy document per workload: triggers by priority (descending, then name).

    Defaults: namespace ``default`` when missing, HPA name ``<deployment>-hpa``. The
    per-workload trigger list is bounded (a handful of generated triggers).
    """
    ns = F.coalesce(F.nullif(F.col("namespace"), F.lit("")), F.lit("default"))
    t = triggers.select(*WL, F.struct((-F.col("priority")).alias("_np"), F.col("name").alias("_n"),
                                      trigger_struct().alias("t")).alias("e"))
    g = t.groupBy(*WL).agg(F.array_sort(F.collect_list("e")).alias("es"))
    doc = F.struct(
        F.lit(api_version).alias("apiVersion"),
        F.lit("ScalingSchedule").alias("kind"),
        F.struct(F.concat(F.col("deployment"), F.lit("-schedule")).alias("name"), ns.alias("namespace"))
        .alias("metadata"),
        F.struct(F.struct(F.concat(F.col("deployment"), F.lit("-hpa")).alias("name"), ns.alias("namespace"))
                 .alias("HPAObjectRef"),
                 F.transform("es", lambda e: e["t"]).alias("triggers")).alias("spec"))
    return g.select(*WL, F.size("es").alias("n_triggers"), F.to_json(doc).alias("document"))


def run_stats(sample_counts: DataFrame, patterns: DataFrame, triggers: DataFrame,
              replicas: DataFrame) -> DataFrame:
    """Per workload: points per metric, pattern and trigger counts, replica avg (2 dp), max/min (int)."""
    pts = (sample_counts.groupBy(*WL)
           .agg(*[F.sum(F.when(F.col("metric_type") == m, F.col("samples")).otherwise(0)).alias(f"{m}_points")
                  for m in ("cpu", "memory", "replicas")]))
    pc = patterns.groupBy(*WL).agg(F.count(F.lit(1)).alias("patterns"))
    tc = triggers.groupBy(*WL).agg(F.count(F.lit(1)).alias("triggers"))
    rs = (replicas.groupBy(*WL)
          .agg(F.round(F.avg("value"), 2).alias("avg_replicas"), F.max("value").cast("int").alias("max_replicas"),
               F.min("value").cast("int").alias("min_replicas"), F.count(F.lit(1)).alias("data_points")))
    return (rs.join(pts, WL, "left").join(pc, WL, "left").join(tc, WL, "left")
            .select(*WL, "data_points", "cpu_points", "memory_points", "replicas_points",
                    F.coalesce("patterns", F.lit(0)).alias("patterns"),
                    F.coalesce("triggers", F.lit(0)).alias("triggers"),
                    "avg_replicas", "max_replicas", "min_replicas"))


def pattern_report(patterns: DataFrame, series: DataFrame) -> DataFrame:
    """Per workload: the mined patterns as JSON (camelCase fields, loads to six decimals) plus
    data-point counts."""
    def fixed(c):
        return F.col(c).cast("decimal(24,6)")

    p = patterns.select(*WL, F.struct(
        F.col("pattern_id").alias("_id"),
        F.struct(F.col("start_hour").alias("startHour"), F.col("start_minute").alias("startMinute"),
                 F.col("end_hour").alias("endHour"), F.col("end_minute").alias("endMinute"),
                 F.col("days"), fixed("avg_cpu").alias("avgCpu"), fixed("avg_memory").alias("avgMemory"),
                 fixed("avg_replicas").alias("avgReplicas"), F.col("peak_replicas").alias("peakReplicas"),
                 fixed("confidence").alias("confidence")).alias("p")).alias("e"))
    pg = p.groupBy(*WL).agg(F.array_sort(F.collect_list("e")).alias("es"))
    counts = (series.groupBy(*WL)
              .agg(*[F.count(F.when(F.col("metric_type") == m, 1)).alias(n)
                     for m, n in (("cpu", "cpuDataPoints"), ("memory", "memoryDataPoints"),
                                  ("replicas", "replicaDataPoints"))]))
    j = counts.join(pg, WL, "left").withColumn("es", F.coalesce("es", F.array().cast(pg.schema["es"].dataType)))
    doc = F.struct(F.lit(True).alias("success"), F.transform("es", lambda e: e["p"]).alias("patterns"),
                   F.struct("cpuDataPoints", "memoryDataPoints", "replicaDataPoints",
                            F.size("es").alias("patternsDetected")).alias("stats"))
    return j.select(*WL, F.size("es").alias("patterns_detected"), F.to_json(doc).alias("report"))
