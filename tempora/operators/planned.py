"""The planned hour-of-day analyzer (specified in prose only; formulas here are our reading).

Hourly points -> minimum-data gate -> hour-of-day p50/p95 -> weekday/weekend
split decision -> contiguous peak windows (gaps and islands) -> ``ai-`` triggers,
skipped where a manual trigger overlaps by at least one hour -> deviation of
live replicas from the active generated trigger's bounds.

Every aggregate is keyed by workload plus hour (or day type), so no group can
grow with the raw data beyond span / 1 h points per workload.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.config import WL
from tempora.functions import clock as C
from tempora.functions.timeparts import bucket
from tempora.operators.schedule import prepare_triggers


@dataclass(frozen=True)
class PlannedConfig:
    min_points: int = 72
    peak_multiplier_percent: int = 150
    split_threshold_percent: int = 20
    deviation_threshold_percent: int = 20
    lookback_days: int = 14


DAY_TYPE_RECURRING = {"weekday": "M,TU,W,TH,F", "weekend": "SAT,SUN", "daily": "M,TU,W,TH,F,SAT,SUN"}


def hourly_points(samples: DataFrame) -> DataFrame:
    """One point per workload and hour: the last sample of the hour (a 1-hour step)."""
    return (samples.withColumn("hour_ts", bucket(F.col("ts"), 60))
            .groupBy(*WL, "hour_ts").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
            .withColumn("hour", F.hour("hour_ts"))
            .withColumn("day_type", F.when(F.weekday("hour_ts") >= 5, F.lit("weekend")).otherwise(F.lit("weekday"))))


def data_gate(points: DataFrame, cfg: PlannedConfig = PlannedConfig()) -> DataFrame:
    """Status per workload: enough hourly points to analyse, or InsufficientData."""
    g = points.groupBy(*WL).agg(F.count(F.lit(1)).alias("hourly_points"))
    ok = F.col("hourly_points") >= cfg.min_points
    return g.select(*WL, "hourly_points", ok.alias("sufficient"),
                    F.when(ok, F.lit("Analyzed")).otherwise(F.lit("InsufficientData")).alias("status"))


def hour_percentiles(points: DataFrame) -> DataFrame:
    """Per workload and hour of day: p50, p95 and point count."""
    return (points.groupBy(*WL, "hour")
            .agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"),
                 F.count(F.lit(1)).alias("n")))


def weekend_split(points: DataFrame, cfg: PlannedConfig = PlannedConfig()) -> DataFrame:
    """Weekday vs weekend p95; split when they differ by more than the threshold (% of weekday p95)."""
    wd = F.percentile(F.when(F.col("day_type") == "weekday", F.col("value")), F.lit(0.95))
    we = F.percentile(F.when(F.col("day_type") == "weekend", F.col("value")), F.lit(0.95))
    g = points.groupBy(*WL).agg(wd.alias("weekday_p95"), we.alias("weekend_p95"),
                                F.percentile("value", F.lit(0.5)).alias("overall_p50"))
    diff = F.when(F.col("weekday_p95") > 0,
                  F.abs(F.col("weekday_p95") - F.col("weekend_p95")) / F.col("weekday_p95") * 100)
    return g.select(*WL, "weekday_p95", "weekend_p95", "overall_p50", diff.alias("diff_pct"),
                    F.coalesce(diff > cfg.split_threshold_percent, F.lit(False)).alias("split"))


def peak_windows(points: DataFrame, cfg: PlannedConfig = PlannedConfig()) -> DataFrame:
    """Contiguous hours whose p95 exceeds the overall p50 x multiplier, per day type
    (weekday/weekend when split, else daily), as ``ai-`` triggers ranked by peak size. Workloads
    that don't pass the data gate have none; a peak of all 24 hours ends at 23:59:59."""
    split = weekend_split(points, cfg).select(*WL, "split", "overall_p50")
    enough = data_gate(points, cfg).where("sufficient").select(*WL)
    p = points.join(split.join(enough, WL), WL)
    p = p.withColumn("dtype", F.when(F.col("split"), F.col("day_type")).otherwise(F.lit("daily")))
    hp = (p.groupBy(*WL, "dtype", "hour", "overall_p50")
          .agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95")))
    peak = hp.where(F.col("p95") > F.col("overall_p50") * (cfg.peak_multiplier_percent / 100.0))
    w = Window.partitionBy(*WL, "dtype").orderBy("hour")
    isl = peak.withColumn("grp", F.col("hour") - F.row_number().over(w))
    g = (isl.groupBy(*WL, "dtype", "grp")
         .agg(F.min("hour").alias("start_hour"), (F.max("hour") + 1).alias("end_hour"),
              F.ceil(F.max("p50")).cast("int").alias("min_replicas"),
              F.ceil(F.max("p95")).cast("int").alias("max_replicas"),
              F.max("p95").alias("peak_p95")))
    rank = Window.partitionBy(*WL).orderBy(F.desc("peak_p95"), F.asc("dtype"), F.asc("start_hour"))
    rec = F.create_map(*[x for k, v in DAY_TYPE_RECURRING.items() for x in (F.lit(k), F.lit(v))])
    name = F.format_string("ai-peak-%s-%02d-%02d", F.col("dtype"), F.col("start_hour"), F.col("end_hour"))
    return g.select(*WL, name.alias("name"), F.col("dtype").alias("day_type"),
                    (F.lit(100) - (F.row_number().over(rank) - 1) * 10).alias("priority"),
                    F.try_element_at(rec, F.col("dtype")).alias("recurring"),
                    C.clock_text(F.col("start_hour"), F.lit(0)).alias("start_time"),
                    F.when((F.col("start_hour") == 0) & (F.col("end_hour") == 24), F.lit("23:59:59"))
                     .otherwise(C.clock_text(F.col("end_hour") % 24, F.lit(0))).alias("end_time"),
                    "min_replicas", F.greatest(F.col("max_replicas"), F.col("min_replicas")).alias("max_replicas"),
                    "peak_p95")


WEEK_MINUTES = 7 * 24 * 60
SHARED_MINUTES = 60  # of a week that make two windows overlap


def week_intervals(prepared: DataFrame, week) -> Column:
    """The minutes (UTC, from 0) of the week that begins on the date ``week`` in which a prepared
    trigger is Within, as an array of half-open intervals.

    A window that wraps midnight has two parts on each of its local days, by the day's own code; a
    dated trigger has those between its dates. Local clocks are turned into instants day by day, so
    zones and shifted clocks count. A trigger has at most two intervals for each of ten days.
    """
    zero = F.unix_seconds(F.lit(week).cast("timestamp"))
    days = F.sequence(F.date_sub(F.lit(week).cast("date"), 1), F.date_add(F.lit(week).cast("date"), 8))
    s, e = F.col("_s"), F.col("_e")
    part = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    parts = F.when(s < e, F.array(part(s, e))).when(s > e, F.array(part(F.lit(0), e), part(s, F.lit(1440)))).otherwise(none)
    first = F.when(F.col("_gate") == "range", F.floor((F.unix_seconds("_sd") - zero) / 60) + 1).otherwise(0)
    last = F.when(F.col("_gate") == "range", F.ceil((F.unix_seconds("_ed") - zero) / 60)).otherwise(WEEK_MINUTES)

    def instant(day: Column, minute: Column) -> Column:
        local = F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + minute * 60)
        return F.floor((F.unix_seconds(F.to_utc_timestamp(local, F.col("zone"))) - zero) / 60)

    def of_day(day: Column) -> Column:
        runs = F.when(F.col("_gate") == "recurring", F.array_contains("_codes", C.local_day_code(day.cast("timestamp")))).otherwise(
            F.col("_gate") == "range")
        own = F.transform(parts, lambda p: F.struct(F.greatest(instant(day, p["a"]), F.lit(0), first).alias("a"),
                                                    F.least(instant(day, p["b"]), F.lit(WEEK_MINUTES), last).alias("b")))
        return F.when(runs & F.col("_err").isNull(), own).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))

    return F.filter(F.flatten(F.transform(days, of_day)), lambda x: x["a"] < x["b"])


def manual_overlap(generated: DataFrame, manual: DataFrame, spark: SparkSession, week: str) -> DataFrame:
    """Generated triggers with a ``suppressed`` flag: a manual trigger (name without ``ai-``) of the
    same workload shares at least an hour of the week that begins on ``week`` with it, each window by
    its own zone, days and dates (no zone is UTC). A manual trigger without an interval or with an
    invalid clock is never Within and suppresses nothing."""
    def minutes(triggers: DataFrame) -> DataFrame:
        absent = {c: F.lit(v).cast(k) for c, v, k in (("has_interval", True, "boolean"), ("start_date", None, "string"),
                                                      ("end_date", None, "string")) if c not in triggers.columns}
        t = prepare_triggers(triggers.withColumns(absent), spark)
        return t.select(*WL, "name", week_intervals(t, week).alias("at"))

    g = minutes(generated)
    m = minutes(manual.where(~F.col("name").startswith("ai-"))).select(*WL, F.col("name").alias("m_name"), F.col("at").alias("m_at"))
    zero = F.lit(0).cast("long")
    shared = F.aggregate("at", zero, lambda n, x: n + F.aggregate(
        "m_at", zero, lambda k, y: k + F.greatest(zero, F.least(x["b"], y["b"]) - F.greatest(x["a"], y["a"]))))
    hit = F.coalesce(shared >= SHARED_MINUTES, F.lit(False))
    return (g.join(m, WL, "left").groupBy(*WL, "name")
            .agg(F.max(hit).alias("suppressed"), F.min(F.when(hit, F.col("m_name"))).alias("blocked_by")))


def deviation(samples: DataFrame, active: DataFrame, bounds: DataFrame,
              cfg: PlannedConfig = PlannedConfig()) -> DataFrame:
    """Samples whose value lies outside the active generated trigger's [min*(1-t), max*(1+t)].

    Skipped when the active trigger is manual (no ``ai-`` prefix) or none is active.
    """
    t = cfg.deviation_threshold_percent / 100.0
    j = (samples.join(active.where(F.col("active_name").startswith("ai-")), WL + ["ts"])
         .join(bounds, WL + ["active_name"]))
    out = (F.col("value") < F.col("min_replicas") * (1 - t)) | (F.col("value") > F.col("max_replicas") * (1 + t))
    return j.where(out).select(*WL, "ts", "active_name", "value", "min_replicas", "max_replicas")
