"""Scaling-trigger generation from detected patterns (profile-based and cluster-based)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.config import DEFAULT_TYPE_PRIORITY, TYPE_PRIORITY, WL, AnalysisConfig, DetectConfig
from tempora.functions.clock import clock_text, day_list_codes

TRIGGER_COLS = ["name", "pattern_type", "priority", "timezone", "start_time", "end_time", "recurring",
                "min_replicas", "max_replicas", "end_min_replicas", "end_max_replicas", "confidence"]


def _trunc(x: Column) -> Column:
    """Python ``int()`` of a non-negative double."""
    return x.cast("int")


def _type_priority(t: Column) -> Column:
    m = F.create_map(*[x for k, v in TYPE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, t), F.lit(DEFAULT_TYPE_PRIORITY))


def _v2_name(days: Column, hours: Column, t: Column) -> Column:
    day_ctx = (F.when(days == F.array(F.lit(5), F.lit(6)), F.lit("weekend"))
                .when(days == F.array(*[F.lit(i) for i in range(5)]), F.lit("weekday"))
                .otherwise(F.lit("custom")))
    h0 = hours[0]
    time_ctx = (F.when((h0 >= 22) | (h0 < 6), F.lit("night"))
                 .when(h0 < 9, F.lit("morning"))
                 .when(h0 < 12, F.lit("late-morning"))
                 .when(h0 < 17, F.lit("afternoon"))
                 .otherwise(F.lit("evening")))
    return F.concat_ws("-", day_ctx, time_ctx, t)


def patterns_to_triggers(patterns: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Detected patterns -> trigger rows, highest priority first, one per (days, start, end)."""
    buf = cfg.replica_buffer_percent
    min_r = F.greatest(F.lit(1), _trunc(F.col("min_replicas")))
    max_r = F.greatest(min_r + 2, _trunc(F.col("max_replicas") * (1 + buf)))
    burst = ((F.col("pattern_type") == "peak")
             & (F.col("percentile_75") > F.col("avg_replicas") * 1.2))
    max_r = F.when(burst, F.greatest(max_r, _trunc(F.col("max_replicas") * 1.5))).otherwise(max_r)
    if cfg.wrap_aware:
        end_h = F.element_at("hours", -1) + 1
        start_t = clock_text(F.col("hours")[0], F.lit(0))
        end_t = F.when(end_h >= 24, F.lit("23:59:59")).otherwise(clock_text(end_h, F.lit(0)))
    else:
        start_t = clock_text(F.array_min("hours"), F.lit(0))
        end_t = clock_text(F.least(F.array_max("hours") + 1, F.lit(23)), F.lit(0))
    t = patterns.select(
        *WL, "det_order",
        _v2_name(F.col("days"), F.col("hours"), F.col("pattern_type")).alias("name"),
        "pattern_type",
        _type_priority(F.col("pattern_type")).alias("priority"),
        F.lit(cfg.timezone).alias("timezone"),
        start_t.alias("start_time"), end_t.alias("end_time"),
        day_list_codes(F.col("days")).alias("recurring"),
        min_r.alias("min_replicas"), max_r.alias("max_replicas"),
        F.lit(1).alias("end_min_replicas"), F.greatest(F.lit(2), min_r).alias("end_max_replicas"),
        "confidence")
    w = Window.partitionBy(*WL, "recurring", "start_time", "end_time") \
        .orderBy(F.desc("priority"), F.asc("det_order"))
    return t.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*WL, *TRIGGER_COLS)


def default_triggers(stats: DataFrame, patterns: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Workloads with no accepted pattern: baseline row when there is no data, else
    business-hours and weekend rows from p25 and max with the buffer."""
    buf = cfg.replica_buffer_percent
    wl = stats.join(patterns.select(*WL).distinct(), WL, "left_anti")
    empty = F.coalesce(F.col("max"), F.lit(0.0)) == 0
    min_rep = F.greatest(F.lit(1), _trunc(F.col("p25") * (1 - buf)))
    max_rep = F.greatest(min_rep + 1, _trunc(F.col("max") * (1 + buf)))

    def row(name, ptype, prio, st, et, rec, mn, mx):
        return wl.select(*WL, F.lit(name).alias("name"), F.lit(ptype).alias("pattern_type"),
                         F.lit(prio).alias("priority"), F.lit(cfg.timezone).alias("timezone"),
                         F.lit(st).alias("start_time"), F.lit(et).alias("end_time"),
                         F.lit(rec).alias("recurring"), mn.alias("min_replicas"), mx.alias("max_replicas"),
                         F.lit(1).alias("end_min_replicas"),
                         F.greatest(F.lit(2), mn).alias("end_max_replicas"),
                         F.lit(0.5).alias("confidence"), empty.alias("_empty"))

    baseline = row("default-baseline", "weekday", 100, "09:00:00", "17:00:00", "M,TU,W,TH,F",
                   F.lit(2), F.lit(10)).where("_empty")
    business = row("default-business-hours", "peak", 100, "09:00:00", "17:00:00", "M,TU,W,TH,F",
                   min_rep, max_rep).where("NOT _empty")
    weekend = row("default-weekend", "weekend", 60, "00:00:00", "23:59:00", "SAT,SUN",
                  F.greatest(F.lit(1), F.floor(min_rep / 2).cast("int")),
                  F.greatest(F.lit(2), F.floor(max_rep / 2).cast("int"))).where("NOT _empty")
    return baseline.unionByName(business).unionByName(weekend).drop("_empty")


def v2_triggers(patterns: DataFrame, stats: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Generated triggers for every workload: pattern-based, or defaults when none was accepted."""
    return patterns_to_triggers(patterns, cfg).unionByName(default_triggers(stats, patterns, cfg))


# ---------------------------------------------------------------------------
# Cluster-based patterns -> triggers
# ---------------------------------------------------------------------------

def _v1_name(days: Column, start_hour: Column, avg: Column, idx: Column) -> Column:
    period = (F.when(days == F.array(*[F.lit(i) for i in range(5)]), F.lit("weekday"))
               .when(days == F.array(F.lit(5), F.lit(6)), F.lit("weekend"))
               .when(F.size(days) == 7, F.lit("daily"))
               .otherwise(F.concat(F.lit("custom-"), (idx + 1).cast("string"))))
    tod = (F.when(start_hour < 12, F.lit("morning"))
            .when(start_hour < 17, F.lit("afternoon"))
            .otherwise(F.lit("evening")))
    load = (F.when(avg > 5, F.lit("high-load"))
             .when(avg > 2, F.lit("normal-load"))
             .otherwise(F.lit("low-load")))
    return F.concat_ws("-", period, tod, load)


def v1_triggers(patterns: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Mined time patterns -> triggers.

    Rank by average replicas (descending, stable on pattern order); keep the
    ``max_triggers`` most confident when there are more; priorities are
    ``base - step * i`` in the kept order; repeated names get ``-2``, ``-3``...
    """
    buf = cfg.replica_buffer_percent
    by_load = Window.partitionBy(*WL).orderBy(F.desc("avg_replicas"), F.asc("pattern_id"))
    p = patterns.withColumn("_i", F.row_number().over(by_load) - 1)
    cnt = Window.partitionBy(*WL)
    p = p.withColumn("_n", F.count(F.lit(1)).over(cnt))
    by_conf = Window.partitionBy(*WL).orderBy(F.desc("confidence"), F.asc("_i"))
    p = p.withColumn("_c", F.row_number().over(by_conf) - 1)
    trimmed = F.col("_n") > cfg.max_triggers
    p = p.where(~trimmed | (F.col("_c") < cfg.max_triggers))
    p = p.withColumn("_pos", F.when(trimmed, F.col("_c")).otherwise(F.col("_i")))
    min_r = F.greatest(F.lit(1), _trunc(F.col("avg_replicas") * (1 - buf)))
    max_r = F.greatest(min_r + 1, _trunc(F.col("peak_replicas") * (1 + buf)))
    t = p.select(*WL, "_pos",
                 _v1_name(F.col("days"), F.col("start_hour"), F.col("avg_replicas"), F.col("_i")).alias("_base"),
                 (F.lit(cfg.base_priority) - F.col("_pos") * cfg.priority_step).alias("priority"),
                 F.lit(cfg.timezone).alias("timezone"),
                 clock_text(F.col("start_hour"), F.col("start_minute")).alias("start_time"),
                 clock_text(F.col("end_hour"), F.col("end_minute")).alias("end_time"),
                 day_list_codes(F.col("days")).alias("recurring"),
                 min_r.alias("min_replicas"), max_r.alias("max_replicas"),
                 F.lit(1).alias("end_min_replicas"), F.greatest(F.lit(3), min_r).alias("end_max_replicas"),
                 "confidence")
    w = Window.partitionBy(*WL, "_base").orderBy("_pos")
    t = t.withColumn("_k", F.row_number().over(w))
    name = F.when(F.col("_k") > 1, F.concat(F.col("_base"), F.lit("-"), F.col("_k").cast("string"))) \
        .otherwise(F.col("_base"))
    return t.select(*WL, name.alias("name"), F.lit("pattern").alias("pattern_type"), "priority", "timezone",
                    "start_time", "end_time", "recurring", "min_replicas", "max_replicas",
                    "end_min_replicas", "end_max_replicas", "confidence")


def v1_default_triggers(workloads: DataFrame, triggers: DataFrame,
                        cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Workloads with no mined pattern get the 09-17 weekday default."""
    wl = workloads.select(*WL).distinct().join(triggers.select(*WL).distinct(), WL, "left_anti")
    return wl.select(*WL, F.lit("default-business-hours").alias("name"), F.lit("default").alias("pattern_type"),
                     F.lit(100).alias("priority"), F.lit(cfg.timezone).alias("timezone"),
                     F.lit("09:00:00").alias("start_time"), F.lit("17:00:00").alias("end_time"),
                     F.lit("M,TU,W,TH,F").alias("recurring"), F.lit(2).alias("min_replicas"),
                     F.lit(10).alias("max_replicas"), F.lit(1).alias("end_min_replicas"),
                     F.lit(3).alias("end_max_replicas"), F.lit(0.5).alias("confidence"))
