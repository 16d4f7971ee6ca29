"""Sample resampling, source fallback, counter rates and the per-timestamp merge.

Raw samples are first reduced to one value per (series, step bucket): the
group key carries the bucket, so even a series holding a third of all rows is
spread over its buckets and combined map-side. Everything after that works on
at most ``span / step`` rows per series or workload, which bounds every
per-workload window below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.config import WL
from tempora.functions.timeparts import bucket
from tempora.session import materialize

SERIES = ["series_id"]


def lookback(samples: DataFrame, days: int, as_of) -> DataFrame:
    """Keep samples in ``[as_of - days, as_of]``. On raw tables filter with ``events.within`` instead,
    which compares the stored column."""
    end = F.lit(as_of).cast("timestamp")
    return samples.where(F.col("ts").between(end - F.expr(f"INTERVAL {days} DAYS"), end))


def select_labels(samples: DataFrame, equals: dict[str, str] | None = None,
                  prefixes: dict[str, str] | None = None) -> DataFrame:
    """Label selector: equality on labels, anchored prefix regex (``^(?:p.*)$``) on others."""
    cond = F.lit(True)
    for k, v in (equals or {}).items():
        cond = cond & (F.col("labels")[k] == F.lit(v))
    for k, v in (prefixes or {}).items():
        cond = cond & F.col("labels")[k].rlike("^(?:" + v + ".*)$")
    return samples.where(cond)


def best_source(reduced: DataFrame, keys: list[str] = WL + ["metric_type"]) -> DataFrame:
    """Per key, keep only the best-ranked source that has rows (first non-empty source wins).

    ``reduced`` holds rows that are already aggregated per source (with ``src_rank``). They are
    written once, so the raw samples are scanned once; the winning rank of each key is joined back.
    """
    r = materialize(reduced, "sources")
    best = r.groupBy(*keys).agg(F.min("src_rank").alias("_best"))
    return r.join(best, keys).where(F.col("src_rank") == F.col("_best")).drop("_best")


def source_counts(samples: DataFrame) -> DataFrame:
    """Samples and their sum per workload and metric source, with ``src_rank``."""
    return (samples.groupBy(*WL, "metric_type", "metric_name", "src_rank")
            .agg(F.count(F.lit(1)).alias("samples"), F.sum("value").alias("value_sum")))


def resample(samples: DataFrame, step_minutes: int = 5,
             keys: list[str] = WL + ["metric_type", "metric_name", "pod", "container", "series_id", "src_rank"]
             ) -> DataFrame:
    """One value per (series, step bucket): the latest sample in the bucket (equal instants:
    the larger value, so a retried task picks the same row)."""
    return (samples.where(F.col("value").isNotNull())
            .withColumn("bucket", bucket(F.col("ts"), step_minutes))
            .groupBy(*keys, "bucket")
            .agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("last_ts"),
                 F.count(F.lit(1)).alias("n_raw")))


SERIES_KEYS = WL + ["metric_type", "src_rank", "pod", "container", "series_id"]


def counter_buckets(samples: DataFrame, step_minutes: int = 5) -> DataFrame:
    """Per (series, step bucket): increase over the pairs inside the bucket, first and last sample.

    increase(sample) = v - prev if v >= prev else v (counter reset). Pairs are ordered within
    (series, bucket) partitions, so no window holds a whole series of raw rows.
    """
    keys = SERIES_KEYS + ["bucket"]
    s = samples.where(F.col("value").isNotNull()).withColumn("bucket", bucket(F.col("ts"), step_minutes))
    prev = F.lag("value").over(Window.partitionBy(*keys).orderBy("ts", "value"))  # value breaks equal instants
    inc = F.when(prev.isNull(), F.lit(None)).when(F.col("value") >= prev, F.col("value") - prev) \
        .otherwise(F.col("value"))
    return (s.withColumn("_inc", inc).groupBy(*keys)
            .agg(F.sum("_inc").alias("inc_in"),
                 F.min_by("value", F.struct("ts", "value")).alias("first_v"), F.min("ts").alias("first_ts"),
                 F.max_by("value", F.struct("ts", "value")).alias("last_v"), F.max("ts").alias("last_ts")))


def counter_rate(buckets: DataFrame, range_minutes: int = 5) -> DataFrame:
    """Reset-aware per-second rate of a counter per series and step bucket, from ``counter_buckets``.

    The rate of a bucket is the increase of the samples landing in it over their time. The step
    from the last sample before the bucket counts if that sample is at most ``range_minutes`` old;
    a wider gap is no pair, so nothing is bridged. No extrapolation to bucket edges.
    """
    ws = Window.partitionBy(*SERIES_KEYS).orderBy("bucket")
    before = F.lag("last_ts").over(ws)
    near = F.unix_micros("first_ts") - F.unix_micros(before) <= range_minutes * 60_000_000
    pv, pts = F.when(near, F.lag("last_v").over(ws)), F.when(near, before)
    cross = F.when(pv.isNull(), F.lit(None)).when(F.col("first_v") >= pv, F.col("first_v") - pv) \
        .otherwise(F.col("first_v"))
    start = F.coalesce(pts, F.col("first_ts"))
    secs = (F.unix_micros(F.col("last_ts")) - F.unix_micros(start)) / F.lit(1e6)
    total = F.coalesce(F.col("inc_in"), F.lit(0.0)) + F.coalesce(cross, F.lit(0.0))
    has_pair = F.col("inc_in").isNotNull() | cross.isNotNull()
    return (buckets.select(*SERIES_KEYS, "bucket", F.when(has_pair & (secs > 0), total / secs).alias("rate"))
            .where(F.col("rate").isNotNull()))


def sliding_rate(buckets: DataFrame, step_minutes: int = 5, range_minutes: int = 30) -> DataFrame:
    """Reset-aware per-second rate over a range of several steps, per series and step bucket.

    A fold of ``counter_buckets`` summaries: each bucket adds the increase and the time of its own
    pairs and of the pair that leads into it (if that is at most ``range_minutes`` long), and the rate
    of a bucket is the sum of increases over the sum of times of the buckets in its range. No raw
    row is read twice, whatever the range. With a range of one step it equals ``counter_rate``.
    """
    if range_minutes % step_minutes:
        raise ValueError("the range must be a multiple of the step")
    ws = Window.partitionBy(*SERIES_KEYS).orderBy("bucket")
    before, last = F.lag("last_ts").over(ws), F.lag("last_v").over(ws)
    gap = F.unix_micros("first_ts") - F.unix_micros(before)
    near = F.coalesce(gap <= range_minutes * 60_000_000, F.lit(False))
    cross = F.when(F.col("first_v") >= last, F.col("first_v") - last).otherwise(F.col("first_v"))
    own = buckets.select(*SERIES_KEYS, "bucket",
                         F.when(near | F.col("inc_in").isNotNull(), F.coalesce("inc_in", F.lit(0.0)) + F.when(near, cross).otherwise(0.0)).alias("inc"),
                         (F.unix_micros("last_ts") - F.unix_micros("first_ts") + F.when(near, gap).otherwise(0)).alias("micros"))
    wide = (Window.partitionBy(*SERIES_KEYS).orderBy(F.unix_seconds("bucket"))
            .rangeBetween(-(range_minutes - step_minutes) * 60, 0))
    inc, micros = F.sum("inc").over(wide), F.sum("micros").over(wide)
    return (own.select(*SERIES_KEYS, "bucket", F.when(inc.isNotNull() & (micros > 0), inc / (micros / F.lit(1e6))).alias("rate"))
            .where(F.col("rate").isNotNull()))


def sum_by_pod(series: DataFrame, value: str = "value") -> DataFrame:
    """``sum(...) by (namespace, pod, container)`` per bucket (deployment kept as the workload key)."""
    return (series.groupBy(*WL, "pod", "container", "bucket")
            .agg(F.sum(value).alias("value")))


def per_timestamp_stats(series: DataFrame, metric_type: str | None = None) -> DataFrame:
    """Across the series of a workload at one bucket: mean, max, min, sample std (one series -> NULL)."""
    keys = WL + (["metric_type"] if metric_type is None else [])
    return (series.groupBy(*keys, "bucket")
            .agg(F.avg("value").alias("mean"), F.max("value").alias("max"),
                 F.min("value").alias("min"), F.stddev_samp("value").alias("std")))


def max_per_timestamp(series: DataFrame) -> DataFrame:
    """Across series at one bucket: the maximum, floored at 0."""
    return (series.groupBy(*WL, "bucket")
            .agg(F.greatest(F.lit(0.0), F.max("value")).alias("value")))


METRICS = ["cpu", "memory", "replicas"]
STATS = ["mean", "max", "min", "std"]


def v1_series(samples, step_minutes: int = 5) -> DataFrame:
    """The three metric series sets of each workload, one value per (series, bucket):
    CPU = counter rate summed by pod; memory = usage summed by pod (working set as
    fallback); replicas = gauge (three fallback sources).

    ``samples`` is a DataFrame of all samples, or a loader ``metric_type -> DataFrame``
    so each branch reads only its own sources (filter pushed to the scan).
    """
    def load(t):
        return samples(t) if callable(samples) else samples.where(F.col("metric_type") == t)

    cpu = counter_rate(best_source(counter_buckets(load("cpu"), step_minutes)))
    cpu = sum_by_pod(cpu, "rate").withColumn("metric_type", F.lit("cpu"))
    mem = best_source(resample(load("memory"), step_minutes))
    mem = sum_by_pod(mem).withColumn("metric_type", F.lit("memory"))
    rep = best_source(resample(load("replicas"), step_minutes))
    rep = rep.select(*WL, "pod", "container", "bucket", "value").withColumn("metric_type", F.lit("replicas"))
    return cpu.unionByName(mem).unionByName(rep)


def merged_frame(series: DataFrame, fill: bool = True) -> DataFrame:
    """Per workload and bucket: ``<metric>_<stat>`` for cpu, memory and replicas.

    One conditional aggregate (the outer merge of the three per-metric tables
    without three joins), then forward fill and backward fill in time order.
    """
    cols = []
    for m in METRICS:
        v = F.when(F.col("metric_type") == m, F.col("value"))
        cols += [F.avg(v).alias(f"{m}_mean"), F.max(v).alias(f"{m}_max"),
                 F.min(v).alias(f"{m}_min"), F.stddev_samp(v).alias(f"{m}_std")]
    wide = series.groupBy(*WL, "bucket").agg(*cols)
    return ffill_bfill(wide, [f"{m}_{s}" for m in METRICS for s in STATS]) if fill else wide


def ffill_bfill(df: DataFrame, cols: list[str], order: str = "bucket") -> DataFrame:
    """Forward fill then backward fill every column, per workload in time order.

    Both fills are running frames (unbounded preceding .. current row); the
    backward fill runs over descending time. A frame ending at unbounded
    following would be re-evaluated per row (quadratic in the partition).
    """
    fw = Window.partitionBy(*WL).orderBy(F.col(order).asc()).rowsBetween(Window.unboundedPreceding, 0)
    bw = Window.partitionBy(*WL).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[c for c in df.columns if c not in cols],
                     *[F.coalesce(F.last(c, True).over(fw), F.last(c, True).over(bw)).alias(c) for c in cols])


def unified_timestamps(series: DataFrame) -> DataFrame:
    """Distinct buckets per workload over all metric types."""
    return series.select(*WL, "bucket").distinct()
