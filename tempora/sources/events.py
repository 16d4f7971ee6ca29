"""Metric samples derived from the ``events`` table.

Mapping (one definition, restated in the DuckDB oracle):

* workload: one per user, ``deployment = 'app-' || user_id``, ``namespace = 'ns-' || user_id % 3``, so
  the fleet grows with the table; pod ``'pod-' || event_id % 3``, container ``main``;
* metric source by event type: view -> CPU counter, click -> memory usage,
  signup -> memory working set (fallback), purchase -> deployment replicas,
  error -> HPA current replicas (fallback);
* a view stands for three scrapes of the counter, a minute apart, each a tenth of the value higher;
* replica signal per (workload, 5-minute bucket): ``3 + floor(sqrt(value))`` of the largest value.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.config import METRIC_SOURCES, WL
from tempora.functions.timeparts import bucket, series_id

# Fixed value: event type -> metric name of the sample it stands for.
EVENT_METRIC = {
    "view": "container_cpu_usage_seconds_total",
    "click": "container_memory_usage_bytes",
    "signup": "container_memory_working_set_bytes",
    "purchase": "kube_deployment_status_replicas",
    "error": "kube_horizontalpodautoscaler_status_current_replicas",
}

SCRAPES = 3  # counter samples that a view stands for


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _workload_cols() -> dict:
    user, event = F.col("user_id"), F.col("event_id")
    return {
        "namespace": F.concat(F.lit("ns-"), (user % 3).cast("string")),
        "deployment": F.concat(F.lit("app-"), user.cast("string")),
        "pod": F.concat(F.lit("pod-"), (event % 3).cast("string")),
        "container": F.lit("main"),
    }


def within(events: DataFrame, as_of: str | None, days: int | None) -> DataFrame:
    """Events in [as_of - days, as_of]; the raw column is compared with literals of its own type, so
    the filter reaches the scan. Without ``as_of`` all events."""
    if as_of is None:
        return events
    kind = "TIMESTAMP_NTZ" if dict(events.dtypes)["ts"] == "timestamp_ntz" else "TIMESTAMP"
    end = datetime.fromisoformat(as_of)
    low, high = [F.expr(f"{kind} '{x}'") for x in (end - timedelta(days=days or 0), end)]
    return events.where((F.col("ts") >= low if days is not None else F.lit(True)) & (F.col("ts") <= high))


def labels_col() -> F.Column:
    """Label map of a sample row (metric name, container, deployment, namespace, pod)."""
    return F.create_map(
        F.lit("__name__"), F.col("metric_name"),
        F.lit("container"), F.col("container"),
        F.lit("deployment"), F.col("deployment"),
        F.lit("namespace"), F.col("namespace"),
        F.lit("pod"), F.col("pod"),
    )


def event_types_for(metric_types) -> list[str]:
    """Event types whose samples feed the given metric types (all fallback sources included)."""
    names = {n for t, n, _ in METRIC_SOURCES if t in set(metric_types)}
    return [e for e, n in EVENT_METRIC.items() if n in names]


def metric_samples(events: DataFrame, metric_types=None) -> DataFrame:
    """Long-form samples: one row per event with workload labels and metric name.

    Columns: namespace, deployment, pod, container, metric_name, metric_type,
    src_rank, labels (map), series_id, ts (timestamp), value (double, NULL for NaN).
    ``metric_types`` restricts the read with a plain ``event_type IN (...)`` filter that
    reaches the parquet scan (row-group and partition pruning).
    """
    if metric_types:
        events = events.where(F.col("event_type").isin(event_types_for(metric_types)))
    name_map = F.create_map(*[x for k, v in EVENT_METRIC.items() for x in (F.lit(k), F.lit(v))])
    scrapes = F.when(F.col("event_type") == "view", F.sequence(F.lit(0), F.lit(SCRAPES - 1))).otherwise(F.array(F.lit(0)))
    src = events.select(
        F.col("event_id"), "ts", "value", F.explode(scrapes).alias("scrape"),
        *[c.alias(n) for n, c in _workload_cols().items()],
        F.try_element_at(name_map, F.col("event_type")).alias("metric_name"),
    ).where(F.col("metric_name").isNotNull()).select(
        "event_id", (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.col("scrape"))).alias("ts"),
        "namespace", "deployment", "pod", "container", "metric_name",
        F.when(F.isnan("value"), F.lit(None).cast("double"))
         .otherwise(F.col("value") + F.col("value") / 10 * F.col("scrape")).alias("value"))
    types = F.create_map(*[x for t, n, _ in METRIC_SOURCES for x in (F.lit(n), F.lit(t))])
    ranks = F.create_map(*[x for _, n, r in METRIC_SOURCES for x in (F.lit(n), F.lit(r))])
    return (src
            .withColumn("metric_type", F.try_element_at(types, F.col("metric_name")))
            .withColumn("src_rank", F.try_element_at(ranks, F.col("metric_name")))
            .withColumn("labels", labels_col())
            .withColumn("series_id", series_id(F.col("labels"))))


def replica_signal(events: DataFrame, step_minutes: int = 5) -> DataFrame:
    """Replica samples per (namespace, deployment, step bucket): max across series, floor 0.

    The group key includes the time bucket, so one hot workload is spread over
    all of its buckets and pre-aggregated map-side before the shuffle.
    """
    b = bucket(F.col("ts").cast("timestamp"), step_minutes)
    wd = _workload_cols()
    replicas = (F.floor(F.sqrt(F.greatest(F.col("value"), F.lit(0.0)))) + 3).cast("double")
    return (events
            .where(F.col("value").isNotNull() & ~F.isnan("value"))
            .select(wd["namespace"].alias("namespace"), wd["deployment"].alias("deployment"),
                    b.alias("ts"), replicas.alias("v"))
            .groupBy(*WL, "ts")
            .agg(F.greatest(F.lit(0.0), F.max("v")).alias("value")))


def replica_samples(spark: SparkSession, sf_dir: str, step_minutes: int = 5, as_of: str | None = None,
                    days: int | None = None) -> DataFrame:
    return replica_signal(within(read_table(spark, sf_dir, "events"), as_of, days), step_minutes)


def samples(spark: SparkSession, sf_dir: str, metric_types=None, as_of: str | None = None,
            days: int | None = None) -> DataFrame:
    return metric_samples(within(read_table(spark, sf_dir, "events"), as_of, days), metric_types)


def workload_samples(events: DataFrame) -> DataFrame:
    """Raw samples of a workload as streams carry them: ``namespace, deployment, ts, value``."""
    wd = _workload_cols()
    return events.select(wd["namespace"].alias("namespace"), wd["deployment"].alias("deployment"),
                         F.col("ts").cast("timestamp").alias("ts"), "value")
