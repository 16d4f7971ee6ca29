"""A workload holding a third of all rows is reduced before any per-workload work."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tempora.operators import resample as R
from tempora.sources import events as E


def _events(spark, n=30000):
    t0 = datetime(2024, 3, 4)
    rows = []
    for i in range(n):
        user = 0 if i % 3 == 0 else 1 + (i % 97)        # user 0 (workload app-0) holds a third of the rows
        rows.append((i, t0 + timedelta(seconds=(i * 7) % 86400), user, "purchase", float(i % 300), "{}"))
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, "
                                       "value double, props string")


def test_hot_workload_is_bounded_after_the_step_reduction(spark):
    ev = _events(spark)
    rs = E.replica_signal(ev)
    per_wl = {r["deployment"]: r["n"] for r in rs.groupBy("deployment").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(per_wl.values()) <= 24 * 12                # one day of 5-minute buckets, however hot
    plan = rs._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan                          # combined map-side before the shuffle
    assert "hashpartitioning(namespace" in plan and "ts#" in plan.split("hashpartitioning(")[1].split(")")[0]


def test_hot_series_counter_rate_orders_within_buckets(spark):
    samples = E.metric_samples(_events(spark).withColumn("event_type", F.lit("view")))
    buckets = R.counter_buckets(samples)
    rate = R.counter_rate(buckets)
    plan = buckets._jdf.queryExecution().executedPlan().toString()
    first_window = [ln for ln in plan.splitlines() if "Window [" in ln and "lag(" in ln][-1]
    assert "bucket" in first_window.split("windowspecdefinition(")[1]   # raw rows ordered per (series, bucket)
    assert rate.groupBy("series_id", "bucket").count().where("count > 1").count() == 0
