"""Timed transitions, policy versions in a running stream, and the value histogram."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tempora.config import WL
from tempora.operators import detect as D
from tempora.operators import profile as P
from tempora.operators import schedule as S
from tempora.operators import triggers as G
from tempora.sources.policies import triggers_frame
from tempora.streaming import histograms as H
from tempora.streaming import jobs as J
from tempora.streaming import windows as W

DAY = datetime(2024, 3, 20)  # a Wednesday
ALL = "M,TU,W,TH,F,SAT,SUN"


def trigger(name, priority, start, end, **more):
    return {"name": name, "priority": priority, "recurring": ALL, "start_time": f"{start}:00", "end_time": f"{end}:00", "start_min": 2, "start_max": 5, **more}


def arrays(spark, rows):
    return S.trigger_arrays(triggers_frame(spark, rows), spark)


def at(hours, minutes=0):
    return DAY + timedelta(hours=hours, minutes=minutes)


@pytest.mark.parametrize("zone, day", [("America/New_York", "2024-03-10"), ("Europe/Berlin", "2024-10-27"), ("Australia/Lord_Howe", "2024-04-07"), ("Asia/Tokyo", "2024-03-10")])
def test_changes_equal_the_winners_of_a_table(spark, zone, day):
    rows = [trigger("a", 10, "01:30", "02:30", timezone=zone, recurring="SAT,SUN,M"), trigger("b", 20, "02:10", "23:50", timezone=zone, recurring="SUN"),
            trigger("c", 5, "23:00", "01:45", timezone=zone, recurring="SAT, SUN,XX"), trigger("bad", 90, "soon", "02:00", timezone=zone),
            trigger("d", 30, "12:00", "12:20", timezone=zone, recurring=None, start_date=day, end_date="2024-12-01")]
    t0 = datetime.fromisoformat(day) - timedelta(days=1)
    span = spark.createDataFrame([("default", "app", t0, t0 + timedelta(days=4))], "namespace string, deployment string, t0 timestamp, t1 timestamp")
    want = [(r["from_ts"], r["active_name"]) for r in S.winner_changes(triggers_frame(spark, rows), span, spark).orderBy("from_ts").collect()]
    plan = arrays(spark, rows).select(W.plan_json(F.col("triggers")).alias("p")).first()["p"]
    epoch = lambda t: int((t - datetime(1970, 1, 1)).total_seconds())
    got = [(datetime(1970, 1, 1) + timedelta(seconds=x), now) for x, _, now in W.changes([(epoch(t0), plan)], epoch(t0) - 1, epoch(t0 + timedelta(days=4)), None, False)]
    assert got == want and len(got) > 6


def test_next_tick_and_versions():
    none = json.dumps([])
    one = json.dumps([{"name": "x", "priority": 1, "zone": "UTC", "start": 60, "end": 120, "gate": "recurring", "days": ["M"]}])
    assert W.next_tick([(0, none)], 10, days=2) == 10 + 2 * W.DAY
    assert W.next_tick([(0, none), (500, one)], 10) == 500
    monday = 4 * W.DAY  # 1970-01-05
    assert W.next_tick([(0, one)], monday) == monday + 3600
    assert list(W.changes([(0, none), (monday + 3700, one)], -1, monday + 9000, None, False)) == [
        (0, None, None), (monday + 3700, None, "x"), (monday + 7200, "x", None)]


def stream_of(spark, path, batches):
    """A stream with one micro-batch for each list of (ts, plan or None) rows, and a function to run it."""
    schema = J.POLICY_EVENT_SCHEMA
    spark.createDataFrame([], schema).write.parquet(f"{path}/in")
    out = J.timed_transitions(spark.readStream.schema(schema).parquet(f"{path}/in"), "10 minutes")
    seen = []
    for rows in batches:
        spark.createDataFrame([("default", "app", t, p) for t, p in rows], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        q = (out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        done = spark.read.schema(out.schema).parquet(f"{path}/out").orderBy("ts").collect()
        seen.append([(r["ts"], r["from_trigger"], r["to_trigger"]) for r in done])
    return seen


def test_changes_come_at_their_time_without_samples_near(spark, scratch):
    plan = arrays(spark, [trigger("day", 10, "09:00", "17:00"), trigger("top", 20, "11:00", "12:30")]).select(W.plan_json(F.col("triggers")).alias("p")).first()["p"]
    seen = stream_of(spark, scratch, [[(at(8), plan), (at(8, 5), None)], [(at(11, 30), None)], [(at(11, 20), None)], [(at(18), None)]])
    start = [(at(8), None, None)]
    assert seen[0] == []  # the watermark has not reached 08:00
    assert seen[1] == seen[2] == start + [(at(9), None, "day"), (at(11), "day", "top")]
    assert seen[3] == seen[2] + [(at(12, 30), "top", "day"), (at(17), "day", None)]


def test_a_version_published_later_acts_from_its_time(spark, scratch):
    text = lambda rows: arrays(spark, rows).select(W.plan_json(F.col("triggers")).alias("p")).first()["p"]
    old, new = text([trigger("old", 10, "09:00", "17:00")]), text([trigger("new", 10, "14:00", "20:00")])
    seen = stream_of(spark, scratch, [[(at(8), old)], [(at(12), None)], [(at(13), new), (at(12, 10), None)], [(at(16), None)],
                                      [(at(9), text([trigger("late", 99, "00:00", "23:59")])), (at(21), None)]])
    assert seen[1] == [(at(8), None, None), (at(9), None, "old")]
    assert seen[3] == seen[1] + [(at(13), "old", None), (at(14), None, "new")]
    assert seen[4] == seen[3] + [(at(20), "new", None)]  # a version from before the watermark is too late


def test_samples_meet_the_version_of_their_time(spark, scratch):
    none, one, two = F.lit("2024-03-21").cast("timestamp"), F.lit("2024-03-20 10:00:00").cast("timestamp"), F.lit("2024-03-20 12:00:00").cast("timestamp")
    path = f"{scratch}/versions"
    J.publish_policies(arrays(spark, [trigger("first", 10, "00:00", "23:59")]), one, 1, path)
    J.publish_policies(arrays(spark, [trigger("second", 10, "00:00", "13:00")]), two, 2, path)
    J.publish_policies(arrays(spark, [trigger("third", 10, "00:00", "13:00")]), two, 3, path)
    J.publish_policies(arrays(spark, [trigger("future", 10, "00:00", "23:59")]), none, 4, path)
    samples = spark.createDataFrame([("default", d, at(h), 1.0) for h in (9, 10, 11, 12, 14) for d in ("app", "bare")], J.SAMPLE_SCHEMA)
    got = {(r["deployment"], r["ts"].hour): (r["generation"], r["active_name"]) for r in J.active_versions(samples, spark.read.parquet(path)).collect()}
    assert [got["app", h] for h in (9, 10, 11, 12, 14)] == [(None, None), (1, "first"), (1, "first"), (3, "third"), (3, None)]
    assert all(got["bare", h] == (None, None) for h in (9, 10, 11, 12, 14))


def samples(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for i in range(2000):
        t = datetime(2024, 1, 1) + timedelta(minutes=15 * i)
        rows.append(("n", "d", t, float(3 + rng.integers(4) + 6 * (9 <= t.hour < 17))))
        rows.append(("n", "flat", t, 2.0))
    rows += [("n", "d", datetime(2024, 1, 3, 1, 1), 1e6), ("n", "d", datetime(2024, 1, 3, 1, 2), float("nan")), ("n", "d", datetime(2024, 1, 3, 1, 3), None),
             ("n", "d", datetime(2024, 1, 3, 1, 4), 0.0)]
    return spark.createDataFrame(rows, J.SAMPLE_SCHEMA)


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9), k


def test_statistics_of_counts_equal_those_of_samples(spark):
    x = samples(spark)
    counts = H.merge_counts(H.value_counts(x).unionByName(H.value_counts(x.limit(0))))
    c, k = P.clean(x), H.clean_counts(counts)
    rows = lambda df, *keys: {tuple(r[c] for c in (*WL, *keys)): [r[c] for c in sorted(df.columns) if c not in (*WL, *keys)] for r in df.collect()}
    close(rows(H.hourly_of_counts(k), "dow", "hour"), rows(P.hourly_profile(c), "dow", "hour"))
    close(rows(H.daily_of_counts(k), "dow"), rows(P.daily_profile(c), "dow"))
    close(rows(H.stats_of_counts(k)), rows(P.workload_stats(c)))
    stats = P.workload_stats(c)
    want = G.v2_triggers(D.detect(P.hourly_profile(c), stats, P.daily_means(P.daily_profile(c)), spark), stats)
    got = H.triggers_of_counts(counts, spark)
    keys = lambda df: sorted(tuple(str(v) for n, v in sorted(r.asDict().items()) if n != "confidence") for r in df.collect())
    assert keys(got) == keys(want) and got.count() > 0


def test_compaction_leaves_out_days_beyond_the_window(spark, scratch):
    x = samples(spark)
    for i, part in enumerate(x.randomSplit([0.5, 0.3, 0.2], 3)):
        H.value_counts(part).withColumn("batch_id", F.lit(i)).write.mode("append").partitionBy("batch_id").parquet(f"{scratch}/state")
    H.compact_histogram(spark, f"{scratch}/state", f"{scratch}/compact", as_of="2024-01-10", days=4)
    got = spark.read.parquet(f"{scratch}/compact")
    want = H.value_counts(x.where("ts >= '2024-01-06' and ts < '2024-01-11'"))
    key = lambda df: {(r["deployment"], str(r["day"]), r["hour"], r["value"]): r["n"] for r in df.collect()}
    assert key(got) == key(want) and {r[0] for r in got.select("batch_id").distinct().collect()} == {-1}


def test_refresh_writes_each_batch_once(spark, scratch):
    x = samples(spark).where("deployment = 'flat'")
    x.repartition(3).write.parquet(f"{scratch}/in")
    source = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    for _ in range(2):  # the second run finds nothing new
        H.histogram_refresh(source, f"{scratch}/state", f"{scratch}/log").awaitTermination()
    state = spark.read.parquet(f"{scratch}/state")
    assert state.select("batch_id").distinct().count() == 3 and state.agg(F.sum("n")).first()[0] == x.count()
