"""Streaming jobs (availableNow over a file stream) against the batch answers."""

import os

import pytest
from pyspark.sql import functions as F

from tempora.config import WL
from tempora.operators import profile as P
from tempora.operators import schedule as S
from tempora.sources import events as E
from tempora.sources import policies as PO
from tempora.sources.policies import triggers_frame
from tempora.streaming import jobs as J

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def stream_dirs(spark, tmp_path_factory):
    """Raw samples and 5-minute replica samples written as one parquet file per day (in time order)."""
    base = tmp_path_factory.mktemp("streams")
    ev = E.read_table(spark, SF, "events")
    raw = E.workload_samples(ev)
    rs = E.replica_signal(ev)
    for name, df in (("raw", raw), ("rs", rs)):
        (df.withColumn("day", F.to_date("ts")).repartition("day").sortWithinPartitions("ts")
         .write.partitionBy("day").parquet(str(base / f"{name}_src")))
    return base, raw, rs


def _stream(spark, path):
    return (spark.readStream.schema(J.SAMPLE_SCHEMA + ", day date").option("maxFilesPerTrigger", 4)
            .parquet(path).drop("day"))


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_resample_stream_matches_batch(spark, stream_dirs):
    base, raw, _ = stream_dirs
    out = _run(J.resample_stream(_stream(spark, str(base / "raw_src"))), "r1")
    batch = (raw.withColumn("b", F.window("ts", "5 minutes")["start"]).groupBy(*WL, "b")
             .agg(F.greatest(F.lit(0.0), F.max("value")).alias("value")))
    mx = raw.agg(F.max("ts")).first()[0]
    got = {(r["deployment"], r["ts"]): r["value"] for r in out.collect()}
    exp = {(r["deployment"], r["b"]): r["value"] for r in batch.collect()}
    assert got and set(got) <= set(exp)
    for k, v in got.items():
        assert exp[k] == v
    from datetime import timedelta
    emitted_all = {k for k in exp if k[1] + timedelta(minutes=15) <= mx}
    assert emitted_all <= set(got)


def test_profile_refresh_matches_batch(spark, stream_dirs, tmp_path):
    base, _, rs = stream_dirs
    q = J.profile_refresh(_stream(spark, str(base / "rs_src")), str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {(r["deployment"], r["dow"], r["hour"]): r for r in J.read_profile(spark, str(tmp_path / "state")).collect()}
    exp = {(r["deployment"], r["dow"], r["hour"]): r for r in P.hourly_profile(rs).collect()}
    assert got.keys() == exp.keys()
    for k in exp:
        assert got[k]["count"] == exp[k]["count"] and got[k]["max"] == exp[k]["max"]
        assert got[k]["avg"] == pytest.approx(exp[k]["avg"]) and got[k]["std"] == pytest.approx(exp[k]["std"],
                                                                                                abs=1e-6)


def test_active_trigger_and_transitions_stream(spark, stream_dirs):
    base, _, rs = stream_dirs
    wls = PO.workloads(rs)
    trig = PO.policy_triggers(spark, wls)
    arrays = S.trigger_arrays(trig, spark)
    act_stream = J.active_trigger_stream(_stream(spark, str(base / "rs_src")), arrays)
    got = {(r["deployment"], r["ts"]): r["active_name"] for r in _run(act_stream, "r3").collect()}
    batch = S.active_trigger(S.window_state(rs.select(*WL, "ts"), trig, spark), rs)
    exp = {(r["deployment"], r["ts"]): r["active_name"] for r in batch.collect()}
    assert got == exp
    tr = _run(J.transitions_stream(J.active_trigger_stream(_stream(spark, str(base / "rs_src")), arrays)), "r4")
    got_t = sorted((r["deployment"], r["ts"], r["from_trigger"], r["to_trigger"]) for r in tr.collect())
    exp_t = sorted((r["deployment"], r["ts"], r["from_trigger"], r["to_trigger"])
                   for r in S.trigger_transitions(batch).collect())
    assert got_t == exp_t


def test_deviation_alerts_one_per_interval(spark, stream_dirs):
    base, _, rs = stream_dirs
    rows = []
    for dep in [r["deployment"] for r in PO.workloads(rs).collect()]:
        ns = "ns-" + str(int(dep.split("-")[1]) % 3)
        rows.append(triggers_frame(spark, [{"name": "ai-peak-daily-09-17", "priority": 100,
                                            "recurring": "M,TU,W,TH,F,SAT,SUN", "start_time": "09:00:00",
                                            "end_time": "17:00:00", "start_min": 6, "start_max": 7}],
                                   namespace=ns, deployment=dep))
    trig = rows[0]
    for r in rows[1:]:
        trig = trig.unionByName(r)
    arrays = S.trigger_arrays(trig, spark)
    alerts = J.deviation_alerts(J.active_trigger_stream(_stream(spark, str(base / "rs_src")), arrays),
                                interval="1 hour")
    got = _run(alerts, "r5").collect()
    keys = [(r["deployment"], r["interval_start"]) for r in got]
    assert len(keys) == len(set(keys)) and keys
    dev = rs.where((F.hour("ts") >= 9) & (F.hour("ts") < 17) & ((F.col("value") < 6 * 0.8) | (F.col("value") > 7 * 1.2)))
    dev = dev.select("deployment", F.date_trunc("hour", "ts").alias("h"))
    closed = rs.agg(F.max("ts") - F.expr("INTERVAL 70 MINUTES")).first()[0]  # the last hour isn't over for the watermark
    exp = {(r["deployment"], r["h"]) for r in dev.collect() if r["h"] <= closed}
    assert set(keys) == exp


def test_one_alert_across_micro_batches(spark, tmp_path):
    """Two deviating samples of one hour, 50 minutes and several micro-batches apart, are one alert."""
    from datetime import datetime, timedelta

    t0 = datetime(2024, 3, 4, 10)
    schema = "namespace string, deployment string, ts timestamp, value double, active_name string, min_replicas int, max_replicas int"
    for i, minutes in enumerate((0, 15, 30, 50, 200)):
        spark.createDataFrame([("n", "d", t0 + timedelta(minutes=minutes), 99.0, "ai-x", 1, 2)], schema).coalesce(1).write.parquet(
            str(tmp_path / f"in/day={i}"))
    src = spark.readStream.schema(schema + ", day int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("day")
    got = _run(J.deviation_alerts(src, interval="1 hour"), "alerts_batches").collect()
    assert [(r["interval_start"], r["ts"]) for r in got] == [(t0, t0)]
    batch = J.deviation_alerts(spark.read.parquet(str(tmp_path / "in")).drop("day"), interval="1 hour").collect()
    assert sorted(r["interval_start"] for r in batch) == [t0, t0 + timedelta(hours=3)]


def test_transitions_are_ordered_across_chunks():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    t = [pd.Timestamp("2024-01-01 00:00") + pd.Timedelta(minutes=5 * i) for i in range(6)]
    chunk = lambda *rows: pd.DataFrame(rows, columns=["ts", "active_name"])
    state = State()
    out = next(J._transitions(("n", "d"), iter([chunk((t[2], "x"), (t[4], "y")), chunk((t[1], "x"), (t[3], None))]), state))
    assert out[["ts", "from_trigger", "to_trigger"]].values.tolist() == [[t[1], None, "x"], [t[3], "x", None], [t[4], None, "y"]]
    late = next(J._transitions(("n", "d"), iter([chunk((t[0], "z"), (t[5], "y"))]), state))
    assert len(late) == 0 and state.get == (t[5], "y")


def test_profile_window_and_large_means(spark):
    from datetime import datetime

    rows = [("n", "d", datetime(2024, 1, day, 5), 1e9 + day) for day in (1, 8, 15, 22)] + [("n", "d", datetime(2024, 1, 8, 5, 30), float("nan"))]
    parts = J.profile_partials(spark.createDataFrame(rows, J.SAMPLE_SCHEMA))
    r = J.merge_profile(parts).first()
    assert r["count"] == 4 and r["std"] == pytest.approx(7.826237921249264, rel=1e-9)
    r = J.merge_profile(parts, as_of="2024-01-22", days=10).first()
    assert r["count"] == 2 and r["std"] == pytest.approx(3.5)
