"""Plan shape: no pair explosion, pruned scans, pushed filters; trigger trimming rules."""

import os

import pytest
from pyspark.sql import functions as F

from tempora.operators import resample as R
from tempora.operators import triggers as G
from tempora.sources import events as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    """The shape of plans over large tables: nothing is small enough to broadcast unless hinted."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_no_cartesian_or_nested_loop_joins(spark, no_broadcast):
    from tempora.plans.queries import REGISTRY

    for name, fn in REGISTRY.items():
        p = _plan(fn(spark, SF))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def _explained(spark, df) -> str:
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_raw_samples_are_scanned_once_and_dealt_by_bucket(spark, no_broadcast):
    for reduced in (R.counter_buckets(E.samples(spark, SF, ["cpu"])), R.resample(E.samples(spark, SF, ["memory"]))):
        text = _explained(spark, reduced)
        assert text.count("Scan parquet") == 2  # the node and its details
        dealt = [x for x in text.splitlines() if "hashpartitioning(" in x]
        assert len(dealt) == 1 and "bucket" in dealt[0] and "Join" not in text
    spread = R.best_source(R.source_counts(E.samples(spark, SF)))
    assert "events" not in _explained(spark, spread)  # the choice of a source reads the reduced rows


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_scans_are_pruned_and_filtered(spark):
    from tempora.plans.queries import REGISTRY

    text = _explained(spark, R.counter_buckets(E.samples(spark, SF, ["cpu"], as_of="2024-01-20 00:00:00", days=7)))
    assert "EqualTo(event_type,view)" in text
    assert "GreaterThanOrEqual(ts,2024-01-13T00:00)" in text and "LessThanOrEqual(ts,2024-01-20T00:00)" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    text = _explained(spark, E.replica_samples(spark, SF))
    assert "props" not in text and "event_id" not in text
    assert REGISTRY["hourly_profile"](spark, SF).columns


def test_v1_triggers_trim_priorities_and_names(spark):
    rows = []
    for i in range(12):
        rows.append(("n", "d", i, 9, 0, 17, 0, [0, 1, 2, 3, 4], 1.0, 1.0, float(20 - i), 25, 0.5 + i / 100.0))
    pats = spark.createDataFrame(rows, "namespace string, deployment string, pattern_id int, start_hour int, "
                                       "start_minute int, end_hour int, end_minute int, days array<int>, "
                                       "avg_cpu double, avg_memory double, avg_replicas double, "
                                       "peak_replicas int, confidence double")
    out = G.v1_triggers(pats).orderBy(F.desc("priority")).collect()
    assert len(out) == 10
    # kept: the 10 most confident (pattern ids 11..2), ordered by confidence, priorities 100, 90, ...
    assert [r["priority"] for r in out] == [100 - 10 * i for i in range(10)]
    assert [r["min_replicas"] for r in out][0] == int((20 - 11) * 0.8)
    names = [r["name"] for r in out]
    assert names[0] == "weekday-morning-high-load" and names[1] == "weekday-morning-high-load-2"
    assert len(set(names)) == 10
    assert out[0]["max_replicas"] == max(int((20 - 11) * 0.8) + 1, int(25 * 1.2))
    assert out[0]["end_max_replicas"] == max(3, int((20 - 11) * 0.8))
