"""Sources and sinks: matrix documents, CSV, policy documents, counter rates, fallback."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tempora.operators import resample as R
from tempora.sources import matrix as MX
from tempora.sources import policies as PO
from tempora.sources import sinks as SK


def test_matrix_file_read(spark, scratch):
    doc = {"status": "success", "data": {"resultType": "matrix", "result": [
        {"metric": {"namespace": "ns", "deployment": "web", "pod": "web-1", "__name__": "kube_deployment_status_replicas"},
         "values": [[1710928800, "3"], [1710929100, "NaN"], [1710929400, "junk"], [1.7109297E9, "5"]]},
        {"metric": {"namespace": "ns", "deployment": "web", "pod": "web-2", "__name__": "kube_deployment_status_replicas"},
         "values": [[1710928800, "4"], [1710929700, "-2"]]},
        {"metric": {"namespace": "ns", "deployment": "web", "pod": "web-3"}, "values": []}]}}
    path = os.path.join(scratch, "m.json")
    with open(path, "w") as fh:
        fh.write(json.dumps(doc) + "\n")
    rows = MX.matrix_to_samples(MX.read_matrix_files(spark, path)).collect()
    assert len(rows) == 6
    vals = sorted((r["pod"], r["ts"].isoformat(), r["value"]) for r in rows)
    assert ("web-1", "2024-03-20T10:05:00", None) in vals and ("web-1", "2024-03-20T10:10:00", None) in vals
    assert rows[0]["series_id"].startswith("__name__=kube_deployment_status_replicas_deployment=web")
    rep = {r["ts"].isoformat(): r["value"] for r in MX.matrix_replicas(MX.matrix_to_samples(
        MX.read_matrix_files(spark, path))).collect()}
    assert rep == {"2024-03-20T10:00:00": 4.0, "2024-03-20T10:15:00": 5.0}


def test_matrix_write_read_roundtrip(spark, scratch):
    t0 = datetime(2024, 3, 20, 23, 50)
    rows = [("ns", "web", "web-1", "m", f"s{i % 2}", t0 + timedelta(minutes=5 * i), float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "namespace string, deployment string, pod string, metric_name string, "
                                     "series_id string, ts timestamp, value double")
    df = df.withColumn("labels", F.create_map(F.lit("namespace"), F.col("namespace"), F.lit("deployment"),
                                              F.col("deployment"), F.lit("pod"), F.col("series_id")))
    docs = MX.samples_to_documents(df, value_format="%d")
    assert docs.count() == 4  # two series x two UTC days
    MX.write_documents(docs, os.path.join(scratch, "docs"))
    back = MX.matrix_to_samples(MX.read_matrix_files(spark, os.path.join(scratch, "docs")))
    got = sorted((r["pod"], r["ts"], r["value"]) for r in back.collect())
    assert got == sorted((s, t, v) for *_, s, t, v in rows)


def test_csv_sink_roundtrip(spark, scratch):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    p = os.path.join(scratch, "csv")
    SK.write_csv(df, p)
    back = spark.read.option("header", True).schema("k string, v double").csv(p)
    assert sorted(back.collect()) == sorted(df.collect())


def test_policy_documents_read(spark, scratch):
    docs = [{"metadata": {"name": "p1", "namespace": "prod", "generation": 3},
             "spec": {"HPAObjectRef": {"name": "web-hpa"},
                      "triggers": [{"name": "a", "priority": 10, "startTime": "09:00:00", "endTime": "17:00:00",
                                    "interval": {"recurring": "M,TU"}, "startHPAConfig": {"minReplicas": 2}},
                                   {"name": "b", "suspend": True, "startTime": "00:00:00", "endTime": "01:00:00"}]}}]
    p = os.path.join(scratch, "pol.json")
    with open(p, "w") as fh:
        fh.write("\n".join(json.dumps(d) for d in docs))
    t = PO.explode_policy_documents(PO.read_policy_documents(spark, p)).collect()
    assert len(t) == 1
    r = t[0]
    assert (r["name"], r["hpa_target_namespace"], r["start_min"], r["start_max"], r["has_interval"]) == \
        ("a", "prod", 2, None, True)


def test_generated_policy_document(spark):
    trig = spark.createDataFrame(
        [("", "web", "b", 50, "UTC", "00:00:00", "09:00:00", "M", 1, 3, 1, 2),
         ("", "web", "a", 100, "UTC", "09:00:00", "17:00:00", "M", 3, 9, 1, 3)],
        "namespace string, deployment string, name string, priority int, timezone string, start_time string, "
        "end_time string, recurring string, min_replicas int, max_replicas int, end_min_replicas int, "
        "end_max_replicas int")
    d = json.loads(SK.policy_documents(trig).first()["document"])
    assert d["metadata"] == {"name": "web-schedule", "namespace": "default"}
    assert d["spec"]["HPAObjectRef"] == {"name": "web-hpa", "namespace": "default"}
    assert [x["name"] for x in d["spec"]["triggers"]] == ["a", "b"]
    assert d["spec"]["triggers"][0]["startHPAConfig"] == {"minReplicas": 3, "maxReplicas": 9}


COUNTER = ("namespace string, deployment string, metric_type string, src_rank int, pod string, container string, "
           "series_id string, ts timestamp, value double")


def counter(spark, vals):
    t0 = datetime(2024, 1, 1, 0, 0, 0)
    return spark.createDataFrame([("n", "d", "cpu", 0, "p", "c", "s", t0 + timedelta(seconds=s), v) for s, v in vals], COUNTER)


def test_counter_rate_with_reset(spark):
    df = counter(spark, [(0, 10.0), (60, 20.0), (120, 5.0), (360, 15.0)])  # reset at 120 s; next bucket at 360 s
    got = {r["bucket"].minute: r["rate"] for r in R.counter_rate(R.counter_buckets(df)).collect()}
    # bucket 00:00: +10 then reset (+5) over 120 s; bucket 00:05: +10 over 240 s
    assert got[0] == pytest.approx(15 / 120) and got[5] == pytest.approx(10 / 240)


def test_counter_rate_bridges_no_gap(spark):
    days = 3 * 86400
    df = counter(spark, [(0, 10.0), (60, 20.0), (days, 500.0), (days + 30, 503.0), (2 * days, 900.0), (2 * days + 301, 901.0)])
    got = {r["bucket"]: r["rate"] for r in R.counter_rate(R.counter_buckets(df)).collect()}
    assert sorted(got.values()) == [pytest.approx(3 / 30), pytest.approx(10 / 60)]  # neither three days nor 301 seconds
    wide = R.counter_rate(R.counter_buckets(df), range_minutes=6).collect()
    assert pytest.approx(1 / 301) in [r["rate"] for r in wide]


def test_best_source_first_non_empty(spark):
    rows = [("n", "d", "replicas", 1, 1.0), ("n", "d", "replicas", 2, 2.0), ("n", "e", "replicas", 0, 3.0),
            ("n", "e", "replicas", 1, 4.0)]
    df = spark.createDataFrame(rows, "namespace string, deployment string, metric_type string, src_rank int, "
                                     "value double")
    got = sorted((r["deployment"], r["value"]) for r in R.best_source(df).collect())
    assert got == [("d", 1.0), ("e", 3.0)]


def test_label_selector_prefix_is_anchored(spark):
    df = spark.createDataFrame([({"pod": "web-1", "namespace": "a"},), ({"pod": "xweb-1", "namespace": "a"},),
                                ({"pod": "web-2", "namespace": "b"},)], "labels map<string,string>")
    got = R.select_labels(df, {"namespace": "a"}, {"pod": "web"}).collect()
    assert [r["labels"]["pod"] for r in got] == ["web-1"]


def test_zone_misplaced_under_interval_is_reported(spark, scratch):
    from tempora.operators import schedule as S

    doc = {"metadata": {"name": "p", "namespace": "ns"},
           "spec": {"HPAObjectRef": {"name": "h"},
                    "triggers": [{"name": "x", "priority": 1, "startTime": "09:00:00", "endTime": "10:00:00",
                                  "interval": {"recurring": "M", "timezone": "America/Los_Angeles"}}]}}
    p = os.path.join(scratch, "p.json")
    with open(p, "w") as fh:
        fh.write(json.dumps(doc))
    t = PO.explode_policy_documents(PO.read_policy_documents(spark, p))
    assert t.first()["timezone"] is None  # the misplaced zone does not apply
    rules = [r["rule"] for r in S.trigger_validation(t, spark).collect()]
    assert rules == ["zone_under_interval"]


def test_checkpoint_folder_is_shared_and_released(spark, monkeypatch):
    import os

    import pytest

    from tempora import session as SE

    t = SE.materialize(spark.range(5), "kept")
    path = t.inputFiles()[0].removeprefix("file://").removeprefix("file:").rsplit("/", 1)[0]
    assert t.count() == 5 and os.path.isdir(path)
    assert SE.release(spark) >= 1 and not os.path.exists(path) and SE.release(spark) == 0
    assert SE.is_machine_local("/tmp/x") and SE.is_machine_local("file:/x") and not SE.is_machine_local("s3://b/x")
    assert not SE.is_machine_local("/tmp/x", "hdfs://n:1/")

    class Cluster:
        """A session whose master is a cluster and whose folder is one machine's."""
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(key, default=None):
                return "/tmp/checkpoints" if key == "spark.checkpoint.dir" else default

    with pytest.raises(RuntimeError, match="shared folder"):
        SE.checkpoint_dir(Cluster)


def spark_home(scratch):
    """Links to Spark's files, beside which the executors of a local cluster work: the files' own folder may not be writable."""
    import os

    import pyspark

    home, files = f"{scratch}/home", os.path.dirname(pyspark.__file__)
    os.makedirs(f"{home}/work")
    for x in os.listdir(files):
        if x != "work":
            os.symlink(f"{files}/{x}", f"{home}/{x}")
    return home


UNSET = '''
import datetime, sys
from tempora.session import build_session, checkpoint_dir, materialize, release
from __spark_entry__ import queries

master, scratch = sys.argv[1:]
spark = build_session(master, 2, extra={"spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.executor.memory": "512m", "spark.driver.host": "127.0.0.1"})
assert not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir()
start, kinds = datetime.datetime(2024, 1, 1), ["view", "click", "signup", "purchase", "error"]
rows = [(i, start + datetime.timedelta(minutes=7 * i), i % 4, kinds[i % 5], float(i % 9)) for i in range(60)]
spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{scratch}/data/events.parquet")
print("rows", *[queries()[q](spark, f"{scratch}/data").count() for q in ("hourly_profile", "counter_rate_sum", "dangling_refs")])
tables = [materialize(spark.range(5)) for _ in range(3)]
assert [t.count() for t in tables] == [5, 5, 5]
folder = checkpoint_dir(spark)
assert len({t.inputFiles()[0].rsplit("/", 2)[0] for t in tables}) == 1 and checkpoint_dir(spark) == folder  # no nested folders
assert ("/warehouse/" in folder) == ("cluster" in master), folder
assert release(spark) >= 3
spark.stop()
'''


@pytest.mark.parametrize("master", ["local[2]", "local-cluster[1,1,1024]"])
def test_queries_run_where_no_checkpoint_folder_is_set(scratch, master):
    """Spark fixes spark.checkpoint.dir when a session starts, so a session without it goes on without it."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.makedirs(f"{scratch}/conf")
    env = os.environ | {"SPARK_CONF_DIR": f"{scratch}/conf", "SPARK_HOME": spark_home(scratch), "SPARK_WORKER_DIR": f"{scratch}/work", "SPARK_LOCAL_DIRS": f"{scratch}/local", "SPARK_LOCAL_IP": "127.0.0.1",
                        "SPARK_SCALA_VERSION": "2.13", "TMPDIR": scratch, "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if not k.startswith(("PYSPARK_GATEWAY", "PYSPARK_SUBMIT", "SPARK_ENV_LOADED"))}
    run = subprocess.run([sys.executable, "-c", UNSET, master, scratch], env=env, cwd=scratch, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-3000:]
    assert [int(x) > 0 for x in run.stdout.split("rows")[1].split()] == [True, True, True]


def test_folder_of_a_mount_is_used_on_a_cluster(spark, monkeypatch):
    """A path without a store's name may be a mount that all machines share: it is tried, not refused."""
    import glob
    import os
    from weakref import WeakKeyDictionary

    from pyspark.sql.readwriter import DataFrameWriter

    from tempora import session as SE

    monkeypatch.setattr(SE, "_FOLDERS", WeakKeyDictionary(), raising=False)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert SE.checkpoint_dir(spark) == folder and not glob.glob(f"{folder}/tables/tried-*")
    rows = spark.range(0, 6, 1, 3).selectExpr("id", "if(id = 2, null, cast(id as string)) AS s")
    assert sorted(map(tuple, SE.materialize(rows).collect())) == sorted(map(tuple, rows.collect()))
    assert SE.materialize(rows.where("id < 0")).columns == ["id", "s"] and SE.materialize(rows.where("id < 0")).count() == 0
    write = DataFrameWriter.parquet

    def lossy(self, path, *a, **b):
        write(self, path, *a, **b)
        os.remove(min(glob.glob(f"{path}/part-*")))

    monkeypatch.setattr(DataFrameWriter, "parquet", lossy)
    with pytest.raises(RuntimeError, match="holds 4 of 6 rows"):
        SE.materialize(rows)
    assert "were found again" in SE.no_tables(spark, folder)


def test_folder_that_cannot_be_written_is_passed_over(spark, scratch, monkeypatch):
    from weakref import WeakKeyDictionary

    from tempora import session as SE

    open(f"{scratch}/file", "w").close()

    class Session:
        """The test's session with settings and a master of its own."""
        def __init__(self, of, **own):
            self.__dict__.update(own, of=of)

        def __getattr__(self, name):
            return getattr(self.of, name)

    def session(master, **folders):
        settings = {f"spark.{k.replace('_', '.')}": v for k, v in folders.items()}
        return Session(spark, sparkContext=Session(spark.sparkContext, master=master), conf=Session(spark.conf, get=lambda k, d=None: settings.get(k, d)))

    monkeypatch.setenv("TMPDIR", f"{scratch}/none")  # no such folder
    with pytest.warns(UserWarning, match="/file/kept"):
        assert SE.checkpoint_dir(session("spark://host:7077", checkpoint_dir=f"{scratch}/file/kept", sql_warehouse_dir=f"{scratch}/tables")) == f"{scratch}/tables/checkpoints"
    with pytest.raises(RuntimeError, match="shared folder"):
        SE.checkpoint_dir(session("spark://host:7077", checkpoint_dir=f"{scratch}/file/kept", sql_warehouse_dir=f"{scratch}/file/tables"))
    with pytest.warns(UserWarning, match="/file/kept"):
        local = session("local[4]", checkpoint_dir=f"{scratch}/file/kept")
        folder = SE.checkpoint_dir(local)
    assert "tempora-ckpt-" in folder and SE.checkpoint_dir(local) == folder


UNSHARED = '''
import sys
from tempora.session import build_session, checkpoint_dir, materialize

scratch = sys.argv[1]
spark = build_session("local-cluster[2,1,1024]", 2, extra={"spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.checkpoint.dir": "/proc/self/cwd/kept",
                      "spark.executor.memory": "512m", "spark.driver.host": "127.0.0.1"})
print("folder", checkpoint_dir(spark))
print("rows", materialize(spark.range(0, 50, 1, 4)).count())
spark.stop()
'''


def test_folder_that_executors_do_not_share_is_passed_over(scratch):
    """Each process has a folder of its own behind /proc/self/cwd: what executors write there, the driver never sees."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.makedirs(f"{scratch}/conf")
    env = os.environ | {"SPARK_CONF_DIR": f"{scratch}/conf", "SPARK_HOME": spark_home(scratch), "SPARK_LOCAL_DIRS": f"{scratch}/local", "SPARK_LOCAL_IP": "127.0.0.1",
                        "SPARK_SCALA_VERSION": "2.13", "TMPDIR": scratch, "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if not k.startswith(("PYSPARK_GATEWAY", "PYSPARK_SUBMIT", "SPARK_ENV_LOADED"))}
    run = subprocess.run([sys.executable, "-c", UNSHARED, scratch], env=env, cwd=scratch, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-3000:]
    assert f"folder file:{scratch}/warehouse/checkpoints\n" in run.stdout.replace("file://", "file:") and "rows 50\n" in run.stdout, run.stdout


def test_sliding_rate_folds_buckets(spark):
    """Against all pairs of consecutive samples, at every range; a range of one step is the plain rate."""
    import numpy as np

    rng = np.random.default_rng(2)
    t, v, rows = 0, 0.0, []
    for _ in range(300):
        t += int(rng.choice([20, 60, 200, 700, 3000]))
        v = float(rng.integers(5)) if rng.random() < 0.05 else v + float(rng.integers(50))
        rows.append((t, v))
    start = datetime(2024, 1, 1)
    labels = {"namespace": "n", "deployment": "d", "metric_type": "cpu", "src_rank": 0, "pod": "p", "container": "c", "series_id": "s"}
    df = spark.createDataFrame([(*labels.values(), start + timedelta(seconds=x), y) for x, y in rows],
                               "namespace string, deployment string, metric_type string, src_rank int, pod string, container string, series_id string, ts timestamp, value double")
    buckets = R.counter_buckets(df)
    plain = {r["bucket"]: r["rate"] for r in R.counter_rate(buckets).collect()}
    assert {r["bucket"]: r["rate"] for r in R.sliding_rate(buckets, 5, 5).collect()} == pytest.approx(plain)
    for wide in (10, 60):
        got = {r["bucket"]: r["rate"] for r in R.sliding_rate(buckets, 5, wide).collect()}
        want = {}
        for b in {x // 300 * 300 for x, _ in rows}:
            pairs = [(x1 - x0, y1 - y0 if y1 >= y0 else y1) for (x0, y0), (x1, y1) in zip(rows, rows[1:])
                     if b - wide * 60 < x1 // 300 * 300 <= b and x1 - x0 <= wide * 60]
            if sum(s for s, _ in pairs):
                want[start + timedelta(seconds=b)] = sum(i for _, i in pairs) / sum(s for s, _ in pairs)
        assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        R.sliding_rate(buckets, 5, 7)
