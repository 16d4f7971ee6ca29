"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from weakref import WeakKeyDictionary

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on: UTC wall clock, AQE for runtime re-planning
# (coalescing, skew-join splitting, broadcast conversion from real sizes).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tempora", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass the cluster's own builder config instead."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FOLDERS: WeakKeyDictionary = WeakKeyDictionary()  # Spark context -> folder of its lineage cuts


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, chosen once a session.

    Uses the cluster's ``spark.checkpoint.dir``, or else the folder that the Spark context was
    given. Where neither is set or can hold tables, a cluster's tables go beside its warehouse's,
    which all executors share, and those of a single machine's session to a scratch folder. (Spark
    fixes ``spark.checkpoint.dir`` when a session starts: the context keeps the folder, not the
    setting.) A path alone does not tell whether machines share a folder, so each is tried with a
    small table; on a cluster without any that holds one, an error is raised.
    """
    sc = spark.sparkContext
    if sc in _FOLDERS:
        return _FOLDERS[sc]
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    warehouse = sc.master.split("[")[0] != "local" and spark.conf.get("spark.sql.warehouse.dir", None)
    folders, tried = [named] if named else [], []
    if warehouse:
        folders.append(f"{warehouse.rstrip('/')}/checkpoints")
    if sc.master.startswith("local"):
        folders.append(None)  # a scratch folder, made only if it is needed
    for d in folders:
        d = d or os.path.realpath(tempfile.mkdtemp(prefix="tempora-ckpt-"))
        if not (why := no_tables(spark, d)):
            break
        tried.append(f"{d}: {why}")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder that the driver and all executors write and read; "
                           f"{'; '.join(tried) or 'none is set'}")
    if tried:
        warnings.warn(f"lineage cuts go to {d}; {'; '.join(tried)}", stacklevel=2)
    if not sc.getCheckpointDir():  # each call would put another folder into the last one
        sc.setCheckpointDir(d)
    _FOLDERS[sc] = d
    return d


def no_tables(spark: SparkSession, folder: str) -> str:
    """Why a folder cannot hold this session's tables, or nothing: a table of one row a task slot is
    written there and read again. Rows go missing where tasks write to disks that the driver or
    other executors do not see."""
    path = f"{folder.rstrip('/')}/tables/tried-{uuid.uuid4().hex}"
    try:
        n = spark.sparkContext.defaultParallelism if is_machine_local(folder, spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")) else 1
        try:
            spark.range(0, n, 1, n).write.parquet(path)
            found = spark.read.schema("id long").parquet(path).count()
        finally:
            delete(spark, path)
    except Exception as e:  # of whatever file system it is
        return f"{type(e).__name__} {str(e)[:200]}"
    return "" if found == n else f"{found} of {n} rows were found again"


def is_machine_local(path: str, default_fs: str = "file:///") -> bool:
    """Whether a path names the file system of the machine that reads it."""
    scheme = path.partition(":")[0] if "://" in path or path.startswith("file:") else default_fs.partition(":")[0]
    return scheme == "file"


_TABLES: dict[str, list[str]] = {}  # application id -> folders of written tables


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder that ``release`` deletes."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df, name: str = "cut"):
    """Cut lineage by writing a parquet table under the shared checkpoint folder and reading
    it back: one computation, columnar re-reads with pruning, and a lost executor re-reads
    files instead of replaying the plan. (``Dataset.checkpoint`` on an unpersisted plan
    computes it twice.) ``release`` deletes the tables once their results are read.

    Where a cluster's folder is a path of each machine, such as a mount, the rows read are counted
    against those written: executors on a machine without the mount may join at any time."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if spark.sparkContext.master.startswith("local") or not is_machine_local(path, spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")):
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    if (found := table.count()) != (n := written.get["rows"]):
        raise RuntimeError(f"{path} holds {found} of {n} rows: not all executors share this folder")
    return table


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote in this application; frames that read them
    must not be used afterwards. Returns how many there were."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        delete(spark, p)
    return len(paths)
