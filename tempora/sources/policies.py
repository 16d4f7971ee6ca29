"""Scaling policies: trigger tables, policy documents and HPA bounds.

A policy (one per workload here) holds a list of triggers and a reference to
the HPA it drives. The flat ``triggers`` table has one row per trigger:

    policy_namespace, policy_name, generation, hpa_namespace, hpa_name, name, priority,
    timezone, has_interval, recurring, start_date, end_date, start_time, end_time,
    start_min, start_max, end_min, end_max, suspend
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.config import WL

# Trigger sets of the derived policies. Clocks are hours after the workload's busiest hour with a
# fixed minute and second, or fixed texts; dates are days after its first sample. One set a row group:
# 0 a window, its complement overnight and whole weekend days; 1 overlapping windows without end
# configs; 2 a tie of priorities, on an HPA in another namespace; 3 one window at two priorities;
# 4 a window inside another on all days; 5 edge cases; 6 nothing but a suspended trigger.
TRIGGER_FIELDS = [
    ("set_id", "int"), ("name", "string"), ("priority", "int"), ("timezone", "string"),
    ("has_interval", "boolean"), ("recurring", "string"), ("first_day", "int"), ("last_day", "int"),
    ("start_hours", "int"), ("start_text", "string"), ("end_hours", "int"), ("end_text", "string"),
    ("start_min", "int"), ("start_max", "int"), ("end_min", "int"), ("end_max", "int"),
    ("suspend", "boolean"),
]
TRIGGER_DDL = ", ".join(f"{n} {t}" for n, t in TRIGGER_FIELDS)

WD, WE, ALL = "M,TU,W,TH,F", "SAT,SUN", "SUN,M,TU,W,TH,F,SAT"
TRIGGER_SETS = [
    (0, "rush", 70, "Europe/Berlin", True, WD, None, None, -1, ":15:00", 3, ":45:00", 4, 9, 2, 4, False),
    (0, "lull", 20, "Europe/Berlin", True, WD, None, None, 3, ":45:00", -1, ":15:00", 1, 3, 1, 2, False),
    (0, "idle-days", 10, "Europe/Berlin", True, WE, None, None, None, "00:00:00", None, "23:59:59", 1, 2, None, None, False),
    (1, "core", 90, "Asia/Tokyo", True, "M,W,F", None, None, 0, ":00:00", 2, ":20:00", 7, 12, None, None, False),
    (1, "tail", 40, "Asia/Tokyo", True, "M,TU,W,TH", None, None, 1, ":40:00", 5, ":00:00", 4, 8, None, None, False),
    (2, "late", 60, "UTC", True, "TU,TH,SUN", None, None, 6, ":05:00", 9, ":50:00", 3, 8, 1, 2, False),
    (2, "later", 60, "UTC", True, "TU,TH,SUN", None, None, 7, ":10:00", 10, ":35:00", 2, 6, 1, 3, False),
    (3, "day", 55, "America/New_York", True, WD, None, None, -4, ":00:00", 6, ":30:00", 4, 11, 1, 4, False),
    (3, "pause-a", 33, "America/New_York", True, WE, None, None, None, "00:00:00", None, "23:59:59", 2, 6, 1, 3, False),
    (3, "pause-b", 32, "America/New_York", True, WE, None, None, None, "00:00:00", None, "23:59:59", 3, 7, 1, 3, False),
    (4, "base", 15, "UTC", True, ALL, None, None, -3, ":00:00", 5, ":00:00", 2, 6, 1, 4, False),
    (4, "spike", 25, "UTC", True, ALL, None, None, 0, ":30:00", 2, ":00:00", 5, 12, 2, 7, False),
    (5, "dated", 30, "UTC", True, None, 4, 16, -2, ":00:00", 4, ":00:00", 4, 8, 1, 3, False),
    (5, "friday-night", 45, "UTC", True, "F", None, None, None, "22:30:00", None, "05:30:00", 2, 9, 1, 4, False),
    (5, "odd-zone", None, "Nowhere/Land", True, "M, XX", None, None, None, "00:00:00", None, "12:00:00", 2, 4, None, None, False),
    (5, "parked", 95, "UTC", True, WD, None, None, None, "00:00:00", None, "23:59:00", 9, 9, 1, 2, True),
    (5, "no-clock", 85, "UTC", True, WD, None, None, None, "soon", 5, ":00:00", 3, 3, 1, 2, False),
    (5, "no-days", 75, "UTC", False, None, None, None, None, "00:00:00", None, "23:00:00", 6, 6, 1, 2, False),
    (5, "crossed", 35, "UTC", True, WE, None, None, 0, ":00:00", 2, ":00:00", 6, 3, 1, 5, False),
    (6, "asleep", 50, "UTC", True, ALL, None, None, 0, ":00:00", 4, ":00:00", 2, 5, 1, 2, True),
]
N_SETS = 7

# HPA namespace written in each set's policy (None = policy's own namespace).
SET_HPA_NAMESPACE = {2: "shared"}

# Bounds every workload's HPA starts from.
HPA_START_MIN, HPA_START_MAX = 1, 5


def trigger_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRIGGER_SETS, TRIGGER_DDL)


def set_of(deployment) -> F.Column:
    """Trigger set a workload's policy uses: code of the deployment's last character mod the number of sets."""
    return F.ascii(F.substring(deployment, -1, 1)) % N_SETS


def workloads(samples: DataFrame) -> DataFrame:
    """One row per workload: its busiest hour of day (most samples; the earliest of equals) and its first day."""
    hours = samples.groupBy(*WL, F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t"))
    top = F.min(F.struct((-F.col("n")).alias("n"), "hour"))
    return hours.groupBy(*WL).agg(top.alias("top"), F.to_date(F.min("t")).alias("since")).select(
        *WL, F.col("top.hour").alias("busy_hour"), "since")


def policies(wls: DataFrame) -> DataFrame:
    """One policy per workload: name ``<deployment>-schedule``, HPA ``<deployment>-hpa``."""
    ns_map = F.create_map(*[x for k, v in SET_HPA_NAMESPACE.items() for x in (F.lit(k), F.lit(v))])
    sid = set_of(F.col("deployment"))
    return wls.select(
        *WL,
        sid.alias("set_id"),
        F.col("namespace").alias("policy_namespace"),
        F.concat(F.col("deployment"), F.lit("-schedule")).alias("policy_name"),
        F.lit(1).cast("bigint").alias("generation"),
        F.try_element_at(ns_map, sid).alias("hpa_namespace"),
        F.concat(F.col("deployment"), F.lit("-hpa")).alias("hpa_name"))


def policy_triggers(spark: SparkSession, wls: DataFrame, include_suspended: bool = False) -> DataFrame:
    """Flat trigger table for every workload's policy (suspended triggers dropped by default), clocks
    and dates by ``workloads``.

    The trigger-set table is a fixed literal (20 rows), so broadcasting it is safe.
    """
    def clock(hours, text):
        hour = F.lpad(F.pmod(F.col("busy_hour") + F.col(hours), F.lit(24)).cast("string"), 2, "0")
        return F.when(F.col(hours).isNull(), F.col(text)).otherwise(F.concat(hour, F.col(text)))

    def day(days):
        return F.date_format(F.date_add("since", F.col(days)), "yyyy-MM-dd")

    t = policies(wls).join(wls, WL).join(F.broadcast(trigger_sets(spark)), "set_id").select(
        *WL, "set_id", "policy_namespace", "policy_name", "generation", "hpa_namespace", "hpa_name", "name", "priority",
        "timezone", "has_interval", "recurring", day("first_day").alias("start_date"), day("last_day").alias("end_date"),
        clock("start_hours", "start_text").alias("start_time"), clock("end_hours", "end_text").alias("end_time"),
        "start_min", "start_max", "end_min", "end_max", "suspend")
    if not include_suspended:
        t = t.where(~F.col("suspend"))
    return t.withColumn("hpa_target_namespace",
                        F.coalesce(F.nullif(F.col("hpa_namespace"), F.lit("")), F.col("policy_namespace")))


def hpa_bounds(wls: DataFrame) -> DataFrame:
    """Current HPA bounds: one HPA per workload, in the workload's namespace."""
    return wls.select(F.col("namespace"), F.concat(F.col("deployment"), F.lit("-hpa")).alias("name"),
                      F.lit(HPA_START_MIN).alias("min_replicas"), F.lit(HPA_START_MAX).alias("max_replicas"))


# ---------------------------------------------------------------------------
# Policy documents (nested JSON) <-> flat triggers
# ---------------------------------------------------------------------------

HPA_CONFIG = T.StructType([T.StructField("minReplicas", T.IntegerType()),
                           T.StructField("maxReplicas", T.IntegerType()),
                           T.StructField("desiredReplicas", T.IntegerType())])
INTERVAL = T.StructType([T.StructField("recurring", T.StringType()),
                         T.StructField("startDate", T.StringType()),
                         T.StructField("endDate", T.StringType()),
                         # not part of the interval: read only so validation can report a zone
                         # placed here by mistake (it is otherwise ignored and UTC applies)
                         T.StructField("timezone", T.StringType())])
TRIGGER = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("priority", T.IntegerType()),
    T.StructField("timezone", T.StringType()), T.StructField("interval", INTERVAL),
    T.StructField("startTime", T.StringType()), T.StructField("endTime", T.StringType()),
    T.StructField("startHPAConfig", HPA_CONFIG), T.StructField("endHPAConfig", HPA_CONFIG),
    T.StructField("suspend", T.BooleanType())])
POLICY_DOC = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("name", T.StringType()),
                                            T.StructField("namespace", T.StringType()),
                                            T.StructField("generation", T.LongType())])),
    T.StructField("spec", T.StructType([
        T.StructField("HPAObjectRef", T.StructType([T.StructField("name", T.StringType()),
                                                    T.StructField("namespace", T.StringType())])),
        T.StructField("triggers", T.ArrayType(TRIGGER))]))])


def read_policy_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines policy documents with a fixed schema (no inference)."""
    return spark.read.schema(POLICY_DOC).json(path)


def explode_policy_documents(docs: DataFrame, include_suspended: bool = False) -> DataFrame:
    """Policy documents -> flat trigger rows; target namespace defaults to the document's own."""
    t = docs.select(
        F.col("metadata.namespace").alias("policy_namespace"), F.col("metadata.name").alias("policy_name"),
        F.coalesce(F.col("metadata.generation"), F.lit(0)).alias("generation"),
        F.col("spec.HPAObjectRef.namespace").alias("hpa_namespace"),
        F.col("spec.HPAObjectRef.name").alias("hpa_name"),
        F.explode("spec.triggers").alias("t"))
    t = t.select("*", F.col("t.name").alias("name"), F.col("t.priority").alias("priority"),
                 F.col("t.timezone").alias("timezone"), F.col("t.interval").isNotNull().alias("has_interval"),
                 F.col("t.interval.recurring").alias("recurring"),
                 F.col("t.interval.startDate").alias("start_date"), F.col("t.interval.endDate").alias("end_date"),
                 F.col("t.interval.timezone").alias("interval_timezone"),
                 F.col("t.startTime").alias("start_time"), F.col("t.endTime").alias("end_time"),
                 F.col("t.startHPAConfig.minReplicas").alias("start_min"),
                 F.col("t.startHPAConfig.maxReplicas").alias("start_max"),
                 F.col("t.endHPAConfig.minReplicas").alias("end_min"),
                 F.col("t.endHPAConfig.maxReplicas").alias("end_max"),
                 F.coalesce(F.col("t.suspend"), F.lit(False)).alias("suspend")).drop("t")
    if not include_suspended:
        t = t.where(~F.col("suspend"))
    return t.withColumn("hpa_target_namespace",
                        F.coalesce(F.nullif(F.col("hpa_namespace"), F.lit("")), F.col("policy_namespace")))


def trigger_struct(prefix: str = "") -> F.Column:
    """Flat trigger columns -> the nested trigger document form."""
    def cfg(mn, mx):
        return F.when(F.col(mn).isNotNull() | F.col(mx).isNotNull(),
                      F.struct(F.col(mn).alias("minReplicas"), F.col(mx).alias("maxReplicas")))

    return F.struct(
        F.col("name"), F.col("priority"), F.col("timezone"),
        F.struct(F.col("recurring")).alias("interval"),
        F.col("start_time").alias("startTime"), F.col("end_time").alias("endTime"),
        cfg("min_replicas", "max_replicas").alias("startHPAConfig"),
        cfg("end_min_replicas", "end_max_replicas").alias("endHPAConfig"))


FLAT_DDL = ("namespace string, deployment string, policy_namespace string, policy_name string, "
            "generation bigint, hpa_namespace string, hpa_name string, name string, priority int, "
            "timezone string, has_interval boolean, recurring string, start_date string, end_date string, "
            "start_time string, end_time string, start_min int, start_max int, end_min int, end_max int, "
            "suspend boolean")
_FLAT_COLS = [c.split()[0] for c in FLAT_DDL.split(", ")]


def triggers_frame(spark: SparkSession, rows: list[dict], namespace: str = "default",
                   deployment: str = "app", include_suspended: bool = False) -> DataFrame:
    """Flat trigger table from plain dicts (policy/HPA fields default to one policy per workload)."""
    base = {"namespace": namespace, "deployment": deployment, "policy_namespace": namespace,
            "policy_name": f"{deployment}-schedule", "generation": 1, "hpa_namespace": None,
            "hpa_name": f"{deployment}-hpa", "priority": None, "timezone": "UTC", "has_interval": True,
            "recurring": None, "start_date": None, "end_date": None, "start_min": None, "start_max": None,
            "end_min": None, "end_max": None, "suspend": False}
    data = [tuple({**base, **r}.get(c) for c in _FLAT_COLS) for r in rows]
    t = spark.createDataFrame(data, FLAT_DDL)
    if not include_suspended:
        t = t.where(~F.col("suspend"))
    return t.withColumn("hpa_target_namespace",
                        F.coalesce(F.nullif(F.col("hpa_namespace"), F.lit("")), F.col("policy_namespace")))
