"""Policy-table jobs: HPA -> policy lookup, dangling references, snapshot diffs, namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY_KEY = ["policy_namespace", "policy_name"]


def _target(policies: DataFrame) -> DataFrame:
    return policies.withColumn(
        "hpa_target_namespace", F.coalesce(F.nullif(F.col("hpa_namespace"), F.lit("")), F.col("policy_namespace")))


def policies_for_hpa(hpas: DataFrame, policies: DataFrame) -> DataFrame:
    """Every (HPA, policy) pair where the policy references the HPA; a reference without a
    namespace means the policy's own namespace. Equi-join on (namespace, name)."""
    p = _target(policies)
    h = hpas.select(F.col("namespace").alias("hpa_target_namespace"), F.col("name").alias("hpa_name"))
    return (h.join(p, ["hpa_target_namespace", "hpa_name"])
            .select(F.col("hpa_target_namespace").alias("hpa_namespace"), "hpa_name", *POLICY_KEY))


def policies_for_changed(hpas_changed: DataFrame, policies: DataFrame) -> DataFrame:
    """Policies to re-evaluate after a set of HPAs changed (semi-join, each policy once)."""
    p = _target(policies)
    h = hpas_changed.select(F.col("namespace").alias("hpa_target_namespace"), F.col("name").alias("hpa_name"))
    return p.join(h, ["hpa_target_namespace", "hpa_name"], "left_semi").select(*POLICY_KEY)


def dangling_refs(hpas: DataFrame, policies: DataFrame) -> DataFrame:
    """Policies whose (non-empty) HPA reference points at no existing HPA (anti-join)."""
    p = _target(policies).where(F.coalesce(F.col("hpa_name"), F.lit("")) != "")
    h = hpas.select(F.col("namespace").alias("hpa_target_namespace"), F.col("name").alias("hpa_name"))
    return (p.join(h, ["hpa_target_namespace", "hpa_name"], "left_anti")
            .select(*POLICY_KEY, "hpa_target_namespace", "hpa_name"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer join of two policy snapshots by key: new / deleted / changed (generation) / unchanged."""
    a = before.select(*POLICY_KEY, F.col("generation").alias("gen_before"))
    b = after.select(*POLICY_KEY, F.col("generation").alias("gen_after"))
    j = a.join(b, POLICY_KEY, "full_outer")
    status = (F.when(F.col("gen_before").isNull(), F.lit("new"))
               .when(F.col("gen_after").isNull(), F.lit("deleted"))
               .when(F.col("gen_before") != F.col("gen_after"), F.lit("changed"))
               .otherwise(F.lit("unchanged")))
    return j.select(*POLICY_KEY, "gen_before", "gen_after", status.alias("status"))


def namespaces(policies: DataFrame, spark: SparkSession) -> DataFrame:
    """Distinct namespaces of the policies plus ``default``."""
    d = spark.createDataFrame([("default",)], "namespace string")
    return policies.select(F.col("policy_namespace").alias("namespace")).union(d).distinct()
