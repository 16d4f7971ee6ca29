"""Range-query matrix documents (JSON) <-> long-form samples.

A document is ``{"status": ..., "data": {"resultType": "matrix", "result": [
{"metric": {label: value}, "values": [[epoch, "number"], ...]}, ...]}}``.
Reading explodes series then points (no collect). Writing emits one document
per (series, UTC day) so a document never holds more than one day of one
series, whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.config import WL
from tempora.functions.timeparts import epoch_to_ts, series_id, text_to_value

MATRIX_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("resultType", T.StringType()),
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("metric", T.MapType(T.StringType(), T.StringType())),
            T.StructField("values", T.ArrayType(T.ArrayType(T.StringType())))])))]))])


def read_matrix_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files, one matrix document per line, fixed schema (no inference)."""
    return spark.read.schema(MATRIX_SCHEMA).json(path)


def parse_documents(doc_text: Column) -> Column:
    return F.from_json(doc_text, MATRIX_SCHEMA)


def matrix_to_samples(docs: DataFrame, doc_col: str | None = None) -> DataFrame:
    """All series of all documents as long rows: labels, series_id, ts, value.

    Series without points yield no rows; ``"NaN"`` and other non-numeric text become NULL.
    """
    d = docs if doc_col is None else docs.select(F.col(doc_col + ".*"))
    s = d.select(F.explode("data.result").alias("r"))
    p = s.select(F.col("r.metric").alias("labels"), F.explode("r.values").alias("v"))
    return p.select(
        "labels", series_id(F.col("labels")).alias("series_id"),
        F.col("labels")["namespace"].alias("namespace"), F.col("labels")["deployment"].alias("deployment"),
        F.col("labels")["pod"].alias("pod"), F.col("labels")["__name__"].alias("metric_name"),
        epoch_to_ts(F.col("v")[0]).alias("ts"), text_to_value(F.col("v")[1]).alias("value"))


def matrix_replicas(samples: DataFrame) -> DataFrame:
    """Replica series from matrix rows: drop missing, collapse equal instants by max from 0."""
    return (samples.where(F.col("value").isNotNull())
            .groupBy(*WL, "ts").agg(F.greatest(F.lit(0.0), F.max("value")).alias("value")))


def samples_to_documents(samples: DataFrame, value_format: str = "%d") -> DataFrame:
    """One matrix document per (series, UTC hour): ``[epoch, "value"]`` pairs in time order. A
    document holds the samples of one series and hour, which the scrape interval bounds.

    ``value_format`` formats the value text (``%d`` writes integers as the
    generator does; ``%s`` keeps full precision).
    """
    hour = F.date_trunc("hour", "ts")
    pts = samples.where(F.col("value").isNotNull()).select(
        "labels", "series_id", hour.alias("hour"),
        F.struct(F.unix_seconds("ts").alias("e"),
                 (F.format_string(value_format, F.col("value").cast("long")) if value_format == "%d"
                  else F.col("value").cast("string")).alias("v")).alias("p"))
    g = pts.groupBy("series_id", "hour").agg(F.first("labels").alias("metric"),
                                           F.array_sort(F.collect_list("p")).alias("ps"))
    values = F.transform("ps", lambda p: F.array(p["e"].cast("string"), p["v"]))
    doc = F.struct(F.lit("success").alias("status"),
                   F.struct(F.lit("matrix").alias("resultType"),
                            F.array(F.struct(F.col("metric"), values.alias("values"))).alias("result"))
                   .alias("data"))
    return g.select("series_id", "hour", F.to_json(doc).alias("document"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select("document").write.mode("overwrite").text(path)
