"""Structured Streaming jobs over metric-sample streams.

* R1 ``resample_stream``: watermark + tumbling 5-minute windows, max per workload; NaN dropped.
* R2 ``profile_refresh``: foreachBatch writes idempotent per-batch partials (count, mean, sum of
  squared deviations) of the (workload, day, hour) profile to shared storage; ``read_profile``
  merges the days of a rolling window and ``compact_profile`` folds batches into one table.
* R3 ``active_trigger_stream``: stream-static join with each workload's trigger array;
  the winner is chosen row by row (no streaming aggregation).
* R3 ``active_refresh``: the same with a table of policy versions that grows while the stream runs;
  every micro-batch reads it anew, every sample meets the version of its time.
* R4 ``transitions_stream``: keyed state (time and name of the last active trigger per workload)
  with ``applyInPandasWithState``; emits only changes, in time order.
* R4 ``timed_transitions``: keyed state with an event-time timer at the next start or end of the
  workload's triggers, so a change is reported at its own time without any sample near it.
* R5 ``deviation_alerts``: samples outside the active generated trigger's bounds, the first of
  each workload and interval (a windowed aggregate, the same on tables and streams).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tempora.config import WL
from tempora.operators.schedule import active_from_array
from tempora.streaming import windows as W

SAMPLE_SCHEMA = "namespace string, deployment string, ts timestamp, value double"


def resample_stream(samples: DataFrame, step: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Late rows beyond the watermark are dropped; each window is emitted once (append)."""
    return (samples.where(F.col("value").isNotNull() & ~F.isnan("value")).withWatermark("ts", watermark)
            .groupBy(*WL, F.window("ts", step).alias("w"))
            .agg(F.greatest(F.lit(0.0), F.max("value")).alias("value"), F.count(F.lit(1)).alias("n"))
            .select(*WL, F.col("w.start").alias("ts"), "value", "n"))


def profile_partials(batch: DataFrame) -> DataFrame:
    """Mergeable partial state of the (workload, day, hour) profile: count, mean, sum of squared
    deviations from it, max, min. Rows without a value are left out."""
    return (batch.where(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy(*WL, F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                 (F.var_pop("value") * F.count(F.lit(1))).alias("m2"),
                 F.max("value").alias("mx"), F.min("value").alias("mn")))


def profile_refresh(samples: DataFrame, state_dir: str, checkpoint: str, trigger: dict | None = None):
    """Start the refresh query; each micro-batch overwrites its own ``batch_id=`` partition,
    so a retried batch replaces (never duplicates) its partials."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (profile_partials(batch).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(state_dir))

    w = samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def _merged(parts: F.Column) -> F.Column:
    """Fold of partials (n, mean, m2, mx, mn); deviations are taken from the running mean, so large
    means cancel nothing."""
    def step(a, x):
        n = a["n"] + x["n"]
        d = x["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * x["n"] / n).alias("mean"),
                        (a["m2"] + x["m2"] + d * d * a["n"] * x["n"] / n).alias("m2"),
                        F.greatest(a["mx"], x["mx"]).alias("mx"), F.least(a["mn"], x["mn"]).alias("mn"))

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), parts[0], step)


def _folded(partials: DataFrame, keys: list) -> DataFrame:
    """Partials merged by ``keys``; a group has one row for each day and micro-batch."""
    state = F.struct("n", "mean", "m2", "mx", "mn")
    return (partials.groupBy(*keys).agg(F.sort_array(F.collect_list(state)).alias("p"))
            .select(*WL, *[c for c in ("day", "dow", "hour") if c in keys], _merged(F.col("p")).alias("m"))
            .select("*", "m.*").drop("m"))


def compact_profile(spark, state_dir: str, to_dir: str) -> None:
    """One row a (workload, day, hour) from all batches of ``state_dir``, as batch -1 of a new folder;
    run between refreshes and go on with that folder."""
    parts = _folded(spark.read.parquet(state_dir), WL + ["day", "hour"])
    parts.withColumn("batch_id", F.lit(-1)).write.mode("errorifexists").partitionBy("batch_id").parquet(to_dir)


def merge_profile(partials: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Partials of the days in [as_of - days, as_of] (all without ``as_of``) merged to the hourly
    profile: avg, max, min, population std, count."""
    p = partials
    if as_of is not None:
        last = F.lit(as_of).cast("date")
        p = p.where(F.col("day").between(F.date_sub(last, days), last))
    g = _folded(p.withColumn("dow", F.weekday("day")), WL + ["dow", "hour"])
    return g.select(*WL, "dow", "hour", F.col("mean").alias("avg"), F.col("mx").alias("max"), F.col("mn").alias("min"),
                    F.sqrt(F.col("m2") / F.col("n")).alias("std"), F.col("n").alias("count"))


def read_profile(spark, state_dir: str, as_of=None, days: int = 30) -> DataFrame:
    """Merged hourly profile from the partials written by ``profile_refresh``."""
    return merge_profile(spark.read.parquet(state_dir), as_of, days)


def active_trigger_stream(samples: DataFrame, trigger_arrays: DataFrame) -> DataFrame:
    """Each sample with its workload's winning Within trigger (NULL when none). Spark broadcasts the
    static side if its files are below the broadcast threshold and shuffles both sides otherwise."""
    j = samples.join(trigger_arrays, WL, "left")
    win = active_from_array(F.col("ts"), F.coalesce(F.col("triggers"), F.array().cast(trigger_arrays.schema[
        "triggers"].dataType)))
    return j.select(*WL, "ts", "value", win["name"].alias("active_name"), win["priority"].alias("active_priority"),
                    win["start_min"].alias("min_replicas"), win["start_max"].alias("max_replicas"))


TRANSITION_SCHEMA = "namespace string, deployment string, ts timestamp, from_trigger string, to_trigger string"


def _transitions(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, last = state.get if state.exists else (None, None)
    rows = pd.concat(list(pdfs))[["ts", "active_name"]].sort_values("ts", kind="stable")
    out = []
    for ts, name in rows.itertuples(index=False):
        if at is not None and ts < at:  # older than what the state has seen
            continue
        name = None if pd.isna(name) else name
        if at is None or name != last:
            out.append((key[0], key[1], ts, last, name))
        at, last = ts, name
    if at is not None:
        state.update((at, last))
    yield pd.DataFrame(out, columns=["namespace", "deployment", "ts", "from_trigger", "to_trigger"])


def transitions_stream(active: DataFrame) -> DataFrame:
    """Keyed state per workload: time and name of the last active trigger; rows only where it
    changes, in time order. A sample older than the state (late by a whole micro-batch) is ignored."""
    return (active.select(*WL, "ts", "active_name").groupBy(*WL)
            .applyInPandasWithState(_transitions, TRANSITION_SCHEMA, "at timestamp, last string", "append",
                                    GroupStateTimeout.NoTimeout))


POLICY_EVENT_SCHEMA = "namespace string, deployment string, ts timestamp, plan string"


def policy_events(trigger_arrays: DataFrame, since) -> DataFrame:
    """``POLICY_EVENT_SCHEMA`` rows: the plan of each workload from ``since`` (a column) on."""
    return trigger_arrays.select(*WL, since.alias("ts"), W.plan_json(F.col("triggers")).alias("plan"))


def _timed(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    upto, last, started, versions = state.get if state.exists else (None, None, False, "[]")
    known = {(int(since), plan) for since, plan in json.loads(versions)}
    if not state.hasTimedOut:
        for pdf in pdfs:
            known |= {(int(ts.timestamp()), plan) for ts, plan in pdf[["ts", "plan"]].itertuples(index=False)}
    versions = sorted(known)
    clock = state.getCurrentWatermarkMs() // 1000
    upto = min(versions)[0] - 1 if upto is None else upto
    out = []
    for at, before, now in W.changes(versions, upto, clock, last, started):
        out.append((key[0], key[1], pd.Timestamp(at, unit="s"), before, now))
        last, started = now, True
    upto = max(upto, clock)
    kept = [v for v in versions if v[0] > upto]
    kept = ([max(v for v in versions if v[0] <= upto)] if len(kept) < len(versions) else []) + kept
    state.update((upto, last, started, json.dumps(kept)))
    state.setTimeoutTimestamp(max(W.next_tick(kept, upto), clock + 1) * 1000)
    yield pd.DataFrame(out, columns=["namespace", "deployment", "ts", "from_trigger", "to_trigger"])


def timed_transitions(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Changes of each workload's winning trigger at the instants at which they happen.

    ``events``: a stream of ``POLICY_EVENT_SCHEMA`` rows; rows without a plan (samples) only move the
    clock, and no group ever gets them. A row with a plan is a policy version in force from its
    ``ts`` on; later rows of a workload replace it from theirs. Each workload holds its versions and
    last winner, and a timer at the next instant at which a window can begin or end; when the
    watermark passes it, all changes up to the watermark are emitted, in time order. The first row
    is the beginning of the first version. Versions that come after the watermark has passed
    their time are dropped with other late rows. Two versions at one time: the greater text wins.
    """
    seen = events.withWatermark("ts", watermark)
    # a condition on ts stays above the watermark, so that rows without a plan advance it
    plans = seen.where(F.when(F.col("ts").isNotNull(), F.col("plan").isNotNull()))
    return plans.groupBy(*WL).applyInPandasWithState(
        _timed, TRANSITION_SCHEMA, "upto long, last string, started boolean, versions string", "append", GroupStateTimeout.EventTimeTimeout)


def publish_policies(trigger_arrays: DataFrame, valid_from, generation: int, path: str) -> None:
    """Adds a version of the workloads' trigger arrays, in force from ``valid_from`` (a column) on, to
    the version table at ``path``. Versions are told apart by time, then by generation."""
    (trigger_arrays.select(*WL, valid_from.alias("valid_from"), F.lit(generation).cast("long").alias("generation"), "triggers")
     .write.mode("append").parquet(path))


def active_versions(samples: DataFrame, versions: DataFrame) -> DataFrame:
    """Each sample with its workload's winning trigger in the version that is in force at its time;
    null before the first version. A workload has as many array entries as versions."""
    one = F.struct("valid_from", "generation", "triggers")
    arrays = versions.groupBy(*WL).agg(F.sort_array(F.collect_list(one)).alias("versions"))
    j = samples.join(arrays, WL, "left")
    past = F.filter("versions", lambda v: v["valid_from"] <= F.col("ts"))
    last = F.try_element_at(past, F.lit(-1))
    none = F.array().cast(versions.schema["triggers"].dataType)
    win = active_from_array(F.col("ts"), F.coalesce(last["triggers"], none))
    return j.select(*WL, "ts", "value", last["generation"].alias("generation"), win["name"].alias("active_name"),
                    win["priority"].alias("active_priority"))


def active_refresh(samples: DataFrame, versions_path: str, out_dir: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that writes ``active_versions`` of every micro-batch to its own ``batch_id=``
    partition of ``out_dir``. The version table is read anew in each micro-batch, so a version
    published while the query runs acts from the next one on, for the samples of its time."""
    def write(batch: DataFrame, batch_id: int) -> None:
        versions = batch.sparkSession.read.parquet(versions_path)
        (active_versions(batch, versions).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_dir))

    w = samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def deviation_alerts(active: DataFrame, threshold_percent: int = 20, interval: str = "5 minutes",
                     watermark: str = "10 minutes") -> DataFrame:
    """The first sample of each workload and interval outside [min*(1-t), max*(1+t)] of an active
    ``ai-`` trigger. A stream reports an interval once, when the watermark has passed its end."""
    t = threshold_percent / 100.0
    out = ((F.col("value") < F.col("min_replicas") * (1 - t)) | (F.col("value") > F.col("max_replicas") * (1 + t)))
    first = F.min(F.struct("ts", "active_name", "value", "min_replicas", "max_replicas"))
    # a condition on ts stays above the watermark, which all samples then advance, not only deviating ones
    alert = F.when(F.col("ts").isNotNull(), F.col("active_name").startswith("ai-") & out)
    return (active.withWatermark("ts", watermark).where(alert)
            .groupBy(*WL, F.window("ts", interval).alias("w")).agg(first.alias("f"))
            .select(*WL, F.col("w.start").alias("interval_start"), "f.*"))
