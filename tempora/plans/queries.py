"""Named queries: each takes (spark, sf_dir) and returns a report DataFrame.

Every query reads the driver tables (``events``) and derives its inputs with
Spark, so its work grows with the tables. Results go through ``portable`` so
the SQL oracle can compare values exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.config import WL, AnalysisConfig, DetectConfig, ProfileConfig
from tempora.operators import cluster as K
from tempora.operators import detect as D
from tempora.operators import planned as PL
from tempora.operators import policy as PJ
from tempora.operators import profile as P
from tempora.operators import resample as R
from tempora.operators import schedule as S
from tempora.operators import triggers as G
from tempora.operators.quantiles import grouped_quantiles
from tempora.plans.report import portable
from tempora.session import materialize, shared_folder
from tempora.sources import events as E
from tempora.sources import matrix as MX
from tempora.sources import policies as PO
from tempora.sources import sinks as SK
from tempora.streaming import histograms as H
from tempora.streaming import jobs as J

AS_OF = "2024-01-28 00:00:00"  # the instant that lookback windows end at; inside the events' month

WEEK = "2024-01-22"  # the Monday of the week that ends with AS_OF, in which windows are compared

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared building blocks
# ---------------------------------------------------------------------------

def _cut(df: DataFrame) -> DataFrame:
    """Materialise a shared reduction once (a parquet table in the shared checkpoint folder):
    it is read by several branches of one plan, so each raw scan happens once."""
    return materialize(df)


def _clean(spark, sf_dir, cfg: ProfileConfig = ProfileConfig()):
    return _cut(P.clean(E.replica_samples(spark, sf_dir, cfg.step_minutes), cfg))


def _profile_parts(spark, sf_dir):
    c = _clean(spark, sf_dir)
    hourly = P.hourly_profile(c)
    stats = P.workload_stats(c)
    dm = P.daily_means(P.daily_profile(c))
    return c, hourly, stats, dm


def _patterns(spark, sf_dir, cfg: DetectConfig = DetectConfig()):
    _, hourly, stats, dm = _profile_parts(spark, sf_dir)
    return D.detect(hourly, stats, dm, spark, cfg), stats


# ---------------------------------------------------------------------------
# replica profiling
# ---------------------------------------------------------------------------

@query("outlier_filter")
def outlier_filter(spark, sf_dir):
    return portable(_clean(spark, sf_dir))


@query("hourly_profile")
def hourly_profile(spark, sf_dir):
    return portable(P.hourly_profile(_clean(spark, sf_dir)))


@query("daily_profile")
def daily_profile(spark, sf_dir):
    return portable(P.daily_profile(_clean(spark, sf_dir)))


@query("workload_stats")
def workload_stats(spark, sf_dir):
    return portable(P.workload_stats(_clean(spark, sf_dir)))


@query("workload_stats_by_selection")
def workload_stats_by_selection(spark, sf_dir):
    """The same statistics with percentiles by selection, for workloads of any number of values."""
    return portable(P.workload_stats(_clean(spark, sf_dir), ProfileConfig(select_percentiles=True)))


@query("namespace_quantiles")
def namespace_quantiles(spark, sf_dir):
    """Exact quantiles of the raw samples of each namespace and metric: few groups of nearly all
    rows, each with about as many distinct values as rows."""
    s = E.samples(spark, sf_dir)
    q = grouped_quantiles(s, ["namespace", "metric_name"], "value", [0.05, 0.5, 0.95, 0.99], accuracy=1000)
    names = ["p05", "p50", "p95", "p99"]
    return portable(q.select("namespace", "metric_name", "n", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(names)]))


@query("daily_means")
def daily_means(spark, sf_dir):
    return portable(P.daily_means(P.daily_profile(_clean(spark, sf_dir))))


@query("profile_grouping_sets")
def profile_grouping_sets(spark, sf_dir):
    return portable(P.profile_grouping_sets(_clean(spark, sf_dir)))


@query("segment_report")
def segment_report(spark, sf_dir):
    return portable(P.segment_report(_clean(spark, sf_dir)))


@query("expected_band_check")
def expected_band_check(spark, sf_dir):
    """Second half of the month against the bands of the first."""
    c, early = _clean(spark, sf_dir), F.dayofmonth("ts") <= 15
    return portable(P.expected_band_check(P.segment_report(c.where(early)), P.segment_report(c.where(~early))))


# ---------------------------------------------------------------------------
# detectors and generated triggers
# ---------------------------------------------------------------------------

@query("detector_patterns")
def detector_patterns(spark, sf_dir):
    pats, _ = _patterns(spark, sf_dir)
    return portable(pats.drop("det_order"))


@query("v2_triggers")
def v2_triggers(spark, sf_dir):
    pats, stats = _patterns(spark, sf_dir)
    return portable(G.v2_triggers(pats, stats))


@query("v2_triggers_lookback")
def v2_triggers_lookback(spark, sf_dir):
    """Triggers mined from the 30 days before an instant; the scan reads no other events."""
    c = _cut(P.clean(E.replica_samples(spark, sf_dir, as_of=AS_OF, days=LOOKBACK)))
    stats = P.workload_stats(c)
    pats = D.detect(P.hourly_profile(c), stats, P.daily_means(P.daily_profile(c)), spark)
    return portable(G.v2_triggers(pats, stats))


@query("v2_triggers_wrap_aware")
def v2_triggers_wrap_aware(spark, sf_dir):
    cfg = DetectConfig(wrap_aware=True)
    pats, stats = _patterns(spark, sf_dir, cfg)
    return portable(G.v2_triggers(pats, stats, cfg))


LOOKBACK = 30  # days of the miners


@query("v2_default_triggers")
def v2_default_triggers(spark, sf_dir):
    """Defaults of the workloads without an accepted pattern in the miner's 30 days. The roster is
    every workload of the table, so some may have no data at all."""
    rs = _cut(E.replica_samples(spark, sf_dir, as_of=AS_OF, days=LOOKBACK))
    c = _cut(P.clean(rs))
    stats = P.workload_stats(c)
    pats = D.detect(P.hourly_profile(c), stats, P.daily_means(P.daily_profile(c)), spark)
    roster = E.workload_samples(E.read_table(spark, sf_dir, "events")).select(*WL).distinct()
    return portable(G.default_triggers(roster.join(stats, WL, "left"), pats))


# ---------------------------------------------------------------------------
# trigger evaluation over every sample instant of every workload
# ---------------------------------------------------------------------------

def _schedule_inputs(spark, sf_dir):
    inst = _cut(E.replica_samples(spark, sf_dir).select(*WL, "ts"))
    wls = _cut(PO.workloads(inst))
    return inst, wls, PO.policy_triggers(spark, wls)


def _states(spark, sf_dir):
    inst, _, trig = _schedule_inputs(spark, sf_dir)
    return S.window_state(inst, trig, spark), inst


def _bounds(spark, sf_dir):
    inst, wls, trig = _schedule_inputs(spark, sf_dir)
    return S.effective_bounds(inst, trig, PO.hpa_bounds(wls), spark)


@query("window_state")
def window_state(spark, sf_dir):
    st, _ = _states(spark, sf_dir)
    return portable(st.select(*WL, "ts", "name", "priority", "local_ts", "state", "error"))


def _nullable_as_double(df, *cols):
    """Columns that can be NULL are reported as DOUBLE so both engines hand over the same
    pandas dtype (float with NaN) to the comparison."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


@query("active_trigger")
def active_trigger(spark, sf_dir):
    st, inst = _states(spark, sf_dir)
    return portable(_nullable_as_double(S.active_trigger(st, inst), "active_priority"))


@query("active_trigger_by_interval")
def active_trigger_by_interval(spark, sf_dir):
    """The winner of every instant from the intervals between changes: no instant evaluates a trigger."""
    inst, wls, trig = _schedule_inputs(spark, sf_dir)
    span = inst.groupBy(*WL).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    changes = _cut(S.winner_changes(trig, span, spark))
    out = S.by_interval(inst.distinct(), changes, WL, ["active_name", "active_priority"])
    return portable(_nullable_as_double(out, "active_priority"))


@query("effective_bounds_by_interval")
def effective_bounds_by_interval(spark, sf_dir):
    """The bounds of every instant from the intervals between the instants at which they can change."""
    inst, wls, trig = _schedule_inputs(spark, sf_dir)
    span = inst.groupBy(*WL).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    ticks = S.boundary_instants(trig, span, spark)
    keys = [*WL, "policy_namespace", "policy_name"]
    at = _cut(S.effective_bounds(ticks, trig, PO.hpa_bounds(wls), spark).where(F.col("policy_name").isNotNull()).withColumnRenamed("ts", "from_ts"))
    policies = at.select(*keys).distinct()
    out = S.by_interval(inst.join(policies, WL), at, keys, ["source", "min_replicas", "max_replicas", "error"])
    return portable(_nullable_as_double(out, "min_replicas", "max_replicas"))


@query("higher_priority_active")
def higher_priority_active(spark, sf_dir):
    st, _ = _states(spark, sf_dir)
    return portable(S.higher_priority_active(st))


@query("effective_bounds")
def effective_bounds(spark, sf_dir):
    return portable(_nullable_as_double(_bounds(spark, sf_dir), "min_replicas", "max_replicas"))


@query("schedule_timeline")
def schedule_timeline(spark, sf_dir):
    return portable(_nullable_as_double(S.schedule_timeline(_bounds(spark, sf_dir)), "min_replicas", "max_replicas"))


@query("trigger_transitions")
def trigger_transitions(spark, sf_dir):
    st, inst = _states(spark, sf_dir)
    return portable(S.trigger_transitions(S.active_trigger(st, inst)))


@query("trigger_cron_plan")
def trigger_cron_plan(spark, sf_dir):
    _, _, trig = _schedule_inputs(spark, sf_dir)
    return portable(S.cron_plan(trig))


@query("trigger_validation")
def trigger_validation(spark, sf_dir):
    _, wls, _ = _schedule_inputs(spark, sf_dir)
    return portable(S.trigger_validation(PO.policy_triggers(spark, wls, include_suspended=True), spark))


# ---------------------------------------------------------------------------
# sample sources, resampling and the merged per-bucket frame
# ---------------------------------------------------------------------------

def _samples(spark, sf_dir):
    return E.samples(spark, sf_dir)


def _series(spark, sf_dir):
    return R.v1_series(lambda t: E.samples(spark, sf_dir, [t]))


def _features(spark, sf_dir):
    return _cut(K.time_features(R.merged_frame(_series(spark, sf_dir))))


@query("samples_resample_5m")
def samples_resample_5m(spark, sf_dir):
    """The two weeks up to a day inside the data; the filter on the stored column reaches the scan."""
    r = R.resample(E.samples(spark, sf_dir, as_of=AS_OF, days=14))
    return portable(r.select(*WL, "metric_type", "metric_name", "pod", "series_id", "bucket", "value",
                             "last_ts", "n_raw"))


@query("samples_label_filter")
def samples_label_filter(spark, sf_dir):
    s = R.select_labels(E.samples(spark, sf_dir, ["cpu"]), {"__name__": "container_cpu_usage_seconds_total"},
                        {"pod": "pod-1"})
    return portable(s.select("event_id", *WL, "pod", "container", "metric_name", "series_id", "ts", "value"))


@query("source_fallback")
def source_fallback(spark, sf_dir):
    return portable(R.best_source(R.source_counts(_samples(spark, sf_dir))).drop("src_rank"))


@query("counter_rate_sum")
def counter_rate_sum(spark, sf_dir):
    rate = R.counter_rate(R.best_source(R.counter_buckets(E.samples(spark, sf_dir, ["cpu"]))))
    return portable(R.sum_by_pod(rate, "rate"))


@query("counter_rate_sliding")
def counter_rate_sliding(spark, sf_dir):
    """Rates over half an hour at every five minutes, summed by pod."""
    rate = R.sliding_rate(R.best_source(R.counter_buckets(E.samples(spark, sf_dir, ["cpu"]))), 5, 30)
    return portable(R.sum_by_pod(rate, "rate"))


@query("memory_sum_by_pod")
def memory_sum_by_pod(spark, sf_dir):
    return portable(R.sum_by_pod(R.best_source(R.resample(E.samples(spark, sf_dir, ["memory"])))))


@query("per_timestamp_stats")
def per_timestamp_stats(spark, sf_dir):
    return portable(R.per_timestamp_stats(_series(spark, sf_dir)))


@query("max_per_timestamp")
def max_per_timestamp(spark, sf_dir):
    s = _series(spark, sf_dir).where(F.col("metric_type") == "replicas")
    return portable(R.max_per_timestamp(s))


@query("outer_merge_fill")
def outer_merge_fill(spark, sf_dir):
    return portable(R.merged_frame(_series(spark, sf_dir)))


@query("unified_timestamps")
def unified_timestamps(spark, sf_dir):
    return portable(R.unified_timestamps(_series(spark, sf_dir)))


@query("time_features")
def time_features(spark, sf_dir):
    f = _features(spark, sf_dir)
    return portable(f.select(*WL, "bucket", "hour", "minute", "day_of_week", "is_weekend", "time_of_day",
                             "time_slot", "week", "date", "is_peak"))


# ---------------------------------------------------------------------------
# grid, clustering and mined patterns
# ---------------------------------------------------------------------------

@query("slot_grid")
def slot_grid(spark, sf_dir):
    return portable(K.slot_grid(_features(spark, sf_dir)))


@query("standardized_grid")
def standardized_grid(spark, sf_dir):
    z = K.standardize(K.slot_grid(_features(spark, sf_dir)))
    return portable(z.select(*WL, "day_of_week", "time_slot", *[f"z_{c}" for c in K.FEATURES]))


@query("kmeans_assign_step")
def kmeans_assign_step(spark, sf_dir):
    z = K.standardize(K.slot_grid(_features(spark, sf_dir)))
    return portable(K.assign_fixed(z))


@query("cluster_patterns_fixed")
def cluster_patterns_fixed(spark, sf_dir):
    f = _features(spark, sf_dir)
    grid = K.slot_grid(f)
    labels = K.assign_fixed(K.standardize(grid))
    return portable(K.refine_patterns(K.cluster_patterns(grid, labels), f))


@query("silhouette_fixed_labels")
def silhouette_fixed_labels(spark, sf_dir):
    z = K.standardize(K.slot_grid(_features(spark, sf_dir)))
    return portable(K.silhouette_fixed(z, K.assign_fixed(z)))


@query("kmeans_best_k")
def kmeans_best_k(spark, sf_dir):
    z = K.standardize(K.slot_grid(_features(spark, sf_dir)))
    return portable(K.best_k_clusters(z))


@query("v1_patterns")
def v1_patterns(spark, sf_dir):
    return portable(K.mine_patterns(_features(spark, sf_dir)))


@query("v1_triggers")
def v1_triggers(spark, sf_dir):
    """Mined triggers, plus the default for workloads where mining found no pattern."""
    f = _features(spark, sf_dir)
    mined = G.v1_triggers(_cut(K.mine_patterns(f)))
    return portable(mined.unionByName(G.v1_default_triggers(f.select(*WL), mined)))


@query("v1_default_triggers")
def v1_default_triggers(spark, sf_dir):
    """Defaults of the workloads without a mined trigger: those without a pattern, and those that
    have no CPU sample in the miner's 30 days (the roster is the whole table)."""
    has_cpu = E.samples(spark, sf_dir, ["cpu"], as_of=AS_OF, days=LOOKBACK).select(*WL).distinct()
    mined = G.v1_triggers(_cut(K.merge_patterns(_fixed_patterns(_features(spark, sf_dir)))))
    kept = mined.join(has_cpu, WL, "left_semi")
    return portable(G.v1_default_triggers(_samples(spark, sf_dir).select(*WL), kept))


# ---------------------------------------------------------------------------
# documents: matrix JSON, trigger JSON, policy documents, run statistics
# ---------------------------------------------------------------------------

def _resampled_with_labels(spark, sf_dir):
    r = R.resample(_samples(spark, sf_dir))
    return r.select("*", E.labels_col().alias("labels"), F.col("bucket").alias("ts"))


@query("matrix_json_roundtrip")
def matrix_json_roundtrip(spark, sf_dir):
    """Resampled series -> one matrix document per (series, hour) -> parsed back to rows."""
    docs = MX.samples_to_documents(_resampled_with_labels(spark, sf_dir), value_format="%s")
    back = MX.matrix_to_samples(docs.select(MX.parse_documents(F.col("document")).alias("d")), "d")
    return portable(back.select(*WL, "pod", "metric_name", "series_id", "ts", "value"))


@query("matrix_replica_series")
def matrix_replica_series(spark, sf_dir):
    """Replica series read from matrix documents: max across series per instant, floor 0."""
    r = R.resample(E.samples(spark, sf_dir, ["replicas"]))
    r = r.select("*", E.labels_col().alias("labels"), F.col("bucket").alias("ts"))
    docs = MX.samples_to_documents(r, value_format="%s")
    back = MX.matrix_to_samples(docs.select(MX.parse_documents(F.col("document")).alias("d")), "d")
    return portable(MX.matrix_replicas(back))


@query("trigger_json")
def trigger_json(spark, sf_dir):
    pats, stats = _patterns(spark, sf_dir)
    return portable(SK.trigger_json(G.v2_triggers(pats, stats)))


@query("policy_documents")
def policy_documents(spark, sf_dir):
    pats, stats = _patterns(spark, sf_dir)
    return portable(SK.policy_documents(G.v2_triggers(pats, stats)))


@query("run_stats")
def run_stats(spark, sf_dir):
    c, hourly, stats, dm = _profile_parts(spark, sf_dir)
    pats = D.detect(hourly, stats, dm, spark)
    trig = G.v2_triggers(pats, stats)
    return portable(SK.run_stats(R.best_source(R.source_counts(_samples(spark, sf_dir))), pats, trig, c))


# ---------------------------------------------------------------------------
# policy tables
# ---------------------------------------------------------------------------

def _wls(spark, sf_dir):
    return _cut(PO.workloads(E.replica_samples(spark, sf_dir)))


@query("policies_for_hpa")
def policies_for_hpa(spark, sf_dir):
    wls = _wls(spark, sf_dir)
    return portable(PJ.policies_for_hpa(PO.hpa_bounds(wls), PO.policies(wls)))


@query("dangling_refs")
def dangling_refs(spark, sf_dir):
    wls = _wls(spark, sf_dir)
    return portable(PJ.dangling_refs(PO.hpa_bounds(wls), PO.policies(wls)))


def _snapshot(rs, first_half: bool):
    """Policy snapshot of one half of the month: generation = distinct weekdays with samples."""
    half = F.dayofmonth("ts") <= 15
    s = rs.where(half if first_half else ~half)
    g = s.groupBy(*WL).agg(F.countDistinct(F.weekday("ts")).cast("bigint").alias("generation"))
    return PO.policies(g.select(*WL)).drop("generation").join(g, WL)


@query("policy_snapshot_diff")
def policy_snapshot_diff(spark, sf_dir):
    rs = _cut(E.replica_samples(spark, sf_dir))
    return portable(_nullable_as_double(PJ.snapshot_diff(_snapshot(rs, True), _snapshot(rs, False)),
                                        "gen_before", "gen_after"))


@query("namespaces")
def namespaces(spark, sf_dir):
    return portable(PJ.namespaces(PO.policies(_wls(spark, sf_dir)), spark))


# ---------------------------------------------------------------------------
# planned hour-of-day analyzer (our reading of a prose specification)
# ---------------------------------------------------------------------------

# The events span one month, with two points a day and workload: the window is the month up to AS_OF.
PLANNED = PL.PlannedConfig(lookback_days=30)


def _planned_clean(spark, sf_dir):
    return P.clean(_cut(E.replica_samples(spark, sf_dir, as_of=AS_OF, days=PLANNED.lookback_days)))


def _points(spark, sf_dir):
    return _cut(PL.hourly_points(_planned_clean(spark, sf_dir)))


@query("data_gate")
def data_gate(spark, sf_dir):
    return portable(PL.data_gate(_points(spark, sf_dir)))


@query("hour_percentiles")
def hour_percentiles(spark, sf_dir):
    return portable(PL.hour_percentiles(_points(spark, sf_dir)))


@query("weekend_split")
def weekend_split(spark, sf_dir):
    return portable(PL.weekend_split(_points(spark, sf_dir)))


@query("peak_windows")
def peak_windows(spark, sf_dir):
    return portable(PL.peak_windows(_points(spark, sf_dir)))


def _ai_and_manual(spark, sf_dir):
    """One materialised replica series of the planned window feeds workloads, cleaned points and instants."""
    rs = _cut(E.replica_samples(spark, sf_dir, as_of=AS_OF, days=PLANNED.lookback_days))
    wls = _cut(PO.workloads(rs))
    points = _cut(PL.hourly_points(P.clean(rs)))
    gen = _cut(PL.peak_windows(points))
    manual = PO.policy_triggers(spark, wls)
    return rs, wls, gen, manual


@query("manual_overlap")
def manual_overlap(spark, sf_dir):
    _, _, gen, manual = _ai_and_manual(spark, sf_dir)
    return portable(PL.manual_overlap(gen, manual, spark, WEEK))


def _deviation_inputs(spark, sf_dir):
    """Replica samples, the active trigger per instant (generated ``ai-`` and manual triggers
    of each workload) and the bounds of the unsuppressed generated triggers."""
    rs, wls, gen, manual = _ai_and_manual(spark, sf_dir)
    keep = PL.manual_overlap(gen, manual, spark, WEEK).where(~F.col("suppressed")).select(*WL, "name")
    ai = gen.join(keep, WL + ["name"])
    pol = PO.policies(wls).drop("set_id")
    ai_flat = (ai.join(pol, WL)
               .select(*WL, "policy_namespace", "policy_name", "generation", "hpa_namespace", "hpa_name", "name",
                       "priority", F.lit("UTC").alias("timezone"), F.lit(True).alias("has_interval"), "recurring",
                       F.lit(None).cast("string").alias("start_date"), F.lit(None).cast("string").alias("end_date"),
                       "start_time", "end_time", F.col("min_replicas").alias("start_min"),
                       F.col("max_replicas").alias("start_max"), F.lit(None).cast("int").alias("end_min"),
                       F.lit(None).cast("int").alias("end_max"), F.lit(False).alias("suspend"))
               .withColumn("hpa_target_namespace",
                           F.coalesce(F.nullif(F.col("hpa_namespace"), F.lit("")), F.col("policy_namespace"))))
    trig = ai_flat.unionByName(manual.drop("set_id"))
    act = S.active_trigger(S.window_state(rs.select(*WL, "ts"), trig, spark), rs)
    bounds = ai.select(*WL, F.col("name").alias("active_name"), "min_replicas", "max_replicas")
    return rs, act, bounds, trig


@query("deviation")
def deviation(spark, sf_dir):
    """Replica samples outside the bounds of the active generated trigger (manual ones skip)."""
    rs, act, bounds, _ = _deviation_inputs(spark, sf_dir)
    return portable(PL.deviation(rs, act, bounds))


@query("deviation_alert_intervals")
def deviation_alert_intervals(spark, sf_dir):
    """The streaming alert de-duplication run in batch: at most one alert per workload and hour."""
    rs, act, bounds, _ = _deviation_inputs(spark, sf_dir)
    a = rs.join(act, WL + ["ts"]).join(bounds, WL + ["active_name"], "left")
    alerts = J.deviation_alerts(a, interval="1 hour")
    return portable(alerts.select(*WL, "interval_start"))


@query("active_trigger_rowwise")
def active_trigger_rowwise(spark, sf_dir):
    """The streaming evaluation path run in batch: each instant picks its winner from its
    workload's trigger array (no aggregation); must equal ``active_trigger``."""
    inst, _, trig = _schedule_inputs(spark, sf_dir)
    arrays = S.trigger_arrays(trig, spark)
    win = S.active_from_array(F.col("ts"), F.col("triggers"))
    out = inst.join(arrays, WL, "left").select(*WL, "ts", win["name"].alias("active_name"),
                                               win["priority"].alias("active_priority"))
    return portable(_nullable_as_double(out, "active_priority"))


@query("pattern_report")
def pattern_report(spark, sf_dir):
    """Mined patterns per workload as a JSON report with data-point counts."""
    series = _cut(_series(spark, sf_dir))
    f = _cut(K.time_features(R.merged_frame(series)))
    return portable(SK.pattern_report(K.mine_patterns(f), series))


@query("policies_for_changed_hpa")
def policies_for_changed_hpa(spark, sf_dir):
    """Policies to re-evaluate for the HPAs whose workload's policy snapshot changed between the
    two halves of the month (semi-join; each policy once)."""
    rs = _cut(E.replica_samples(spark, sf_dir))
    diff = PJ.snapshot_diff(_snapshot(rs, True), _snapshot(rs, False)).where("status = 'changed'")
    changed = diff.select(F.col("policy_namespace").alias("namespace"),
                          F.regexp_replace("policy_name", "-schedule$", "-hpa").alias("name"))
    wls = PO.workloads(rs)
    return portable(PJ.policies_for_changed(changed, PO.policies(wls)))


@query("policy_documents_roundtrip")
def policy_documents_roundtrip(spark, sf_dir):
    """Generated policy documents parsed back with the fixed schema and exploded to trigger rows."""
    pats, stats = _patterns(spark, sf_dir)
    docs = SK.policy_documents(G.v2_triggers(pats, stats))
    parsed = docs.select(F.from_json("document", PO.POLICY_DOC).alias("d")).select("d.*")
    t = PO.explode_policy_documents(parsed)
    return portable(t.select("policy_namespace", "policy_name", "hpa_target_namespace", "hpa_name", "name",
                             "priority", "timezone", "recurring", "start_time", "end_time", "start_min",
                             "start_max", "end_min", "end_max", "suspend"))


@query("schedule_boundaries")
def schedule_boundaries(spark, sf_dir):
    """Effective bounds at the exact start/end instants of every trigger across each workload's
    data span, collapsed to the instants where the bounds change."""
    rs, wls, trig, span = _spans(spark, sf_dir)
    ticks = S.boundary_instants(trig, span, spark)
    tl = S.schedule_timeline(S.effective_bounds(ticks, trig, PO.hpa_bounds(wls), spark))
    return portable(_nullable_as_double(tl, "min_replicas", "max_replicas"))


def _spans(spark, sf_dir):
    rs = _cut(E.replica_samples(spark, sf_dir))
    wls = _cut(PO.workloads(rs))
    span = _cut(rs.groupBy(*WL).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")))
    return rs, wls, PO.policy_triggers(spark, wls), span


@query("trigger_events")
def trigger_events(spark, sf_dir):
    """Start and end events of every policy across its workload's span, and what each applies."""
    _, _, trig, span = _spans(spark, sf_dir)
    ev = S.trigger_events(trig, span, spark)
    return portable(_nullable_as_double(ev.select("policy_namespace", "policy_name", "ts", "name", "kind", "applied", "mn", "mx"),
                                        "mn", "mx"))


@query("bounds_replay")
def bounds_replay(spark, sf_dir):
    """Bounds of every policy after each of its start and end events, carried forward."""
    _, wls, trig, span = _spans(spark, sf_dir)
    out = S.bounds_replay(S.trigger_events(trig, span, spark), PO.hpa_bounds(wls)).drop("rejected")
    return portable(_nullable_as_double(out, "min_replicas", "max_replicas"))


@query("rejected_updates")
def rejected_updates(spark, sf_dir):
    """The updates of the replay that were rejected, with the reason and the bounds in force."""
    _, wls, trig, span = _spans(spark, sf_dir)
    out = S.rejected_updates(S.bounds_replay(S.trigger_events(trig, span, spark), PO.hpa_bounds(wls)))
    return portable(_nullable_as_double(out, "min_replicas", "max_replicas"))


@query("v1_triggers_most_confident")
def v1_triggers_most_confident(spark, sf_dir):
    """Triggers where workloads have more patterns than triggers are allowed: the two most confident."""
    cfg = AnalysisConfig(max_triggers=2)
    f = _features(spark, sf_dir)
    mined = G.v1_triggers(_cut(K.merge_patterns(_fixed_patterns(f))), cfg)
    return portable(mined.unionByName(G.v1_default_triggers(f.select(*WL), mined, cfg)))


@query("profile_csv")
def profile_csv(spark, sf_dir):
    """The hourly profile written as CSV files in the shared folder and read back."""
    profile, path = P.hourly_profile(_clean(spark, sf_dir)), shared_folder(spark, "csv")
    SK.write_csv(profile, path)
    return portable(spark.read.schema(profile.schema).option("header", True).csv(path))


@query("merged_patterns_fixed")
def merged_patterns_fixed(spark, sf_dir):
    """The chain after fixed labels: patterns, refinement and merge."""
    return portable(K.merge_patterns(_fixed_patterns(_features(spark, sf_dir))))


def _fixed_patterns(f):
    grid = K.slot_grid(f)
    return K.refine_patterns(K.cluster_patterns(grid, K.assign_fixed(K.standardize(grid))), f)


@query("v1_triggers_fixed")
def v1_triggers_fixed(spark, sf_dir):
    """Triggers of the patterns from fixed labels, plus the default for workloads without one."""
    f = _features(spark, sf_dir)
    mined = G.v1_triggers(_cut(K.merge_patterns(_fixed_patterns(f))))
    return portable(mined.unionByName(G.v1_default_triggers(f.select(*WL), mined)))


# ---------------------------------------------------------------------------
# streams: the jobs themselves, run until their input is used up
# ---------------------------------------------------------------------------

SLICES = 3  # of time; a stream gets one after another


def _slices(df):
    """The rows of a table in slices of time, in order."""
    t0, t1 = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if t0 is None:
        return [df]
    at = F.floor((F.unix_micros("ts") - t0) * SLICES / (t1 - t0 + 1))
    return [df.where(at == i) for i in range(SLICES)]


def _source(df, path):
    """A stream over a folder of the table's schema, empty so far."""
    df.limit(0).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _advance(slices, path, run):
    """Add slice after slice to a stream's input and let the query use each up before the next: every
    slice is a micro-batch of its own, and the query goes on from its checkpoint."""
    for part in slices:
        part.write.mode("append").parquet(path)
        run().awaitTermination()


def _streamed(df, job, first=None):
    """The result of a streaming job over a table's slices. ``first``: rows that come with the first."""
    spark, base = df.sparkSession, shared_folder(df.sparkSession, "stream")
    slices = _slices(df)
    if first is not None:
        slices[0] = slices[0].unionByName(first.select(df.columns))
    out = job(_source(df, f"{base}/in"))

    def run():
        return (out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log")
                .outputMode("append").trigger(availableNow=True).start())

    _advance(slices, f"{base}/in", run)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _raw(spark, sf_dir):
    return E.workload_samples(E.read_table(spark, sf_dir, "events"))


@query("stream_resample")
def stream_resample(spark, sf_dir):
    """R1 as a stream: the windows that the watermark closes."""
    return portable(_streamed(_raw(spark, sf_dir), J.resample_stream))


@query("stream_profile")
def stream_profile(spark, sf_dir):
    """R2 as a stream: partials of every day, compacted, and the profile of a two-week window."""
    base, raw = shared_folder(spark, "profile"), _raw(spark, sf_dir)
    source = _source(raw, f"{base}/in")
    _advance(_slices(raw), f"{base}/in", lambda: J.profile_refresh(source, f"{base}/state", f"{base}/log"))
    J.compact_profile(spark, f"{base}/state", f"{base}/compact")
    return portable(J.read_profile(spark, f"{base}/compact", as_of=AS_OF[:10], days=14))


@query("stream_v2_triggers")
def stream_v2_triggers(spark, sf_dir):
    """R2 to the triggers: the streamed value histogram, compacted to the two weeks that end with the
    day before AS_OF, and the triggers mined from it."""
    rs, base = _cut(E.replica_samples(spark, sf_dir)), shared_folder(spark, "histogram")
    source = _source(rs, f"{base}/in")
    _advance(_slices(rs), f"{base}/in", lambda: H.histogram_refresh(source, f"{base}/state", f"{base}/log"))
    H.compact_histogram(spark, f"{base}/state", f"{base}/compact", as_of="2024-01-27", days=13)
    counts = _cut(H.merge_counts(spark.read.parquet(f"{base}/compact")))
    return portable(H.triggers_of_counts(counts, spark))


def _arrays(spark, sf_dir):
    _, _, trig = _schedule_inputs(spark, sf_dir)
    return _cut(S.trigger_arrays(trig, spark))


@query("stream_active_trigger")
def stream_active_trigger(spark, sf_dir):
    """R3 as a stream: each event with its workload's winning trigger."""
    arrays = _arrays(spark, sf_dir)
    out = _streamed(_raw(spark, sf_dir), lambda s: J.active_trigger_stream(s, arrays))
    return portable(_nullable_as_double(out.select(*WL, "ts", "active_name", "active_priority"), "active_priority"))


@query("stream_transitions")
def stream_transitions(spark, sf_dir):
    """R4 as a stream: the changes of the winning trigger."""
    arrays = _arrays(spark, sf_dir)
    return portable(_streamed(_raw(spark, sf_dir), lambda s: J.transitions_stream(J.active_trigger_stream(s, arrays))))


@query("stream_timed_transitions")
def stream_timed_transitions(spark, sf_dir):
    """R4 with timers: the changes of the winning trigger at their own time, up to the watermark; the
    samples only move the clock."""
    _, _, trig, span = _spans(spark, sf_dir)
    plans = J.policy_events(S.trigger_arrays(trig, spark).join(span.select(*WL, "t0"), WL), F.col("t0"))
    clock = _raw(spark, sf_dir).select(*WL, "ts", F.lit(None).cast("string").alias("plan"))
    return portable(_streamed(clock, J.timed_transitions, first=plans))


CHANGED = "2024-01-15 00:00:00"  # the instant from which the second version of the policies holds


@query("stream_policy_versions")
def stream_policy_versions(spark, sf_dir):
    """R3 while policies change: between two micro-batches of the running stream, suspended triggers
    are put in force from the middle of the month on."""
    wls = _cut(PO.workloads(E.replica_samples(spark, sf_dir)))
    raw, base = _raw(spark, sf_dir), shared_folder(spark, "versions")
    source = _source(raw, f"{base}/in")
    changed = F.lit(CHANGED).cast("timestamp")

    def publish(generation, since, everything):
        trig = PO.policy_triggers(spark, wls, include_suspended=everything)
        J.publish_policies(S.trigger_arrays(trig, spark), since, generation, f"{base}/versions")

    def run():
        return J.active_refresh(source, f"{base}/versions", f"{base}/out", f"{base}/log")

    publish(1, F.lit("2024-01-01").cast("timestamp"), False)
    _advance([raw.where(F.col("ts") < changed)], f"{base}/in", run)
    publish(2, changed, True)
    _advance([raw.where(F.col("ts") >= changed)], f"{base}/in", run)
    out = spark.read.parquet(f"{base}/out").select(*WL, "ts", "generation", "active_name", "active_priority")
    return portable(_nullable_as_double(out, "generation", "active_priority"))


@query("stream_deviation_alerts")
def stream_deviation_alerts(spark, sf_dir):
    """R5 as a stream: one alert per workload and hour that the watermark has passed."""
    rs, _, _, trig = _deviation_inputs(spark, sf_dir)
    arrays = _cut(S.trigger_arrays(trig, spark))
    alerts = _streamed(rs, lambda s: J.deviation_alerts(J.active_trigger_stream(s, arrays), interval="1 hour"))
    return portable(alerts.select(*WL, "interval_start", "ts", "active_name", "value"))


@query("stream_resample_batch")
def stream_resample_batch(spark, sf_dir):
    """The streaming 5-minute resample (watermark + tumbling window) run on the whole table in batch."""
    raw = E.workload_samples(E.read_table(spark, sf_dir, "events"))
    return portable(J.resample_stream(raw))


@query("profile_partials_merge")
def profile_partials_merge(spark, sf_dir):
    """The streaming profile state: per-day partial sums (as micro-batches would write them)
    merged into the hourly profile."""
    return portable(J.merge_profile(J.profile_partials(E.replica_samples(spark, sf_dir))))
