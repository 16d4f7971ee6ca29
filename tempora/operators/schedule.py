"""Trigger evaluation: window state, active trigger, effective bounds, timelines, event replay.

Inputs are an ``instants`` table (``namespace, deployment, ts``) and the flat
trigger table of each workload's policies. Instants join the policy's triggers,
held in one array per policy (a handful of triggers), by equality on the
workload; everything about one instant is then decided row by row from that
array, without another shuffle. Where triggers are reported one by one
(``window_state``), instants join the flat trigger table instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.config import DAY_CODES, WL
from tempora.functions import clock as C

# States and error texts of the reports.
START_ERROR, END_ERROR = "failed to parse start time", "failed to parse end time"
NEGATIVE_MIN, NO_MAX = "minReplicas cannot be negative", "maxReplicas must be greater than 0"
MIN_OVER_MAX = "minReplicas (%d) cannot be greater than maxReplicas (%d)"
STATE_UNKNOWN, STATE_BEFORE, STATE_WITHIN, STATE_AFTER = "Unknown", "Before", "Within", "After"


def prepare_triggers(triggers: DataFrame, spark: SparkSession) -> DataFrame:
    """Per-trigger constants computed once on the (small) trigger table: resolved zone (UTC without
    a ``timezone`` column), start/end minutes, time-text error, recurrence codes and the date
    range as instants."""
    t = C.with_zone(triggers, spark, "timezone", "zone") if "timezone" in triggers.columns else triggers.withColumn("zone", F.lit("UTC"))
    rec = F.coalesce(F.col("recurring"), F.lit(""))
    sd, ed = F.coalesce(F.col("start_date"), F.lit("")), F.coalesce(F.col("end_date"), F.lit(""))
    err = (F.when(~C.clock_ok(F.col("start_time")), F.lit(START_ERROR))
            .when(~C.clock_ok(F.col("end_time")), F.lit(END_ERROR)))
    gate_kind = (F.when(~F.coalesce(F.col("has_interval"), F.lit(False)), F.lit("none"))
                  .when(rec != "", F.lit("recurring"))
                  .when((sd != "") & (ed != ""),
                        F.when(C.date_text_ok(sd) & C.date_text_ok(ed), F.lit("range")).otherwise(F.lit("none")))
                  .otherwise(F.lit("none")))
    return t.select("*",
                    C.clock_minutes(F.col("start_time")).alias("_s"), C.clock_minutes(F.col("end_time")).alias("_e"),
                    err.alias("_err"), gate_kind.alias("_gate"), C.recurring_codes(rec).alias("_codes"),
                    F.try_to_timestamp(sd, F.lit("yyyy-MM-dd")).alias("_sd"),
                    F.try_to_timestamp(ed, F.lit("yyyy-MM-dd")).alias("_ed"))


def state_columns(ts: F.Column, t) -> tuple[F.Column, F.Column, F.Column]:
    """(local wall clock, state, error) of one prepared trigger ``t`` (columns or struct fields)
    at one instant; usable inside lambdas."""
    local = F.from_utc_timestamp(ts, t["zone"])
    cur = F.hour(local) * 60 + F.minute(local)
    s, e, err = t["_s"], t["_e"], t["_err"]
    gate = (F.when(t["_gate"] == "recurring", F.array_contains(t["_codes"], C.local_day_code(local)))
             .when(t["_gate"] == "range", F.coalesce((ts > t["_sd"]) & (ts < t["_ed"]), F.lit(False)))
             .otherwise(F.lit(False)))
    state = (F.when(err.isNotNull(), F.lit(STATE_UNKNOWN))
              .when(~gate, F.lit(STATE_UNKNOWN))
              .when(C.in_window(cur, s, e), F.lit(STATE_WITHIN))
              .when(cur >= e, F.lit(STATE_AFTER))
              .otherwise(F.lit(STATE_BEFORE)))
    return local, state, err


class _Cols:
    def __getitem__(self, k):
        return F.col(k)


def window_state(instants: DataFrame, triggers: DataFrame, spark: SparkSession) -> DataFrame:
    """State of every trigger at every instant of its workload.

    Time-text errors give Unknown with an error (checked before the day gate);
    a closed day gate gives Unknown; else Within (half-open, wraps midnight),
    After when the local minute is at or past the end, else Before. Seconds are
    dropped; the local clock is the trigger zone's (unknown zone -> UTC).
    Trigger text is parsed once per trigger, not per instant.
    """
    j = instants.join(prepare_triggers(triggers, spark), WL)
    local, state, err = state_columns(F.col("ts"), _Cols())
    return j.select(*WL, "ts", "policy_namespace", "policy_name", "hpa_target_namespace", "hpa_name",
                    "name", F.coalesce(F.col("priority"), F.lit(0)).alias("priority"),
                    "start_min", "start_max", "end_min", "end_max",
                    local.alias("local_ts"), state.alias("state"), err.alias("error"))


def _items(triggers: DataFrame, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Prepared triggers as structs, those of one name within ``keys`` reduced to the one of the highest
    priority (then of the least configuration, so ties are settled by the columns)."""
    t = prepare_triggers(triggers, spark).withColumn("priority", F.coalesce(F.col("priority"), F.lit(0)))
    rest = ["zone", "_s", "_e", "_err", "_gate", "_codes", "_sd", "_ed", "start_min", "start_max", "end_min", "end_max"]
    one = F.min(F.struct((-F.col("priority")).alias("np"), *rest)).alias("x")
    return t.groupBy(*keys, "name").agg(one).select(
        *keys, F.struct("x.np", "name", (-F.col("x.np")).alias("priority"), *[f"x.{c}" for c in rest]).alias("item"))


def trigger_arrays(triggers: DataFrame, spark: SparkSession) -> DataFrame:
    """One row per workload with all its prepared triggers in an array (bounded by the policy size).

    This is the static side for streams: each arriving sample evaluates its
    workload's triggers row by row, with no streaming aggregation or state.
    """
    return _items(triggers, spark, WL).groupBy(*WL).agg(F.array_sort(F.collect_list("item")).alias("triggers"))


POLICY = ["policy_namespace", "policy_name", "hpa_target_namespace", "hpa_name"]


def policy_arrays(triggers: DataFrame, spark: SparkSession) -> DataFrame:
    """One row per policy with its prepared triggers, by priority (descending) and name."""
    keys = WL + POLICY
    return _items(triggers, spark, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("triggers"))


def active_from_array(ts: F.Column, triggers: F.Column) -> F.Column:
    """Winning Within trigger (struct with name, priority, start_min, start_max) from a trigger array."""
    cands = F.transform(F.filter(triggers, lambda x: state_columns(ts, x)[1] == STATE_WITHIN),
                        lambda x: F.struct((-x["priority"]).alias("np"), x["name"].alias("name"),
                                           x["priority"].alias("priority"), x["start_min"].alias("start_min"),
                                           x["start_max"].alias("start_max")))
    return F.try_element_at(F.array_sort(cands), F.lit(1))


def active_trigger(states: DataFrame, instants: DataFrame) -> DataFrame:
    """Winning Within trigger per (workload, instant): highest priority, then name ascending. Instants
    of a workload without triggers have none."""
    within = F.col("state") == STATE_WITHIN
    pick = F.min(F.when(within, F.struct((-F.col("priority")).alias("np"), F.col("name").alias("name"))))
    won = (states.groupBy(*WL, "ts")
           .agg(pick.alias("_w"), F.count(F.when(within, 1)).alias("n_within"))
           .select(*WL, "ts", F.col("_w.name").alias("active_name"),
                   (-F.col("_w.np")).alias("active_priority"), "n_within"))
    return instants.select(*WL, "ts").distinct().join(won, WL + ["ts"], "left").withColumn(
        "n_within", F.coalesce("n_within", F.lit(0).cast("bigint")))


def higher_priority_active(states: DataFrame) -> DataFrame:
    """Per trigger and instant: does another Within trigger have strictly higher priority?"""
    w = Window.partitionBy(*WL, "ts")
    top = F.max(F.when(F.col("state") == STATE_WITHIN, F.col("priority"))).over(w)
    return states.select(*WL, "ts", "name", "priority", "state",
                         F.coalesce(top > F.col("priority"), F.lit(False)).alias("higher_active"))


def _apply(acc, x):
    """Override non-null bounds; reject the whole update when invalid."""
    mn = F.coalesce(x["mn"], acc["mn"])
    mx = F.coalesce(x["mx"], acc["mx"])
    bad = (F.coalesce(x["mn"] < 0, F.lit(False)) | F.coalesce(x["mx"] <= 0, F.lit(False))
           | F.coalesce(mn > mx, F.lit(False)))
    return F.when(bad, acc).otherwise(F.struct(mn.alias("mn"), mx.alias("mx")))


def rejection(acc, x):
    """Why a config is rejected under the bounds in force, in the order of the checks; null if it isn't."""
    mn, mx = F.coalesce(x["mn"], acc["mn"]), F.coalesce(x["mx"], acc["mx"])
    return (F.when(x["mn"] < 0, F.lit(NEGATIVE_MIN)).when(x["mx"] <= 0, F.lit(NO_MAX))
             .when(mn > mx, F.format_string(MIN_OVER_MAX, mn, mx)))


def _hpa(bounds: DataFrame) -> DataFrame:
    return bounds.select(F.col("namespace").alias("hpa_target_namespace"), F.col("name").alias("hpa_name"),
                         F.col("min_replicas").alias("cur_min"), F.col("max_replicas").alias("cur_max"))


def effective_bounds(instants: DataFrame, triggers: DataFrame, bounds: DataFrame, spark: SparkSession) -> DataFrame:
    """Replica bounds of each policy at each instant, rebuilt from scratch.

    Triggers are taken by priority (descending, name ascending), each name once.
    When any trigger is Within, the Within triggers of the top priority apply
    their start configs; otherwise every After trigger applies its end config
    in that order (the lowest priority lands last). Invalid configs leave the
    bounds unchanged. The starting bounds are the HPA's current ones. Instants of
    a workload without a live trigger come out without bounds. One join of
    instants with policy arrays; each row is then decided on its own.
    """
    j = (instants.join(policy_arrays(triggers, spark), WL, "left")
         .join(_hpa(bounds), ["hpa_target_namespace", "hpa_name"], "left"))
    seen = F.transform(F.col("triggers"), lambda x: F.struct(
        x["np"].alias("np"), state_columns(F.col("ts"), x)[1].alias("state"),
        F.struct(x["start_min"].alias("mn"), x["start_max"].alias("mx")).alias("start"),
        F.struct(x["end_min"].alias("mn"), x["end_max"].alias("mx")).alias("end")))
    j = j.withColumn("_seen", F.coalesce(seen, F.array().cast(j.select(seen.alias("s")).schema["s"].dataType)))
    j = (j.withColumn("_w", F.filter("_seen", lambda x: x["state"] == STATE_WITHIN))
          .withColumn("_a", F.filter("_seen", lambda x: x["state"] == STATE_AFTER)))
    top = F.get(F.col("_w"), F.lit(0))["np"]
    steps = F.when(F.size("_w") > 0, F.transform(F.filter("_w", lambda x: x["np"] == top), lambda x: x["start"])) \
        .otherwise(F.transform("_a", lambda x: x["end"]))
    folded = F.aggregate(steps, F.struct(F.col("cur_min").alias("mn"), F.col("cur_max").alias("mx")), _apply)
    missing = F.col("cur_max").isNull()
    return j.select(*WL, "policy_namespace", "policy_name", "ts",
                    F.when(F.size("_w") > 0, F.lit("start")).when(F.size("_a") > 0, F.lit("end"))
                     .otherwise(F.lit("none")).alias("source"),
                    F.when(missing, F.lit(None)).otherwise(folded["mn"]).alias("min_replicas"),
                    F.when(missing, F.lit(None)).otherwise(folded["mx"]).alias("max_replicas"),
                    F.when(F.col("policy_name").isNull(), F.lit("no policy"))
                     .when(missing, F.lit("hpa not found")).alias("error"))


def schedule_timeline(bounds_at: DataFrame) -> DataFrame:
    """Collapse equal neighbours: keep the instants where a policy's bounds change.

    The window is per policy in time order over instants already reduced to
    the sample step, so one partition holds at most span/step rows.
    """
    w = Window.partitionBy(*WL, "policy_namespace", "policy_name").orderBy("ts")
    prev = F.struct(F.lag("min_replicas").over(w).alias("a"), F.lag("max_replicas").over(w).alias("b"))
    cur = F.struct(F.col("min_replicas").alias("a"), F.col("max_replicas").alias("b"))
    first = F.row_number().over(w) == 1
    return (bounds_at.withColumn("_chg", first | ~cur.eqNullSafe(prev))
            .where("_chg").drop("_chg"))


def trigger_transitions(active: DataFrame) -> DataFrame:
    """Instants where the winning trigger changes (from -> to), per workload."""
    w = Window.partitionBy(*WL).orderBy("ts")
    prev = F.lag("active_name").over(w)
    first = F.row_number().over(w) == 1
    return (active.select(*WL, "ts", prev.alias("from_trigger"), F.col("active_name").alias("to_trigger"),
                          first.alias("_first"))
            .where(F.col("_first") | ~F.col("from_trigger").eqNullSafe(F.col("to_trigger")))
            .drop("_first"))


def cron_plan(triggers: DataFrame) -> DataFrame:
    """Start/end cron text per trigger (NULL when the clock text is invalid)."""
    return triggers.select("policy_namespace", "policy_name", "name",
                           C.cron_text(F.col("start_time"), F.col("recurring")).alias("start_cron"),
                           C.cron_text(F.col("end_time"), F.col("recurring")).alias("end_cron"),
                           C.cron_weekdays(F.col("recurring")).alias("cron_weekdays"))


def trigger_validation(triggers: DataFrame, spark: SparkSession) -> DataFrame:
    """One row per violated rule per trigger."""
    t = triggers.join(F.broadcast(C.valid_zones(spark)), triggers["timezone"] == F.col("zone_name"), "left")

    def cfg_bad(mn, mx):
        return (F.coalesce(F.col(mn) < 0, F.lit(False)) | F.coalesce(F.col(mx) <= 0, F.lit(False))
                | F.coalesce(F.col(mn) > F.col(mx), F.lit(False)))

    rules = [
        ("start_time_invalid", ~C.clock_ok(F.col("start_time"))),
        ("end_time_invalid", ~C.clock_ok(F.col("end_time"))),
        ("no_valid_interval", ~(F.coalesce(F.col("has_interval"), F.lit(False))
                                & ((F.coalesce(F.col("recurring"), F.lit("")) != "")
                                   | ((F.coalesce(F.col("start_date"), F.lit("")) != "")
                                      & (F.coalesce(F.col("end_date"), F.lit("")) != ""))))),
        ("unknown_timezone", (F.coalesce(F.col("timezone"), F.lit("")) != "") & F.col("zone_name").isNull()),
        ("start_config_invalid", cfg_bad("start_min", "start_max")),
        ("end_config_invalid", cfg_bad("end_min", "end_max")),
        ("hpa_ref_missing", F.coalesce(F.col("hpa_name"), F.lit("")) == ""),
    ]
    if "interval_timezone" in triggers.columns:
        rules.append(("zone_under_interval", F.col("interval_timezone").isNotNull()))
    arr = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return (t.select("policy_namespace", "policy_name", "name", F.explode(arr).alias("rule")))


def _local_ticks(t: DataFrame, minutes: F.Column) -> DataFrame:
    """UTC instants of clock minutes of every local day in the span of each prepared trigger."""
    day = F.explode(F.sequence(F.date_sub(F.to_date("t0"), 1), F.date_add(F.to_date("t1"), 1)))
    d = t.select("*", day.alias("day")).select("*", F.posexplode(minutes).alias("which", "m"))
    local = F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + F.col("m") * 60)
    return (d.withColumn("local_ts", local).withColumn("ts", F.to_utc_timestamp(local, F.col("zone")))
            .where(F.col("ts").between(F.col("t0"), F.col("t1"))))


def boundary_instants(triggers: DataFrame, span: DataFrame, spark: SparkSession) -> DataFrame:
    """Instants at which a bound rebuilt from scratch can change, for each workload's span.

    ``span`` has one row per workload with ``t0``/``t1`` (the instants to cover). These are the
    span's start; the start, the end and the midnight of every local day of each trigger, by its
    zone; the minutes of days on which a trigger's zone shifts its clock; and the first second in
    and after a date range. Work grows with triggers x days.
    """
    t = prepare_triggers(triggers, spark).where(F.col("_err").isNull()).join(span, WL)
    clock = _local_ticks(t, F.array("_s", "_e", F.lit(0))).select(*WL, "ts")
    dates = (t.where(F.col("_gate") == "range")
             .select(*WL, "t0", "t1", F.explode(F.array(F.timestamp_seconds(F.unix_seconds("_sd") + 1), F.col("_ed"))).alias("ts"))
             .where(F.col("ts").between(F.col("t0"), F.col("t1"))).select(*WL, "ts"))
    return (clock.unionByName(dates).unionByName(_shift_ticks(t)).unionByName(span.select(*WL, F.col("t0").alias("ts"))).distinct())


def _shift_ticks(t: DataFrame) -> DataFrame:
    """Every minute of the UTC days on which a zone's clock is shifted: minutes of the day then come
    twice or not at all."""
    midnight = F.explode(F.sequence(F.date_trunc("day", F.col("t0")) - F.expr("INTERVAL 1 DAY"), F.col("t1"), F.expr("INTERVAL 1 DAY")))
    d = t.select(*WL, "t0", "t1", "zone").distinct().select("*", midnight.alias("day"))
    ahead = lambda at: F.unix_seconds(F.from_utc_timestamp(at, F.col("zone"))) - F.unix_seconds(at)
    shifted = d.where(ahead(F.col("day")) != ahead(F.col("day") + F.expr("INTERVAL 1 DAY")))
    minute = F.explode(F.sequence(F.lit(0), F.lit(1439)))
    return (shifted.select("*", minute.alias("m")).withColumn("ts", F.timestamp_seconds(F.unix_seconds("day") + F.col("m") * 60))
            .where(F.col("ts").between(F.col("t0"), F.col("t1"))).select(*WL, "ts"))


def winner_changes(triggers: DataFrame, span: DataFrame, spark: SparkSession) -> DataFrame:
    """``from_ts`` and the winning trigger (``active_name, active_priority``) from there on, for each
    workload of ``span`` and each instant at which the winner changes, the span's start included."""
    at = boundary_instants(triggers, span, spark)
    j = at.join(trigger_arrays(triggers, spark), WL, "left")
    win = active_from_array(F.col("ts"), F.coalesce(F.col("triggers"), F.array().cast(j.schema["triggers"].dataType)))
    won = j.select(*WL, F.col("ts").alias("from_ts"), win["name"].alias("active_name"), win["priority"].alias("active_priority"))
    w = Window.partitionBy(*WL).orderBy("from_ts")
    same = F.lag("active_name").over(w).eqNullSafe(F.col("active_name")) & (F.row_number().over(w) > 1)
    return won.withColumn("_same", same).where(~F.col("_same")).drop("_same")


def by_interval(instants: DataFrame, changes: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Each instant with the ``payload`` of the last change at or before it.

    A change holds until the next one of its ``keys``; these intervals are dealt to the days that
    they touch and meet the instants by key and day, so every instant meets the intervals of its
    own day and not all changes of the key. Instants before the first change get nulls.
    """
    w = Window.partitionBy(*keys).orderBy("from_ts")
    to = F.lead("from_ts").over(w)
    last = F.lit(instants.agg(F.max("ts")).first()[0]).cast("timestamp")
    days = F.sequence(F.to_date("from_ts"), F.greatest(F.to_date("from_ts"), F.to_date(F.coalesce("to_ts", last))))
    held = changes.select(*keys, "from_ts", *payload).withColumn("to_ts", to).withColumn("_day", F.explode(days))
    i, h = instants.withColumn("_day", F.to_date("ts")).alias("i"), held.alias("h")
    on = [F.col(f"i.{k}") == F.col(f"h.{k}") for k in [*keys, "_day"]]
    on += [F.col("i.ts") >= F.col("h.from_ts"), F.col("h.to_ts").isNull() | (F.col("i.ts") < F.col("h.to_ts"))]
    return i.join(h, on, "left").select(*[F.col(f"i.{c}") for c in instants.columns], *[F.col(f"h.{c}") for c in payload])


def _fires_on(local_ts: F.Column) -> F.Column:
    """Whether a trigger's clock jobs run on a local day: on the known days of its recurrence; every
    day if it has none, dated triggers included."""
    known = F.filter("_codes", lambda c: c.isin(*DAY_CODES))
    return (F.size(known) == 0) | F.array_contains(known, C.local_day_code(local_ts))


def trigger_events(triggers: DataFrame, span: DataFrame, spark: SparkSession) -> DataFrame:
    """Start, end and refresh events of each policy, and what each of them applies.

    A trigger with a recurrence or a date range starts and ends on the local days of its recurrence,
    a dated one every day. At a start its start config is applied, unless another trigger of higher
    priority is Within. At an end nothing happens while another trigger of higher priority is Within;
    else the next trigger's start config is applied (triggers that are Within, by priority and name),
    or, if there is none, the ended trigger's own end config. At the span's start and at every 00:00
    UTC all triggers are set up anew: those of the top priority that are Within apply their start
    configs, or, if none is Within, all that are After their end configs; a row each. Columns: the
    policy, ``ts``, ``name``, ``kind`` (start, end or refresh), ``applied`` (the trigger whose config
    is applied, null for none), ``mn`` and ``mx``.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    live = F.coalesce(F.col("has_interval"), F.lit(False)) & (text("recurring") | (text("start_date") & text("end_date")))
    t = prepare_triggers(triggers, spark).where(F.col("_err").isNull() & live).join(span, WL)
    ev = _local_ticks(t, F.array("_s", "_e")).where(_fires_on(F.col("local_ts")))
    ev = ev.select(*WL, *POLICY, "ts", "name", F.coalesce(F.col("priority"), F.lit(0)).alias("priority"),
                   F.when(F.col("which") == 0, F.lit("start")).otherwise(F.lit("end")).alias("kind"),
                   F.struct("name", F.col("start_min").alias("mn"), F.col("start_max").alias("mx")).alias("own_start"),
                   F.struct("name", F.col("end_min").alias("mn"), F.col("end_max").alias("mx")).alias("own_end"))
    arrays = policy_arrays(triggers, spark)
    j = ev.join(arrays, WL + POLICY)
    others = F.filter("triggers", lambda x: (x["name"] != F.col("name")) & (state_columns(F.col("ts"), x)[1] == STATE_WITHIN))
    j = j.withColumn("_others", others)
    j = j.withColumn("_next", F.get("_others", F.lit(0)))
    higher = F.exists("_others", lambda x: x["priority"] > F.col("priority"))
    next_start = F.struct(F.col("_next")["name"].alias("name"), F.col("_next")["start_min"].alias("mn"), F.col("_next")["start_max"].alias("mx"))
    chosen = (F.when((F.col("kind") == "start") & ~higher, F.col("own_start"))
               .when((F.col("kind") == "end") & F.col("_next").isNull(), F.col("own_end"))
               .when((F.col("kind") == "end") & (F.col("_next")["priority"] <= F.col("priority")), next_start))
    cols = [*WL, *POLICY, "ts", "name", "priority", "kind"]
    timed = j.select(*cols, chosen.alias("c")).select(*cols, F.col("c.name").alias("applied"), F.col("c.mn").alias("mn"), F.col("c.mx").alias("mx"))
    return timed.unionByName(_refresh_events(arrays, span).select(*timed.columns))


def _refresh_events(arrays: DataFrame, span: DataFrame) -> DataFrame:
    """What setting up all triggers anew applies, at the span's start and at every 00:00 UTC in it."""
    midnight = F.sequence(F.date_trunc("day", F.col("t0")), F.col("t1"), F.expr("INTERVAL 1 DAY"))
    at = F.array_distinct(F.concat(F.array("t0"), F.filter(midnight, lambda x: x >= F.col("t0"))))
    seen = F.transform("triggers", lambda x: F.struct(x.alias("x"), state_columns(F.col("ts"), x)[1].alias("state")))
    j = arrays.join(span, WL).select(*WL, *POLICY, "triggers", F.explode(at).alias("ts")).withColumn("_seen", seen)
    j = j.withColumn("_w", F.filter("_seen", lambda y: y["state"] == STATE_WITHIN))

    def config(y, which):
        return F.struct(y["x"]["name"].alias("name"), y["x"]["priority"].alias("priority"), y["x"][f"{which}_min"].alias("mn"), y["x"][f"{which}_max"].alias("mx"))

    top = F.get("_w", F.lit(0))["x"]["priority"]
    starts = F.transform(F.filter("_w", lambda y: y["x"]["priority"] == top), lambda y: config(y, "start"))
    ends = F.transform(F.filter("_seen", lambda y: y["state"] == STATE_AFTER), lambda y: config(y, "end"))
    rows = j.select(*WL, *POLICY, "ts", F.explode(F.when(F.size("_w") > 0, starts).otherwise(ends)).alias("c"))
    return rows.select(*WL, *POLICY, "ts", "c.name", "c.priority", F.lit("refresh").alias("kind"), F.col("c.name").alias("applied"), "c.mn", "c.mx")


def bounds_replay(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bounds of each policy after each of its events, carried forward from event to event.

    A fold over the policy's events in order (time; ends, starts, refreshes; priority descending; name):
    a config replaces the bounds it names, a config that is invalid together with the bounds in force
    is rejected, an event that applies nothing changes nothing. Unlike ``effective_bounds``, which
    rebuilds the bounds of any instant from the triggers' states alone, bounds stay as the last event
    left them. A policy has at most three events a trigger and day of the span, whatever the samples.
    ``rejected``: the reason if the event's config was rejected (see ``rejected_updates``).
    """
    order = F.when(F.col("kind") == "end", 0).when(F.col("kind") == "start", 1).otherwise(2)
    one = F.struct("ts", order.alias("later"), (-F.col("priority")).alias("np"), "name", "kind", "applied", "mn", "mx")
    g = (events.groupBy(*WL, *POLICY).agg(F.array_sort(F.collect_list(one)).alias("ev"))
         .join(_hpa(bounds), ["hpa_target_namespace", "hpa_name"], "left"))
    state = F.struct(F.col("cur_min").alias("mn"), F.col("cur_max").alias("mx"), F.lit(None).cast("string").alias("rejected"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        now = F.struct(last["mn"].alias("mn"), last["mx"].alias("mx"))
        new = _apply(now, x)
        return F.concat(acc, F.array(F.struct(new["mn"].alias("mn"), new["mx"].alias("mx"), rejection(now, x).alias("rejected"))))

    after = F.aggregate("ev", F.array(state), step, lambda a: F.slice(a, F.lit(2), F.size(a)))
    rows = g.select(*WL, *POLICY, "cur_max", F.posexplode(F.arrays_zip("ev", after.alias("after"))).alias("i", "x"))
    missing = F.col("cur_max").isNull()
    return rows.select(*WL, "policy_namespace", "policy_name", (F.col("i") + 1).alias("event"), F.col("x.ev.ts").alias("ts"),
                       F.col("x.ev.name").alias("name"), F.col("x.ev.kind").alias("kind"), F.col("x.ev.applied").alias("applied"),
                       F.when(~missing, F.col("x.after.mn")).alias("min_replicas"),
                       F.when(~missing, F.col("x.after.mx")).alias("max_replicas"),
                       F.when(missing, F.lit("hpa not found")).alias("error"),
                       F.when(~missing, F.col("x.after.rejected")).alias("rejected"))


def rejected_updates(replayed: DataFrame) -> DataFrame:
    """The events of ``bounds_replay`` whose config was rejected, with the reason and the bounds that
    stayed in force."""
    return replayed.where(F.col("rejected").isNotNull()).select(
        *WL, "policy_namespace", "policy_name", "event", "ts", "name", "kind", "applied", F.col("rejected").alias("reason"), "min_replicas", "max_replicas")
