"""Trigger evaluation cases (window state, day gate, zones, effective bounds, transitions)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tempora.operators import schedule as S
from tempora.sources.policies import triggers_frame

WD = "M,TU,W,TH,F"


def instants(spark, stamps, namespace="default", deployment="app"):
    rows = [(namespace, deployment, datetime.fromisoformat(s)) for s in stamps]
    return spark.createDataFrame(rows, "namespace string, deployment string, ts timestamp")


def states(spark, trig_rows, stamps, **kw):
    t = triggers_frame(spark, trig_rows, **kw)
    st = S.window_state(instants(spark, stamps), t, spark)
    return {(r["ts"].strftime("%Y-%m-%d %H:%M"), r["name"]): (r["state"], r["error"]) for r in st.collect()}


def bounds_at(spark, trig_rows, stamps, cur=(1, 5), hpa_exists=True):
    t = triggers_frame(spark, trig_rows)
    hpa = spark.createDataFrame([("default", "app-hpa" if hpa_exists else "other", cur[0], cur[1])],
                                "namespace string, name string, min_replicas int, max_replicas int")
    out = S.effective_bounds(instants(spark, stamps), t, hpa, spark).collect()
    return {r["ts"].strftime("%H:%M"): (r["min_replicas"], r["max_replicas"], r["error"]) for r in out}


def test_window_state_table(spark):
    trig = [{"name": "t", "recurring": WD, "start_time": "09:00:00", "end_time": "17:00:00"}]
    got = states(spark, trig, ["2024-03-20 12:00:00", "2024-03-20 08:00:00", "2024-03-20 18:00:00"])
    assert got[("2024-03-20 12:00", "t")] == ("Within", None)
    assert got[("2024-03-20 08:00", "t")] == ("Before", None)
    assert got[("2024-03-20 18:00", "t")] == ("After", None)


def test_invalid_start_time_is_unknown_with_error(spark):
    trig = [{"name": "t", "recurring": WD, "start_time": "invalid", "end_time": "17:00:00"}]
    got = states(spark, trig, ["2024-03-20 12:00:00"])
    assert got[("2024-03-20 12:00", "t")] == ("Unknown", "failed to parse start time")


def test_time_errors_checked_before_day_gate(spark):
    trig = [{"name": "t", "recurring": "SAT", "start_time": "09:00:00", "end_time": "25:00:00"}]
    got = states(spark, trig, ["2024-03-20 12:00:00"])
    assert got[("2024-03-20 12:00", "t")] == ("Unknown", "failed to parse end time")


@pytest.mark.parametrize("stamp,expected", [
    ("2024-03-18 10:00:00", "Within"),   # Monday
    ("2024-03-22 10:00:00", "Within"),   # Friday
    ("2024-03-23 10:00:00", "Unknown"),  # Saturday
    ("2024-03-24 10:00:00", "Unknown"),  # Sunday
])
def test_day_gate_weekdays(spark, stamp, expected):
    trig = [{"name": "t", "recurring": WD, "start_time": "09:00:00", "end_time": "17:00:00"}]
    assert states(spark, trig, [stamp])[(stamp[:16], "t")][0] == expected


def test_day_gate_empty_interval_and_bad_dates(spark):
    trig = [
        {"name": "none", "has_interval": False, "start_time": "00:00:00", "end_time": "23:00:00"},
        {"name": "empty", "recurring": "", "start_time": "00:00:00", "end_time": "23:00:00"},
        {"name": "with-time", "start_date": "2024-03-01T09:00:00-07:00", "end_date": "2024-04-01",
         "start_time": "00:00:00", "end_time": "23:00:00"},
    ]
    got = states(spark, trig, ["2024-03-20 12:00:00"])
    assert {k[1]: v[0] for k, v in got.items()} == {"none": "Unknown", "empty": "Unknown", "with-time": "Unknown"}


def test_date_range_bounds_strict_at_utc_midnight(spark):
    trig = [{"name": "d", "start_date": "2024-03-10", "end_date": "2024-03-20", "start_time": "00:00:00",
             "end_time": "23:59:00", "timezone": "America/Los_Angeles"}]
    got = states(spark, trig, ["2024-03-10 00:00:00", "2024-03-10 00:05:00", "2024-03-19 23:55:00",
                               "2024-03-20 00:00:00"])
    assert got[("2024-03-10 00:00", "d")][0] == "Unknown"
    assert got[("2024-03-10 00:05", "d")][0] == "Within"   # 17:05 local on the 9th, range gate is UTC
    assert got[("2024-03-19 23:55", "d")][0] == "Within"
    assert got[("2024-03-20 00:00", "d")][0] == "Unknown"


def test_invalid_zone_behaves_as_utc(spark):
    trig = [{"name": "z", "recurring": WD, "timezone": "Invalid/Timezone", "start_time": "09:00:00",
             "end_time": "17:00:00"},
            {"name": "e", "recurring": WD, "timezone": "", "start_time": "09:00:00", "end_time": "17:00:00"}]
    got = states(spark, trig, ["2024-03-20 12:00:00"])
    assert got[("2024-03-20 12:00", "z")][0] == "Within"
    assert got[("2024-03-20 12:00", "e")][0] == "Within"


def test_zone_shifts_local_clock(spark):
    trig = [{"name": "la", "recurring": WD, "timezone": "America/Los_Angeles", "start_time": "09:00:00",
             "end_time": "17:00:00"}]
    got = states(spark, trig, ["2024-03-20 17:00:00", "2024-03-20 15:00:00"])
    assert got[("2024-03-20 17:00", "la")][0] == "Within"   # 10:00 PDT
    assert got[("2024-03-20 15:00", "la")][0] == "Before"   # 08:00 PDT


def test_overnight_window_uses_todays_day_code(spark):
    trig = [{"name": "n", "recurring": "F", "start_time": "22:00:00", "end_time": "06:00:00"}]
    got = states(spark, trig, ["2024-03-22 02:00:00", "2024-03-22 23:00:00", "2024-03-23 02:00:00"])
    assert got[("2024-03-22 02:00", "n")][0] == "Within"
    assert got[("2024-03-22 23:00", "n")][0] == "Within"
    assert got[("2024-03-23 02:00", "n")][0] == "Unknown"


def test_seconds_dropped_and_empty_window(spark):
    trig = [{"name": "end", "recurring": WD, "start_time": "00:00:00", "end_time": "23:59:59"},
            {"name": "same", "recurring": WD, "start_time": "10:00:00", "end_time": "10:00:00"}]
    got = states(spark, trig, ["2024-03-20 23:59:30", "2024-03-20 10:00:00"])
    assert got[("2024-03-20 23:59", "end")][0] == "After"
    assert got[("2024-03-20 10:00", "same")][0] == "After"
    assert got[("2024-03-20 23:59", "same")][0] == "After"


def test_unknown_codes_are_ignored(spark):
    trig = [{"name": "x", "recurring": "W, XX", "start_time": "09:00:00", "end_time": "17:00:00"}]
    assert states(spark, trig, ["2024-03-20 12:00:00"])[("2024-03-20 12:00", "x")][0] == "Within"


def test_effective_bounds_over_a_day(spark):
    trig = [
        {"name": "business-hours", "priority": 10, "recurring": WD, "start_time": "09:00:00",
         "end_time": "17:00:00", "start_min": 3, "start_max": 10, "end_min": 1, "end_max": 5},
        {"name": "peak-hours", "priority": 20, "recurring": WD, "start_time": "11:00:00",
         "end_time": "14:00:00", "start_min": 5, "start_max": 15, "end_min": 1, "end_max": 5},
    ]
    got = bounds_at(spark, trig, ["2024-03-20 08:00:00", "2024-03-20 09:30:00", "2024-03-20 11:30:00",
                                  "2024-03-20 14:30:00", "2024-03-20 17:30:00"])
    assert {k: v[:2] for k, v in got.items()} == {
        "08:00": (1, 5), "09:30": (3, 10), "11:30": (5, 15), "14:30": (3, 10), "17:30": (1, 5)}


@pytest.mark.parametrize("cfg,expected", [
    ((3, 10), (3, 10)),
    ((-1, 10), (1, 5)),
    ((3, 0), (1, 5)),
    ((5, 3), (1, 5)),
    ((None, 8), (1, 8)),
])
def test_bounds_validation(spark, cfg, expected):
    trig = [{"name": "t", "recurring": WD, "start_time": "00:00:00", "end_time": "23:00:00",
             "start_min": cfg[0], "start_max": cfg[1]}]
    got = bounds_at(spark, trig, ["2024-03-20 12:00:00"])
    assert got["12:00"][:2] == expected


def test_bounds_hpa_missing_is_error(spark):
    trig = [{"name": "t", "recurring": WD, "start_time": "00:00:00", "end_time": "23:00:00",
             "start_min": 3, "start_max": 10}]
    got = bounds_at(spark, trig, ["2024-03-20 12:00:00"], hpa_exists=False)
    assert got["12:00"] == (None, None, "hpa not found")


def test_lowest_priority_after_trigger_lands_last(spark):
    trig = [{"name": "hi", "priority": 50, "recurring": WD, "start_time": "01:00:00", "end_time": "02:00:00",
             "end_min": 2, "end_max": 6},
            {"name": "lo", "priority": 10, "recurring": WD, "start_time": "03:00:00", "end_time": "04:00:00",
             "end_min": 1, "end_max": 3}]
    got = bounds_at(spark, trig, ["2024-03-20 12:00:00"])
    assert got["12:00"][:2] == (1, 3)


def test_equal_priority_tie_breaks_on_name(spark):
    trig = [{"name": "b", "priority": 5, "recurring": WD, "start_time": "09:00:00", "end_time": "17:00:00"},
            {"name": "a", "priority": 5, "recurring": WD, "start_time": "09:00:00", "end_time": "17:00:00"}]
    t = triggers_frame(spark, trig)
    at = instants(spark, ["2024-03-20 12:00:00"])
    act = S.active_trigger(S.window_state(at, t, spark), at).collect()
    assert act[0]["active_name"] == "a" and act[0]["n_within"] == 2


def test_suspended_trigger_ignored_and_namespace_default(spark):
    trig = [{"name": "s", "priority": 99, "suspend": True, "recurring": WD, "start_time": "00:00:00",
             "end_time": "23:00:00"},
            {"name": "k", "priority": 1, "recurring": WD, "start_time": "00:00:00", "end_time": "23:00:00"}]
    t = triggers_frame(spark, trig, namespace="prod")
    assert [r["name"] for r in t.collect()] == ["k"]
    assert t.first()["hpa_target_namespace"] == "prod"


def test_priority_transitions(spark):
    """Lower starts under higher: not applied; higher starts: applied; higher ends: lower's start
    config; lower ends under higher: nothing; only trigger ends: its end config."""
    trig = [{"name": "high", "priority": 100, "recurring": WD, "start_time": "10:00:00", "end_time": "12:00:00",
             "start_min": 8, "start_max": 20, "end_min": 1, "end_max": 5},
            {"name": "low", "priority": 10, "recurring": WD, "start_time": "09:00:00", "end_time": "14:00:00",
             "start_min": 3, "start_max": 9, "end_min": 2, "end_max": 4},
            {"name": "late", "priority": 5, "recurring": WD, "start_time": "11:00:00", "end_time": "11:30:00",
             "start_min": 1, "start_max": 2}]
    stamps = ["2024-03-20 08:00:00", "2024-03-20 09:00:00", "2024-03-20 10:00:00", "2024-03-20 11:00:00",
              "2024-03-20 11:30:00", "2024-03-20 12:00:00", "2024-03-20 14:00:00"]
    got = bounds_at(spark, trig, stamps)
    assert got["09:00"][:2] == (3, 9)     # low starts
    assert got["10:00"][:2] == (8, 20)    # higher starts while lower active: applied
    assert got["11:00"][:2] == (8, 20)    # lower starts while higher active: not applied
    assert got["11:30"][:2] == (8, 20)    # lower ends while higher active: nothing
    assert got["12:00"][:2] == (3, 9)     # higher ends while lower active: lower's start config
    assert got["14:00"][:2] == (2, 4)     # all after: end configs in priority order; late has none
    t = triggers_frame(spark, trig)
    act = S.active_trigger(S.window_state(instants(spark, stamps), t, spark), instants(spark, stamps))
    tr = S.trigger_transitions(act).orderBy("ts").collect()
    assert [(r["from_trigger"], r["to_trigger"]) for r in tr] == [
        (None, None), (None, "low"), ("low", "high"), ("high", "low"), ("low", None)]


def test_cron_text(spark):
    t = triggers_frame(spark, [
        {"name": "a", "has_interval": False, "start_time": "09:30:00", "end_time": "17:00:00"},
        {"name": "b", "recurring": "M, XX", "start_time": "9:05:00", "end_time": "17:00:00"},
        {"name": "c", "recurring": "XX", "start_time": "25:00:00", "end_time": "17:00:00"},
    ])
    got = {r["name"]: (r["start_cron"], r["cron_weekdays"]) for r in S.cron_plan(t).collect()}
    assert got == {"a": ("30 9 * * *", "*"), "b": ("5 9 * * 1", "1"), "c": (None, "*")}


@pytest.mark.parametrize("text,ok", [
    ("09:30:00", True), ("9:30:00", True), ("23:59:59", True), ("09:30:00.5", True),
    ("invalid", False), ("25:00:00", False), ("09:60:00", False), ("09:30:60", False), ("", False),
    ("9:30", False), (None, False)])
def test_clock_parse(spark, text, ok):
    from tempora.functions.clock import clock_minutes

    r = spark.createDataFrame([(text,)], "t string").select(clock_minutes(F.col("t")).alias("m")).first()
    assert (r["m"] is not None) == ok


def test_boundary_instants_give_exact_change_times(spark):
    trig = [
        {"name": "business-hours", "priority": 10, "recurring": WD, "start_time": "09:00:00",
         "end_time": "17:00:00", "start_min": 3, "start_max": 10, "end_min": 1, "end_max": 5},
        {"name": "peak-hours", "priority": 20, "recurring": WD, "start_time": "11:00:00",
         "end_time": "14:00:00", "start_min": 5, "start_max": 15, "end_min": 1, "end_max": 5},
    ]
    t = triggers_frame(spark, trig)
    span = spark.createDataFrame([("default", "app", datetime(2024, 3, 20, 0, 0), datetime(2024, 3, 20, 23, 59))],
                                 "namespace string, deployment string, t0 timestamp, t1 timestamp")
    ticks = S.boundary_instants(t, span, spark)
    hpa = spark.createDataFrame([("default", "app-hpa", 1, 5)],
                                "namespace string, name string, min_replicas int, max_replicas int")
    tl = S.schedule_timeline(S.effective_bounds(ticks, t, hpa, spark)).orderBy("ts").collect()
    assert [(r["ts"].strftime("%H:%M"), r["min_replicas"], r["max_replicas"]) for r in tl] == [
        ("00:00", 1, 5), ("09:00", 3, 10), ("11:00", 5, 15), ("14:00", 3, 10), ("17:00", 1, 5)]


def test_boundary_instants_follow_the_zone(spark):
    t = triggers_frame(spark, [{"name": "la", "recurring": WD, "timezone": "America/Los_Angeles",
                                "start_time": "09:00:00", "end_time": "17:00:00"}])
    span = spark.createDataFrame([("default", "app", datetime(2024, 3, 20, 0, 0), datetime(2024, 3, 21, 0, 0))],
                                 "namespace string, deployment string, t0 timestamp, t1 timestamp")
    got = sorted(r["ts"].strftime("%d %H:%M") for r in S.boundary_instants(t, span, spark).collect())
    # 17:00 PDT on the 19th (and the span's start), local midnight, 09:00 and 17:00 PDT on the 20th (the end is inclusive)
    assert got == ["20 00:00", "20 07:00", "20 16:00", "21 00:00"]


def test_boundary_instants_of_date_ranges(spark):
    t = triggers_frame(spark, [{"name": "d", "start_date": "2024-03-10", "end_date": "2024-03-12", "start_time": "00:00:00", "end_time": "23:00:00"}])
    span = spark.createDataFrame([("default", "app", datetime(2024, 3, 9, 12), datetime(2024, 3, 12, 12))],
                                 "namespace string, deployment string, t0 timestamp, t1 timestamp")
    got = {r["ts"] for r in S.boundary_instants(t, span, spark).collect()}
    assert {datetime(2024, 3, 9, 12), datetime(2024, 3, 10, 0, 0, 1), datetime(2024, 3, 12)} <= got


def replay(spark, rows, day="2024-03-20", cur=(1, 5)):
    t = triggers_frame(spark, rows)
    d = datetime.fromisoformat(day)
    span = spark.createDataFrame([("default", "app", d, d.replace(hour=23, minute=59))], "namespace string, deployment string, t0 timestamp, t1 timestamp")
    hpa = spark.createDataFrame([("default", "app-hpa", *cur)], "namespace string, name string, min_replicas int, max_replicas int")
    out = S.bounds_replay(S.trigger_events(t, span, spark), hpa).orderBy("event").collect()
    return [(r["ts"].strftime("%H:%M"), r["name"], r["kind"], r["applied"], r["min_replicas"], r["max_replicas"]) for r in out]


def window(name, priority, start, end, first, last):
    return {"name": name, "priority": priority, "recurring": WD, "start_time": f"{start}:00", "end_time": f"{end}:00",
            "start_min": first and first[0], "start_max": first and first[1], "end_min": last and last[0], "end_max": last and last[1]}


def test_replay_hands_over_by_priority(spark):
    got = replay(spark, [window("base", 10, "09:00", "17:00", (3, 10), (1, 5)), window("top", 20, "11:00", "14:00", (5, 15), (1, 5))])
    assert got == [("09:00", "base", "start", "base", 3, 10), ("11:00", "top", "start", "top", 5, 15),
                   ("14:00", "top", "end", "base", 3, 10), ("17:00", "base", "end", "base", 1, 5)]


def test_replay_does_nothing_under_a_higher_trigger(spark):
    got = replay(spark, [window("low", 5, "10:00", "12:00", (2, 3), (1, 2)), window("high", 50, "09:00", "15:00", (6, 9), (2, 7))])
    assert got == [("09:00", "high", "start", "high", 6, 9), ("10:00", "low", "start", None, 6, 9),
                   ("12:00", "low", "end", None, 6, 9), ("15:00", "high", "end", "high", 2, 7)]


def test_replay_applies_the_ended_triggers_own_end(spark):
    """At the second end the bounds are the second trigger's, whatever triggers ended before it; the
    state alone says otherwise, since it lets the lowest priority land last."""
    rows = [window("a", 10, "09:00", "12:00", (2, 3), (1, 4)), window("b", 20, "13:00", "15:00", (5, 8), (2, 7))]
    assert [x[4:] for x in replay(spark, rows)] == [(2, 3), (1, 4), (5, 8), (2, 7)]
    assert bounds_at(spark, rows, ["2024-03-20 15:00:00"])["15:00"][:2] == (1, 4)


def test_replay_rejects_invalid_and_keeps_missing_configs(spark):
    rows = [window("part", 10, "08:00", "09:00", (None, 8), None), window("bad", 10, "10:00", "11:00", (9, 2), (0, 6))]
    assert [x[4:] for x in replay(spark, rows)] == [(1, 8), (1, 8), (1, 8), (0, 6)]


def test_instants_without_live_triggers_stay(spark):
    t = triggers_frame(spark, [{"name": "s", "suspend": True, "recurring": WD, "start_time": "09:00:00", "end_time": "17:00:00"}])
    at = instants(spark, ["2024-03-20 12:00:00"])
    hpa = spark.createDataFrame([("default", "app-hpa", 1, 5)], "namespace string, name string, min_replicas int, max_replicas int")
    r = S.effective_bounds(at, t, hpa, spark).first()
    assert (r["source"], r["min_replicas"], r["error"]) == ("none", None, "no policy")
    assert S.active_trigger(S.window_state(at, t, spark), at).first()["n_within"] == 0


def dated(name, priority, start, end, first, last, days=("2024-03-18", "2024-03-24")):
    return window(name, priority, start, end, first, last) | {"recurring": None, "start_date": days[0], "end_date": days[1]}


@pytest.mark.parametrize("priority, applied", [(10, "special"), (30, None)])
def test_a_dated_trigger_takes_over_at_an_end(spark, priority, applied):
    rows = [window("daily", 20, "09:00", "15:00", (2, 6), (1, 2)), dated("special", priority, "08:00", "20:00", (4, 9), (1, 3))]
    at_end = [x for x in replay(spark, rows) if x[0] == "15:00"]
    assert [x[1:4] for x in at_end] == [("daily", "end", applied)]
    assert at_end[0][4:] == ((4, 9) if applied else at_end[0][4:]) and replay(spark, rows)[-1] == ("20:00", "special", "end", "special", 1, 3)


def test_a_dated_trigger_runs_daily_outside_its_dates_too(spark):
    """Its clock jobs have no date; only its state, and so others' priority, has."""
    rows = [dated("special", 30, "08:00", "20:00", (4, 9), (1, 3), ("2024-05-01", "2024-05-09")), window("daily", 20, "09:00", "15:00", (2, 6), (1, 2))]
    assert replay(spark, rows) == [("08:00", "special", "start", "special", 4, 9), ("09:00", "daily", "start", "daily", 2, 6),
                                   ("15:00", "daily", "end", "daily", 1, 2), ("20:00", "special", "end", "special", 1, 3)]


def test_refresh_at_midnight(spark):
    """At 00:00 the states are set up anew: the overnight window of the top priority applies again; with
    none Within, all that are After by their own zone apply their ends in order of priority."""
    night = window("night", 40, "22:00", "06:00", (3, 7), (1, 4))
    assert replay(spark, [night])[0] == ("00:00", "night", "refresh", "night", 3, 7)
    tokyo = [window("a", 20, "01:00", "05:00", (2, 3), (2, 8)) | {"timezone": "Asia/Tokyo"},
             window("b", 10, "02:00", "08:00", (2, 3), (1, 6)) | {"timezone": "Asia/Tokyo"}]  # 09:00 there at 00:00 UTC
    assert [x for x in replay(spark, tokyo) if x[2] == "refresh"] == [("00:00", "a", "refresh", "a", 2, 8), ("00:00", "b", "refresh", "b", 1, 6)]


def test_unknown_days_run_daily(spark):
    row = window("odd", 10, "09:00", "10:00", (2, 3), (1, 2)) | {"recurring": "XX"}
    assert [x[2] for x in replay(spark, [row])] == ["start", "end"]


def test_rejected_updates_say_why(spark):
    rows = [window("neg", 10, "08:00", "09:00", (-1, 8), None), window("zero", 10, "10:00", "11:00", (1, 0), None),
            window("crossed", 10, "12:00", "13:00", (9, 2), None), window("high", 10, "14:00", "15:00", (7, None), (0, 6))]
    t = triggers_frame(spark, rows)
    d = datetime(2024, 3, 20)
    span = spark.createDataFrame([("default", "app", d, d.replace(hour=23))], "namespace string, deployment string, t0 timestamp, t1 timestamp")
    hpa = spark.createDataFrame([("default", "app-hpa", 1, 5)], "namespace string, name string, min_replicas int, max_replicas int")
    out = S.rejected_updates(S.bounds_replay(S.trigger_events(t, span, spark), hpa)).orderBy("event").collect()
    assert [(r["name"], r["kind"], r["reason"], r["min_replicas"], r["max_replicas"]) for r in out] == [
        ("neg", "start", "minReplicas cannot be negative", 1, 5), ("zero", "start", "maxReplicas must be greater than 0", 1, 5),
        ("crossed", "start", "minReplicas (9) cannot be greater than maxReplicas (2)", 1, 5),
        ("high", "start", "minReplicas (7) cannot be greater than maxReplicas (5)", 1, 5)]


@pytest.mark.parametrize("zone, day", [("America/New_York", "2024-03-10"), ("America/New_York", "2024-11-03"), ("Australia/Lord_Howe", "2024-04-07"), ("UTC", "2024-03-10")])
def test_winners_by_interval_equal_winners_of_each_minute(spark, zone, day):
    """Every minute of three days around a shifted clock, windows that begin inside the shift included."""
    rows = [{"name": "a", "priority": 10, "timezone": zone, "recurring": "SAT,SUN,M", "start_time": "01:30:00", "end_time": "02:30:00"},
            {"name": "b", "priority": 20, "timezone": zone, "recurring": "SUN", "start_time": "02:10:00", "end_time": "23:50:00"},
            {"name": "c", "priority": 5, "timezone": zone, "recurring": "SAT,SUN", "start_time": "23:00:00", "end_time": "01:45:00"},
            {"name": "d", "priority": 30, "timezone": zone, "start_date": day, "end_date": "2024-12-01", "start_time": "12:00:00", "end_time": "12:20:00"}]
    t = triggers_frame(spark, rows)
    d = datetime.fromisoformat(day)
    inst = spark.range(3 * 1440).selectExpr("'default' namespace", "'app' deployment", f"timestamp'{day}' + make_interval(0,0,0,-1,0,cast(id as int),30) ts")
    span = inst.groupBy("namespace", "deployment").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    got = S.by_interval(inst, S.winner_changes(t, span, spark), ["namespace", "deployment"], ["active_name"])
    want = S.active_trigger(S.window_state(inst, t, spark), inst)
    assert {r["ts"]: r["active_name"] for r in got.collect()} == {r["ts"]: r["active_name"] for r in want.collect()}


def test_by_interval_before_the_first_change_and_on_it(spark):
    c = spark.createDataFrame([("k", datetime(2024, 1, 2), "x"), ("k", datetime(2024, 1, 4, 12), "y")], "key string, from_ts timestamp, v string")
    at = [datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 4, 11, 59), datetime(2024, 1, 4, 12), datetime(2024, 2, 9)]
    i = spark.createDataFrame([(k, t) for t in at for k in ("k", "other")], "key string, ts timestamp")
    got = {(r["key"], r["ts"]): r["v"] for r in S.by_interval(i, c, ["key"], ["v"]).collect()}
    assert [got["k", t] for t in at] == [None, "x", "x", "y", "y"] and all(got["other", t] is None for t in at)
