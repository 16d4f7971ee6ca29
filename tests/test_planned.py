"""Planned hour-of-day analyzer scenarios: flat, peaks, weekday/weekend split, too little data."""

from datetime import datetime, timedelta

from tempora.operators import planned as PL
from tempora.sources.policies import triggers_frame


def samples(spark, days, value_at, dep="d"):
    t0 = datetime(2024, 3, 4)  # Monday
    rows = []
    for i in range(days * 24):
        t = t0 + timedelta(hours=i)
        rows.append(("n", dep, t, float(value_at(t))))
    return spark.createDataFrame(rows, "namespace string, deployment string, ts timestamp, value double")


def test_flat_traffic_has_no_peaks(spark):
    pts = PL.hourly_points(samples(spark, 14, lambda t: 3))
    assert PL.data_gate(pts).first()["sufficient"]
    assert PL.peak_windows(pts).count() == 0
    assert not PL.weekend_split(pts).first()["split"]


def test_clear_peak_becomes_one_contiguous_window(spark):
    pts = PL.hourly_points(samples(spark, 14, lambda t: 10 if 9 <= t.hour < 17 else 2))
    w = PL.peak_windows(pts).collect()
    assert [(r["name"], r["start_time"], r["end_time"], r["min_replicas"], r["max_replicas"], r["priority"])
            for r in w] == [("ai-peak-daily-09-17", "09:00:00", "17:00:00", 10, 10, 100)]


def test_weekday_weekend_split_gives_separate_windows(spark):
    def v(t):
        if t.weekday() < 5:
            return 12 if 9 <= t.hour < 17 else 2
        return 5 if 12 <= t.hour < 14 else 2
    pts = PL.hourly_points(samples(spark, 14, v))
    sp = PL.weekend_split(pts).first()
    assert sp["split"] and sp["weekday_p95"] == 12.0
    names = sorted(r["name"] for r in PL.peak_windows(pts).collect())
    assert names == ["ai-peak-weekday-09-17", "ai-peak-weekend-12-14"]
    top = PL.peak_windows(pts).orderBy("priority", ascending=False).first()
    assert top["name"] == "ai-peak-weekday-09-17"


def test_fewer_than_72_points_is_insufficient(spark):
    pts = PL.hourly_points(samples(spark, 2, lambda t: 3))
    r = PL.data_gate(pts).first()
    assert r["hourly_points"] == 48 and not r["sufficient"] and r["status"] == "InsufficientData"
    peak = PL.hourly_points(samples(spark, 2, lambda t: 10 if 9 <= t.hour < 17 else 2))
    assert PL.peak_windows(peak).count() == 0  # too little data gives a status and no trigger


def test_peak_of_all_hours_ends_with_the_day(spark):
    pts = PL.hourly_points(samples(spark, 30, lambda t: 10 if t.day % 4 == 0 else 2))
    assert [(r["start_time"], r["end_time"]) for r in PL.peak_windows(pts).collect()] == [("00:00:00", "23:59:59")]


def test_empty_input(spark):
    pts = PL.hourly_points(samples(spark, 1, lambda t: 3).where("false"))
    assert PL.data_gate(pts).count() == 0 and PL.peak_windows(pts).count() == 0


def overlap(spark, gen, manual):
    g = spark.createDataFrame([("n", "d", *x) for x in gen], "namespace string, deployment string, name string, recurring string, start_time string, end_time string")
    m = triggers_frame(spark, manual, namespace="n", deployment="d")
    return {r["name"]: (r["suppressed"], r["blocked_by"]) for r in PL.manual_overlap(g, m, spark, "2024-01-22").collect()}


ALL_DAYS = "M,TU,W,TH,F,SAT,SUN"


def test_manual_overlap_suppresses_by_shared_minutes(spark):
    got = overlap(spark, [("ai-peak-daily-09-17", ALL_DAYS, "09:00:00", "17:00:00"), ("ai-peak-weekend-20-22", "SAT,SUN", "20:00:00", "22:00:00")],
                  [{"name": "business", "recurring": "M,TU,W,TH,F", "start_time": "16:30:00", "end_time": "18:00:00"},
                   {"name": "ai-old", "recurring": "SAT,SUN", "start_time": "20:00:00", "end_time": "21:00:00"}])
    assert got == {"ai-peak-daily-09-17": (True, "business"), "ai-peak-weekend-20-22": (False, None)}


def test_manual_overlap_by_zone_wrap_dates_and_an_hour(spark):
    day = [("ai-day", ALL_DAYS, "09:00:00", "11:00:00")]
    window = lambda **k: [{"name": "m", "recurring": ALL_DAYS, "start_time": "09:00:00", "end_time": "11:00:00", **k}]
    assert overlap(spark, day, window())["ai-day"] == (True, "m")
    assert overlap(spark, day, window(timezone="Asia/Tokyo"))["ai-day"] == (False, None)  # 00:00 to 02:00 UTC
    assert overlap(spark, day, window(timezone="Asia/Tokyo", start_time="18:00:00", end_time="19:00:00"))["ai-day"] == (True, "m")
    assert overlap(spark, day, window(start_time="10:55:00"))["ai-day"] == (False, None)  # 5 minutes a day
    assert overlap(spark, day, window(recurring="M", start_time="10:01:00"))["ai-day"] == (False, None)
    assert overlap(spark, day, window(recurring="M", start_time="10:00:00"))["ai-day"] == (True, "m")
    assert overlap(spark, day, window(start_time="23:00:00", end_time="09:30:00", recurring="TU"))["ai-day"] == (False, None)
    assert overlap(spark, day, window(start_time="23:00:00", end_time="10:00:00", recurring="TU"))["ai-day"] == (True, "m")
    assert overlap(spark, day, window(recurring=None, start_date="2024-01-25", end_date="2024-01-26"))["ai-day"] == (True, "m")
    assert overlap(spark, day, window(recurring=None, start_date="2024-02-25", end_date="2024-02-26"))["ai-day"] == (False, None)
    assert overlap(spark, day, window(has_interval=False))["ai-day"] == (False, None)
    assert overlap(spark, day, window(start_time="soon"))["ai-day"] == (False, None)
