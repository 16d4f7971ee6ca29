"""Cleaning, profiles and detectors against a numpy restatement."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tempora.config import WL
from tempora.operators import detect as D
from tempora.operators import profile as P
from tempora.operators import triggers as G


def frame(spark, values, start="2024-03-18 00:00:00", step_min=60, ns="n", dep="d"):
    t0 = datetime.fromisoformat(start)
    rows = [(ns, dep, t0 + timedelta(minutes=step_min * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "namespace string, deployment string, ts timestamp, value double")


def test_constant_series_keeps_all(spark):
    c = P.clean(frame(spark, [3.0] * 50))
    assert c.count() == 50
    st = P.workload_stats(c).first()
    assert st["std"] == 0 and st["p50"] == 3.0


def test_spike_removed_rows_keep_own_cells(spark):
    vals = [2.0] * 99 + [50.0]
    c = P.clean(frame(spark, vals)).collect()
    assert len(c) == 99 and max(r["value"] for r in c) == 2.0
    # the row after the removed one keeps its own instant (no positional shift)
    vals2 = [2.0] * 10 + [60.0] + [3.0] * 89
    c2 = {r["ts"]: r["value"] for r in P.clean(frame(spark, vals2)).collect()}
    assert c2[datetime(2024, 3, 18, 11)] == 3.0


def test_clamp_to_one(spark):
    c = P.clean(frame(spark, [0.0, 0.5, 2.0, 2.0])).collect()
    assert sorted(r["value"] for r in c) == [1.0, 1.0, 2.0, 2.0]


def numpy_profile(vals, hours, days):
    vals, hours, days = map(np.asarray, (vals, hours, days))
    mean, std = vals.mean(), vals.std()
    keep = (vals >= mean - 3 * std) & (vals <= mean + 3 * std) if std > 0 else np.ones(len(vals), bool)
    v, h, d = np.maximum(vals[keep], 1), hours[keep], days[keep]
    cells = {}
    for dd in range(7):
        for hh in range(24):
            m = (d == dd) & (h == hh)
            if m.any():
                cells[(dd, hh)] = (v[m].mean(), v[m].max(), v[m].min(), v[m].std(), int(m.sum()))
    daily = {dd: v[d == dd].mean() for dd in range(7) if (d == dd).any()}
    stats = dict(avg=v.mean(), max=v.max(), min=v.min(), std=v.std(),
                 **{f"p{int(q * 100)}": np.percentile(v, q * 100) for q in (0.25, 0.5, 0.75, 0.9, 0.95)})
    return cells, daily, stats


def synthetic(seed=7, weeks=3, peak=True):
    rng = np.random.default_rng(seed)
    t0 = datetime(2024, 3, 4)
    ts, vals = [], []
    for i in range(weeks * 7 * 24 * 4):
        t = t0 + timedelta(minutes=15 * i)
        base = 6 if (peak and t.weekday() < 5 and 9 <= t.hour < 17) else 2
        ts.append(t)
        vals.append(float(base + rng.integers(0, 2)))
    return ts, vals


def test_profile_matches_numpy(spark):
    ts, vals = synthetic()
    df = spark.createDataFrame([("n", "d", t, v) for t, v in zip(ts, vals)],
                               "namespace string, deployment string, ts timestamp, value double")
    c = P.clean(df)
    cells, daily, stats = numpy_profile(vals, [t.hour for t in ts], [t.weekday() for t in ts])
    got = {(r["dow"], r["hour"]): (r["avg"], r["max"], r["min"], r["std"], r["count"])
           for r in P.hourly_profile(c).collect()}
    assert got.keys() == cells.keys()
    for k in cells:
        assert np.allclose(got[k], cells[k])
    st = P.workload_stats(c).first()
    for k, v in stats.items():
        assert st[k] == pytest.approx(v)
    dm = P.daily_means(P.daily_profile(c)).first()
    assert dm["daily_mean"] == pytest.approx(sum(daily.values()) / 7)


def numpy_detect(cells, daily, stats):
    """Six detectors restated over the dense 7x24 profile."""
    out = {}
    avg = np.zeros((7, 24))
    mx = np.zeros((7, 24))
    cnt = np.zeros((7, 24))
    for (d, h), (a, m, _, _, n) in cells.items():
        avg[d, h], mx[d, h], cnt[d, h] = a, m, n
    dav = np.array([daily.get(d, 0.0) for d in range(7)])
    specs = [("peak", range(9, 17), range(5), True, 1, 0.5), ("off-peak", list(range(17, 24)) + list(range(9)),
             range(5), True, 1, 0.5), ("night", list(range(22, 24)) + list(range(6)), range(5), False, 1, 0.5),
             ("weekend", range(24), [5, 6], False, 1, 0.5), ("morning", range(6, 9), range(5), False, 5, 0.4),
             ("evening", range(17, 22), range(5), False, 5, 0.4)]
    for t, hrs, days, use_max, min_cells, floor in specs:
        vals = [avg[d, h] for d in days for h in hrs if cnt[d, h] > 0]
        mxs = [(mx if use_max else avg)[d, h] for d in days for h in hrs if cnt[d, h] > 0]
        if not vals or len(vals) < min_cells:
            continue
        v = np.array(vals)
        a = v.mean()
        if t == "peak" and a < dav.mean() * 0.8:
            continue
        if t in ("off-peak", "night") and a > stats["p50"]:
            continue
        if t == "weekend" and abs(a - dav[:5].mean()) < stats["std"] * 0.5:
            continue
        if t in ("morning", "evening") and (a <= stats["p25"] or a >= stats["p75"]):
            continue
        conf = max(floor, 1 - v.std() / (a + 1e-10)) if len(v) > 1 else 0.6
        if conf < 0.6:
            continue
        out[t] = (a, v.min(), max(mxs), np.percentile(v, 25), np.percentile(v, 75), conf, len(v))
    return out


@pytest.mark.parametrize("peak", [True, False])
def test_detectors_match_numpy(spark, peak):
    ts, vals = synthetic(seed=3, peak=peak)
    df = spark.createDataFrame([("n", "d", t, v) for t, v in zip(ts, vals)],
                               "namespace string, deployment string, ts timestamp, value double")
    c = P.clean(df)
    pats = D.detect(P.hourly_profile(c), P.workload_stats(c), P.daily_means(P.daily_profile(c)), spark)
    got = {r["pattern_type"]: (r["avg_replicas"], r["min_replicas"], r["max_replicas"], r["percentile_25"],
                               r["percentile_75"], r["confidence"], r["sample_count"]) for r in pats.collect()}
    exp = numpy_detect(*numpy_profile(vals, [t.hour for t in ts], [t.weekday() for t in ts]))
    assert got.keys() == exp.keys()
    for k in exp:
        assert np.allclose(got[k], exp[k])
    trig = G.v2_triggers(pats, P.workload_stats(c)).collect()
    if peak:
        names = {r["name"]: r for r in trig}
        assert "weekday-late-morning-peak" in names
        p = names["weekday-late-morning-peak"]
        assert (p["start_time"], p["end_time"], p["recurring"], p["priority"]) == ("09:00:00", "17:00:00",
                                                                                 "M,TU,W,TH,F", 100)
    else:
        assert trig, "every workload gets triggers (defaults when nothing is detected)"


def test_default_triggers_math(spark):
    stats = spark.createDataFrame([("n", "d", 5.0, 12.0), ("n", "e", 0.0, 0.0)],
                                  "namespace string, deployment string, p25 double, max double")
    none = stats.select(*WL).where("false")
    got = {(r["deployment"], r["name"]): (r["min_replicas"], r["max_replicas"])
           for r in G.default_triggers(stats, none).collect()}
    # min = max(1, int(5*0.8)) = 4; max = max(5, int(12*1.2)) = 14; weekend halves with floor division
    assert got == {("d", "default-business-hours"): (4, 14), ("d", "default-weekend"): (2, 7),
                   ("e", "default-baseline"): (2, 10)}


def test_wrap_aware_windows(spark):
    from tempora.config import DetectConfig

    pats = spark.createDataFrame(
        [("n", "d", "off-peak", 1, list(range(17, 24)) + list(range(9)), [0, 1, 2, 3, 4], 2.0, 1.0, 3.0, 1.5,
          2.5, 0.9, 80)],
        "namespace string, deployment string, pattern_type string, det_order int, hours array<int>, "
        "days array<int>, avg_replicas double, min_replicas double, max_replicas double, percentile_25 double, "
        "percentile_75 double, confidence double, sample_count long")
    parity = G.patterns_to_triggers(pats).first()
    wrap = G.patterns_to_triggers(pats, DetectConfig(wrap_aware=True)).first()
    assert (parity["start_time"], parity["end_time"]) == ("00:00:00", "23:00:00")
    assert (wrap["start_time"], wrap["end_time"]) == ("17:00:00", "09:00:00")
    assert parity["name"] == "weekday-evening-off-peak"


def test_approximate_percentiles_option(spark):
    from tempora.config import ProfileConfig

    ts, vals = synthetic(seed=11)
    df = spark.createDataFrame([("n", "d", t, v) for t, v in zip(ts, vals)],
                               "namespace string, deployment string, ts timestamp, value double")
    c = P.clean(df)
    exact = P.workload_stats(c).first()
    approx = P.workload_stats(c, ProfileConfig(exact_percentiles=False)).first()
    for k in ("p25", "p50", "p75", "p90", "p95"):
        assert approx[k] in set(vals) or approx[k] >= 1.0  # an observed value, not interpolated
        assert abs(approx[k] - exact[k]) <= 1.0
