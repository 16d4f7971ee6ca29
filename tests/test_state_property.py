"""Window state against an independent pure-Python evaluation (zoneinfo), on random inputs."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.operators import schedule as S
from tempora.sources.policies import triggers_frame

CODES = ["SUN", "M", "TU", "W", "TH", "F", "SAT"]
ZONES = ["UTC", "America/Los_Angeles", "Asia/Kolkata", "Europe/Berlin", "Bad/Zone", ""]
CLOCK = re.compile(r"^([0-9]|[01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])([.,][0-9]+)?$")


def py_state(ts, zone, start, end, recurring, start_date, end_date):
    try:
        loc = ZoneInfo(zone) if zone else timezone.utc
    except Exception:
        loc = timezone.utc
    ms, me = CLOCK.match(start or ""), CLOCK.match(end or "")
    if not ms or not me:
        return "Unknown"
    s, e = int(ms[1]) * 60 + int(ms[2]), int(me[1]) * 60 + int(me[2])
    local = ts.replace(tzinfo=timezone.utc).astimezone(loc)
    if recurring:
        gate = CODES[(local.weekday() + 1) % 7] in [x.strip() for x in recurring.split(",")]
    elif start_date and end_date:
        a = datetime.fromisoformat(start_date)
        b = datetime.fromisoformat(end_date)
        gate = a < ts < b
    else:
        gate = False
    if not gate:
        return "Unknown"
    cur = local.hour * 60 + local.minute
    inside = (s <= cur < e) if s <= e else (cur >= s or cur < e)
    if inside:
        return "Within"
    return "After" if cur >= e else "Before"


clock = st.one_of(st.builds(lambda h, m, s: f"{h:02d}:{m:02d}:{s:02d}", st.integers(0, 23), st.integers(0, 59),
                            st.integers(0, 59)), st.sampled_from(["9:05:00", "24:00:00", "bad", ""]))
trigger = st.fixed_dictionaries({
    "timezone": st.sampled_from(ZONES),
    "start_time": clock, "end_time": clock,
    "recurring": st.one_of(st.none(), st.lists(st.sampled_from(CODES + ["XX"]), min_size=1, max_size=4)
                           .map(lambda xs: ", ".join(xs))),
    "start_date": st.sampled_from([None, "2024-03-01", "2024-03-10"]),
    "end_date": st.sampled_from([None, "2024-03-15", "2024-04-01"]),
})


@settings(max_examples=12, deadline=None)
@given(st.lists(trigger, min_size=1, max_size=6),
       st.lists(st.integers(0, 40 * 24 * 60), min_size=1, max_size=8))
def test_window_state_matches_python(spark, trigs, minutes):
    t0 = datetime(2024, 2, 25)
    stamps = sorted({t0 + timedelta(minutes=m) for m in minutes})
    rows = [dict(t, name=f"t{i}", priority=i) for i, t in enumerate(trigs)]
    tf = triggers_frame(spark, rows)
    inst = spark.createDataFrame([("default", "app", ts) for ts in stamps],
                                 "namespace string, deployment string, ts timestamp")
    got = {(r["name"], r["ts"]): r["state"] for r in S.window_state(inst, tf, spark).collect()}
    for i, t in enumerate(trigs):
        for ts in stamps:
            exp = py_state(ts, t["timezone"], t["start_time"], t["end_time"], t["recurring"], t["start_date"],
                           t["end_date"])
            assert got[(f"t{i}", ts)] == exp, (t, ts)
