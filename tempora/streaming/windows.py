"""Trigger windows on a clock: what a timer of one workload has to know.

A plan is a workload's prepared triggers, as JSON from ``plan_json``. The functions say which trigger
wins at an instant and at which instants the winner can change; instants are whole seconds of UTC.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.config import DAY_CODES

DAY = 86_400


def plan_json(triggers: Column) -> Column:
    """A workload's trigger array (see ``schedule.trigger_arrays``) as the text of a plan."""
    return F.to_json(F.transform(triggers, lambda x: F.struct(
        x["name"].alias("name"), x["priority"].alias("priority"), x["zone"].alias("zone"), x["_s"].alias("start"), x["_e"].alias("end"),
        x["_err"].alias("error"), x["_gate"].alias("gate"), x["_codes"].alias("days"), F.unix_seconds(x["_sd"]).alias("first"),
        F.unix_seconds(x["_ed"]).alias("last"))))


@lru_cache(256)
def _plan(text: str) -> tuple[dict, ...]:
    return tuple(t for t in json.loads(text) if "error" not in t and t["gate"] != "none")


def _within(t: dict, at: int) -> bool:
    local = datetime.fromtimestamp(at, ZoneInfo(t["zone"]))
    if t["gate"] == "recurring":
        if DAY_CODES[local.weekday()] not in t["days"]:
            return False
    elif not t["first"] < at < t["last"]:
        return False
    now, start, end = local.hour * 60 + local.minute, t["start"], t["end"]
    return start <= now < end if start <= end else now >= start or now < end


def winner(text: str | None, at: int) -> str | None:
    """Name of the trigger within its window with the highest priority, then the least name."""
    found = [(-t["priority"], t["name"]) for t in _plan(text or "[]") if _within(t, at)]
    return min(found)[1] if found else None


def ticks(text: str | None, after: int, until: int) -> Iterator[int]:
    """Instants in (after, until] at which the winner can change, in order: each trigger's start, end
    and midnight by its clock, the quarters of days on which a clock is shifted, and the edges of
    date ranges."""
    found = set()
    for t in _plan(text or "[]"):
        zone = ZoneInfo(t["zone"])
        if t["gate"] == "range":
            found |= {t["first"] + 1, t["last"]}
        day = datetime.fromtimestamp(after, zone).date() - timedelta(days=1)
        while day <= datetime.fromtimestamp(until, zone).date():
            noon = [datetime(d.year, d.month, d.day, 12, tzinfo=zone).utcoffset() for d in (day, day + timedelta(days=1))]
            minutes = range(0, 1440, 15) if noon[0] != noon[1] else ()
            for m in {0, t["start"], t["end"], *minutes}:
                for fold in (0, 1):
                    found.add(_instant(day, m, zone, fold))
            if noon[0] != noon[1]:
                found |= {_instant(day + timedelta(days=1), m, zone, fold) for m in minutes for fold in (0, 1)}
            day += timedelta(days=1)
    return iter(sorted(x for x in found if after < x <= until))


def _instant(day: date, minute: int, zone: ZoneInfo, fold: int) -> int:
    return int(datetime(day.year, day.month, day.day, minute // 60, minute % 60, tzinfo=zone, fold=fold).astimezone(UTC).timestamp())


def in_force(versions: list, at: int) -> str | None:
    """The plan of the last version from before or at the instant; versions are (from, plan), sorted."""
    plan = None
    for since, text in versions:
        if since <= at:
            plan = text
    return plan


def changes(versions: list, after: int, until: int, last: str | None, started: bool) -> Iterator[tuple[int, str | None, str | None]]:
    """(instant, from, to) in (after, until] where the winner changes; the first version's beginning
    counts as a change. ``last``: the winner so far."""
    for k, (since, plan) in enumerate(versions):
        end = min(until, versions[k + 1][0] - 1) if k + 1 < len(versions) else until
        begin = max(after, since - 1)
        edge = [since] if since > after and since <= until else []
        for at in [*edge, *(x for x in ticks(plan, begin, end) if x not in edge)] if begin < end else edge:
            now = winner(plan, at)
            if now != last or not started:
                yield at, last, now
            last, started = now, True


def next_tick(versions: list, after: int, days: int = 8) -> int:
    """The next instant at which the winner can change, or the end of the look-ahead."""
    until = after + days * DAY
    later = [since for since, _ in versions if since > after]
    found = [since for since in later[:1] if since <= until]
    plan = in_force(versions, after)
    return min([*found, next(ticks(plan, after, until), until), until])
