"""DuckDB restatements of the registered queries (the correctness oracle).

Written independently of the Spark code: plain SQL over the driver's views.
Conventions match ``plans.report.portable``: doubles rounded to 6 digits,
instants as ``YYYY-MM-DD HH:MM:SS`` text, lists as CSV text, integers BIGINT.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def _sql_list(xs) -> str:
    return "[" + ", ".join(str(x) for x in xs) + "]"


def _str_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


# Constants of the restatement, written out here and not taken from the engine.
CODES = "['M', 'TU', 'W', 'TH', 'F', 'SAT', 'SUN']"
PRIORITY_CASE = ("WHEN 'peak' THEN 100 WHEN 'weekday' THEN 90 WHEN 'morning' THEN 80 WHEN 'evening' THEN 75 "
                 "WHEN 'afternoon' THEN 70 WHEN 'weekend' THEN 60 WHEN 'night' THEN 50 WHEN 'off-peak' THEN 40 "
                 "WHEN 'seasonal' THEN 30")
AS_OF = "TIMESTAMP '2024-01-28 00:00:00'"
WEEK = [0, 1, 2, 3, 4]
DETECTORS = [  # type, hours, days, confidence floor, least cells, maximum over the cells' maxima
    ("peak", [9, 10, 11, 12, 13, 14, 15, 16], WEEK, 0.5, 1, True),
    ("off-peak", [17, 18, 19, 20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6, 7, 8], WEEK, 0.5, 1, True),
    ("night", [22, 23, 0, 1, 2, 3, 4, 5], WEEK, 0.5, 1, False),
    ("weekend", list(range(24)), [5, 6], 0.5, 1, False),
    ("morning", [6, 7, 8], WEEK, 0.4, 5, False),
    ("evening", [17, 18, 19, 20, 21], WEEK, 0.4, 5, False),
]


# Derived samples shared by all queries ------------------------------------
def _ev(days: int | None = None) -> str:
    keep = "" if days is None else f" WHERE ts BETWEEN {AS_OF} - INTERVAL {days} DAY AND {AS_OF}"
    return f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         'ns-' || CAST(user_id % 3 AS VARCHAR) AS namespace,
         'app-' || CAST(user_id AS VARCHAR) AS deployment,
         'pod-' || CAST(event_id % 3 AS VARCHAR) AS pod
  FROM events{keep})"""


def _rs(days: int | None = None) -> str:
    return _ev(days) + """,
rs AS (
  SELECT namespace, deployment, b AS ts,
         greatest(CAST(0 AS DOUBLE), max(CAST(3 + floor(sqrt(greatest(value, 0))) AS DOUBLE))) AS value
  FROM (SELECT *, time_bucket(INTERVAL '5 minutes', ts) AS b FROM ev
        WHERE value IS NOT NULL AND NOT isnan(value))
  GROUP BY namespace, deployment, b)"""


EV, RS = _ev(), _rs()


def _cl(days: int | None = None) -> str:
    return _rs(days) + CLEAN_TAIL


CLEAN_TAIL = """,
st0 AS (SELECT namespace, deployment, avg(value) AS mu, stddev_pop(value) AS sd FROM rs GROUP BY 1, 2),
cl AS (
  SELECT r.namespace, r.deployment, r.ts, greatest(r.value, CAST(1 AS DOUBLE)) AS value
  FROM rs r JOIN st0 s ON r.namespace = s.namespace AND r.deployment = s.deployment
  WHERE s.sd <= 0 OR (r.value >= s.mu - 3.0 * s.sd AND r.value <= s.mu + 3.0 * s.sd))"""

CL = _cl()
PROFILE_TAIL = """,
hp AS (
  SELECT namespace, deployment, isodow(ts) - 1 AS dow, hour(ts) AS hour,
         avg(value) AS avg, max(value) AS mx, min(value) AS mn, stddev_pop(value) AS sd, count(*) AS n
  FROM cl GROUP BY ALL),
dp AS (
  SELECT namespace, deployment, isodow(ts) - 1 AS dow, avg(value) AS avg, max(value) AS mx, min(value) AS mn
  FROM cl GROUP BY ALL),
ws AS (
  SELECT namespace, deployment, avg(value) AS avg, max(value) AS mx, min(value) AS mn,
         stddev_pop(value) AS sd,
         quantile_cont(value, [0.25, 0.5, 0.75, 0.9, 0.95]) AS q, count(*) AS n
  FROM cl GROUP BY ALL),
dm AS (
  SELECT namespace, deployment, sum(avg) / 7 AS daily_mean,
         coalesce(sum(CASE WHEN dow < 5 THEN avg END), 0) / 5 AS weekday_mean
  FROM dp GROUP BY ALL)"""


PROFILE = CL + PROFILE_TAIL


def _detector_values() -> tuple[str, str]:
    meta = ",\n    ".join(
        f"('{t}', {i}, {_sql_list(h)}, {_sql_list(d)}, {fl}, {mc}, {'true' if mx else 'false'})"
        for i, (t, h, d, fl, mc, mx) in enumerate(DETECTORS))
    mem = ", ".join(f"('{t}', {d}, {hh})" for t, h, ds, *_ in DETECTORS for d in ds for hh in h)
    return meta, mem


def patterns_cte(days: int | None = None) -> str:
    meta, mem = _detector_values()
    return _cl(days) + PROFILE_TAIL + f""",
meta(pattern_type, det_order, hours, days, conf_floor, min_cells, use_cell_max) AS (VALUES
    {meta}),
mem(pattern_type, dow, hour) AS (VALUES {mem}),
g AS (
  SELECT h.namespace, h.deployment, m.pattern_type,
         avg(h.avg) AS avg_replicas, min(h.avg) AS min_replicas,
         max(CASE WHEN mt.use_cell_max THEN h.mx ELSE h.avg END) AS max_replicas,
         quantile_cont(h.avg, [0.25, 0.75]) AS q, stddev_pop(h.avg) AS sd, count(*) AS sample_count
  FROM hp h JOIN mem m ON h.dow = m.dow AND h.hour = m.hour
            JOIN meta mt ON mt.pattern_type = m.pattern_type
  WHERE h.n > 0
  GROUP BY ALL),
gj AS (
  SELECT g.*, mt.det_order, mt.hours, mt.days, mt.conf_floor, mt.min_cells,
         ws.q AS gq, ws.sd AS g_std, ws.mx AS g_max, dm.daily_mean, dm.weekday_mean,
         CASE WHEN g.sample_count > 1
              THEN greatest(mt.conf_floor, 1 - g.sd / (g.avg_replicas + 1e-10))
              WHEN mt.min_cells > 1 THEN 0.5 ELSE 0.6 END AS confidence
  FROM g JOIN meta mt ON mt.pattern_type = g.pattern_type
         JOIN ws ON ws.namespace = g.namespace AND ws.deployment = g.deployment
         LEFT JOIN dm ON dm.namespace = g.namespace AND dm.deployment = g.deployment),
pat AS (
  SELECT * FROM gj
  WHERE g_max > 0 AND confidence >= 0.6 AND (
     (pattern_type = 'peak' AND avg_replicas >= coalesce(daily_mean, 0) * 0.8)
  OR (pattern_type IN ('off-peak', 'night') AND avg_replicas <= gq[2])
  OR (pattern_type = 'weekend' AND abs(avg_replicas - coalesce(weekday_mean, 0)) >= g_std * 0.5)
  OR (pattern_type IN ('morning', 'evening') AND sample_count >= min_cells
      AND avg_replicas > gq[1] AND avg_replicas < gq[3])))"""


def _hh(expr: str) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), 2, '0')"


def v2_trigger_cte(wrap_aware: bool = False, days: int | None = None) -> str:
    b = 0.2
    if wrap_aware:
        start = f"{_hh('hours[1]')} || ':00:00'"
        end = (f"CASE WHEN hours[len(hours)] + 1 >= 24 THEN '23:59:59' "
               f"ELSE {_hh('hours[len(hours)] + 1')} || ':00:00' END")
    else:
        start = f"{_hh('list_min(hours)')} || ':00:00'"
        end = f"{_hh('least(list_max(hours) + 1, 23)')} || ':00:00'"
    return patterns_cte(days) + f""",
t0 AS (
  SELECT namespace, deployment, det_order, pattern_type, confidence,
         CASE WHEN days = [5, 6] THEN 'weekend' WHEN days = [0, 1, 2, 3, 4] THEN 'weekday' ELSE 'custom' END
         || '-' ||
         CASE WHEN hours[1] >= 22 OR hours[1] < 6 THEN 'night' WHEN hours[1] < 9 THEN 'morning'
              WHEN hours[1] < 12 THEN 'late-morning' WHEN hours[1] < 17 THEN 'afternoon' ELSE 'evening' END
         || '-' || pattern_type AS name,
         coalesce(CASE pattern_type {PRIORITY_CASE} END, 50) AS priority,
         'UTC' AS timezone,
         {start} AS start_time,
         {end} AS end_time,
         array_to_string(list_transform(list_sort(days), lambda d: {CODES}[d + 1]), ',') AS recurring,
         greatest(1, CAST(trunc(min_replicas) AS BIGINT)) AS min_r,
         max_replicas, avg_replicas, q
  FROM pat),
t1 AS (
  SELECT *, greatest(min_r + 2, CAST(trunc(max_replicas * (1 + {b})) AS BIGINT)) AS max_r0 FROM t0),
t2 AS (
  SELECT *, CASE WHEN pattern_type = 'peak' AND q[2] > avg_replicas * 1.2
                 THEN greatest(max_r0, CAST(trunc(max_replicas * 1.5) AS BIGINT)) ELSE max_r0 END AS max_r,
         row_number() OVER (PARTITION BY namespace, deployment, recurring, start_time, end_time
                            ORDER BY priority DESC, det_order) AS rn
  FROM t1),
trig AS (
  SELECT namespace, deployment, name, pattern_type, CAST(priority AS BIGINT) AS priority, timezone,
         start_time, end_time, recurring, min_r AS min_replicas, max_r AS max_replicas,
         CAST(1 AS BIGINT) AS end_min_replicas, greatest(2, min_r) AS end_max_replicas, confidence
  FROM t2 WHERE rn = 1),
dflt_wl AS (
  SELECT ws.* FROM ws
  WHERE NOT EXISTS (SELECT 1 FROM pat p WHERE p.namespace = ws.namespace AND p.deployment = ws.deployment)),
dflt AS (
  {default_rows_sql('dflt_wl')})"""


def default_rows_sql(src: str) -> str:
    b = 0.2
    mn = f"greatest(1, CAST(trunc(q[1] * (1 - {b})) AS BIGINT))"
    mx = f"greatest({mn} + 1, CAST(trunc(mx * (1 + {b})) AS BIGINT))"
    cols = ("namespace, deployment, name, pattern_type, priority, timezone, start_time, end_time, recurring, "
            "min_replicas, max_replicas, end_min_replicas, end_max_replicas, confidence")
    return f"""SELECT {cols} FROM (
    SELECT namespace, deployment, 'default-baseline' AS name, 'weekday' AS pattern_type, 100 AS priority,
           'UTC' AS timezone, '09:00:00' AS start_time, '17:00:00' AS end_time,
           'M,TU,W,TH,F' AS recurring, 2 AS min_replicas, 10 AS max_replicas, 1 AS end_min_replicas,
           2 AS end_max_replicas, 0.5 AS confidence
    FROM {src} WHERE coalesce(mx, 0) = 0
    UNION ALL
    SELECT namespace, deployment, 'default-business-hours', 'peak', 100, 'UTC', '09:00:00',
           '17:00:00', 'M,TU,W,TH,F', {mn}, {mx}, 1, greatest(2, {mn}), 0.5
    FROM {src} WHERE coalesce(mx, 0) <> 0
    UNION ALL
    SELECT namespace, deployment, 'default-weekend', 'weekend', 60, 'UTC', '00:00:00',
           '23:59:00', 'SAT,SUN', greatest(1, ({mn}) // 2), greatest(2, ({mx}) // 2), 1,
           greatest(2, greatest(1, ({mn}) // 2)), 0.5
    FROM {src} WHERE coalesce(mx, 0) <> 0)"""


TRIG_OUT = """SELECT namespace, deployment, name, pattern_type, CAST(priority AS BIGINT) AS priority, timezone,
       start_time, end_time, recurring, CAST(min_replicas AS BIGINT) AS min_replicas,
       CAST(max_replicas AS BIGINT) AS max_replicas, CAST(end_min_replicas AS BIGINT) AS end_min_replicas,
       CAST(end_max_replicas AS BIGINT) AS end_max_replicas, round(confidence, 6) AS confidence"""


def _reg(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# ---------------------------------------------------------------------------
_reg("outlier_filter", f"""WITH {CL}
SELECT namespace, deployment, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM cl""")

_reg("hourly_profile", f"""WITH {PROFILE}
SELECT namespace, deployment, CAST(dow AS BIGINT) AS dow, CAST(hour AS BIGINT) AS hour,
       round(avg, 6) AS avg, round(mx, 6) AS max, round(mn, 6) AS min, round(sd, 6) AS std,
       CAST(n AS BIGINT) AS count
FROM hp""")

_reg("profile_csv", ORACLE["hourly_profile"])

_reg("daily_profile", f"""WITH {PROFILE}
SELECT namespace, deployment, CAST(dow AS BIGINT) AS dow, round(avg, 6) AS avg, round(mx, 6) AS max,
       round(mn, 6) AS min
FROM dp""")

_reg("workload_stats", f"""WITH {PROFILE}
SELECT namespace, deployment, round(avg, 6) AS avg, round(mx, 6) AS max, round(mn, 6) AS min,
       round(sd, 6) AS std, round(q[1], 6) AS p25, round(q[2], 6) AS p50, round(q[3], 6) AS p75,
       round(q[4], 6) AS p90, round(q[5], 6) AS p95, CAST(n AS BIGINT) AS n
FROM ws""")

ORACLE["workload_stats_by_selection"] = ORACLE["workload_stats"]

_reg("daily_means", f"""WITH {PROFILE}
SELECT namespace, deployment, round(daily_mean, 6) AS daily_mean, round(weekday_mean, 6) AS weekday_mean
FROM dm""")

_reg("profile_grouping_sets", f"""WITH {CL},
x AS (SELECT namespace, deployment, isodow(ts) - 1 AS dow, hour(ts) AS hour, value FROM cl)
SELECT namespace, deployment, CAST(coalesce(dow, -1) AS BIGINT) AS dow,
       CAST(coalesce(hour, -1) AS BIGINT) AS hour,
       CAST(GROUPING(namespace, deployment, dow, hour) AS BIGINT) AS grain,
       round(avg(value), 6) AS avg, round(max(value), 6) AS max, round(min(value), 6) AS min,
       round(stddev_pop(value), 6) AS std, CAST(count(*) AS BIGINT) AS count
FROM x
GROUP BY GROUPING SETS ((namespace, deployment, dow, hour), (namespace, deployment, dow),
                        (namespace, deployment))""")

SEGMENT = CL + """,
seg AS (
  SELECT namespace, deployment,
         CASE WHEN isodow(ts) - 1 >= 5 THEN 'weekend'
              WHEN hour(ts) >= 9 AND hour(ts) < 17 THEN 'peak' ELSE 'off_peak' END AS segment,
         count(*) AS n, avg(value) AS avg, min(value) AS mn, max(value) AS mx
  FROM cl GROUP BY ALL)"""

_reg("segment_report", f"""WITH {SEGMENT}
SELECT namespace, deployment, segment, CAST(n AS BIGINT) AS count, round(avg, 6) AS avg,
       round(mn, 6) AS min, round(mx, 6) AS max
FROM seg""")

_reg("expected_band_check", f"""WITH {CL},
seg AS (
  SELECT namespace, deployment, dayofmonth(ts) <= 15 AS early,
         CASE WHEN isodow(ts) - 1 >= 5 THEN 'weekend'
              WHEN hour(ts) >= 9 AND hour(ts) < 17 THEN 'peak' ELSE 'off_peak' END AS segment,
         count(*) AS n, avg(value) AS avg, min(value) AS mn, max(value) AS mx
  FROM cl GROUP BY ALL)
SELECT s.namespace, s.deployment, s.segment, CAST(s.n AS BIGINT) AS count, round(s.avg, 6) AS avg,
       round(s.mn, 6) AS min, round(s.mx, 6) AS max, round(b.mn, 6) AS exp_min,
       round(b.mx, 6) AS exp_max, round(b.avg, 6) AS exp_avg,
       (s.mn >= b.mn AND s.mx <= b.mx) AS in_band,
       (abs(s.avg - b.avg) <= b.avg * 0.5) AS avg_close
FROM seg s JOIN seg b ON s.namespace = b.namespace AND s.deployment = b.deployment AND s.segment = b.segment
WHERE NOT s.early AND b.early""")

_reg("detector_patterns", f"""WITH {patterns_cte()}
SELECT namespace, deployment, pattern_type, array_to_string(hours, ',') AS hours,
       array_to_string(days, ',') AS days, round(avg_replicas, 6) AS avg_replicas,
       round(min_replicas, 6) AS min_replicas, round(max_replicas, 6) AS max_replicas,
       round(q[1], 6) AS percentile_25, round(q[2], 6) AS percentile_75, round(confidence, 6) AS confidence,
       CAST(sample_count AS BIGINT) AS sample_count
FROM pat""")

_reg("v2_triggers", f"""WITH {v2_trigger_cte()}
{TRIG_OUT} FROM (SELECT * FROM trig UNION ALL SELECT * FROM dflt)""")

_reg("v2_triggers_lookback", f"""WITH {v2_trigger_cte(days=30)}
{TRIG_OUT} FROM (SELECT * FROM trig UNION ALL SELECT * FROM dflt)""")

_reg("stream_v2_triggers", f"""WITH {v2_trigger_cte(days=14)}
{TRIG_OUT} FROM (SELECT * FROM trig UNION ALL SELECT * FROM dflt)""")

_reg("v2_triggers_wrap_aware", f"""WITH {v2_trigger_cte(wrap_aware=True)}
{TRIG_OUT} FROM (SELECT * FROM trig UNION ALL SELECT * FROM dflt)""")

_reg("v2_default_triggers", f"""WITH {patterns_cte(30)},
roster AS (SELECT DISTINCT 'ns-' || CAST(user_id % 3 AS VARCHAR) AS namespace, 'app-' || CAST(user_id AS VARCHAR) AS deployment
           FROM events),
need AS (
  SELECT r.namespace, r.deployment, ws.mx, ws.q
  FROM roster r LEFT JOIN ws ON r.namespace = ws.namespace AND r.deployment = ws.deployment
  WHERE NOT EXISTS (SELECT 1 FROM pat p WHERE p.namespace = r.namespace AND p.deployment = r.deployment)),
d AS ({default_rows_sql('need')})
{TRIG_OUT} FROM d""")


# ---------------------------------------------------------------------------
# trigger evaluation
# ---------------------------------------------------------------------------

_SETS = """
  (0, 'rush', 70, 'Europe/Berlin', true, 'M,TU,W,TH,F', NULL, NULL, -1, ':15:00', 3, ':45:00', 4, 9, 2, 4, false),
  (0, 'lull', 20, 'Europe/Berlin', true, 'M,TU,W,TH,F', NULL, NULL, 3, ':45:00', -1, ':15:00', 1, 3, 1, 2, false),
  (0, 'idle-days', 10, 'Europe/Berlin', true, 'SAT,SUN', NULL, NULL, NULL, '00:00:00', NULL, '23:59:59', 1, 2, NULL, NULL, false),
  (1, 'core', 90, 'Asia/Tokyo', true, 'M,W,F', NULL, NULL, 0, ':00:00', 2, ':20:00', 7, 12, NULL, NULL, false),
  (1, 'tail', 40, 'Asia/Tokyo', true, 'M,TU,W,TH', NULL, NULL, 1, ':40:00', 5, ':00:00', 4, 8, NULL, NULL, false),
  (2, 'late', 60, 'UTC', true, 'TU,TH,SUN', NULL, NULL, 6, ':05:00', 9, ':50:00', 3, 8, 1, 2, false),
  (2, 'later', 60, 'UTC', true, 'TU,TH,SUN', NULL, NULL, 7, ':10:00', 10, ':35:00', 2, 6, 1, 3, false),
  (3, 'day', 55, 'America/New_York', true, 'M,TU,W,TH,F', NULL, NULL, -4, ':00:00', 6, ':30:00', 4, 11, 1, 4, false),
  (3, 'pause-a', 33, 'America/New_York', true, 'SAT,SUN', NULL, NULL, NULL, '00:00:00', NULL, '23:59:59', 2, 6, 1, 3, false),
  (3, 'pause-b', 32, 'America/New_York', true, 'SAT,SUN', NULL, NULL, NULL, '00:00:00', NULL, '23:59:59', 3, 7, 1, 3, false),
  (4, 'base', 15, 'UTC', true, 'SUN,M,TU,W,TH,F,SAT', NULL, NULL, -3, ':00:00', 5, ':00:00', 2, 6, 1, 4, false),
  (4, 'spike', 25, 'UTC', true, 'SUN,M,TU,W,TH,F,SAT', NULL, NULL, 0, ':30:00', 2, ':00:00', 5, 12, 2, 7, false),
  (5, 'dated', 30, 'UTC', true, NULL, 4, 16, -2, ':00:00', 4, ':00:00', 4, 8, 1, 3, false),
  (5, 'friday-night', 45, 'UTC', true, 'F', NULL, NULL, NULL, '22:30:00', NULL, '05:30:00', 2, 9, 1, 4, false),
  (5, 'odd-zone', NULL, 'Nowhere/Land', true, 'M, XX', NULL, NULL, NULL, '00:00:00', NULL, '12:00:00', 2, 4, NULL, NULL, false),
  (5, 'parked', 95, 'UTC', true, 'M,TU,W,TH,F', NULL, NULL, NULL, '00:00:00', NULL, '23:59:00', 9, 9, 1, 2, true),
  (5, 'no-clock', 85, 'UTC', true, 'M,TU,W,TH,F', NULL, NULL, NULL, 'soon', 5, ':00:00', 3, 3, 1, 2, false),
  (5, 'no-days', 75, 'UTC', false, NULL, NULL, NULL, NULL, '00:00:00', NULL, '23:00:00', 6, 6, 1, 2, false),
  (5, 'crossed', 35, 'UTC', true, 'SAT,SUN', NULL, NULL, 0, ':00:00', 2, ':00:00', 6, 3, 1, 5, false),
  (6, 'asleep', 50, 'UTC', true, 'SUN,M,TU,W,TH,F,SAT', NULL, NULL, 0, ':00:00', 4, ':00:00', 2, 5, 1, 2, true)"""


def _set_clock(hours: str, text: str) -> str:
    return (f"CASE WHEN t.{hours} IS NULL THEN t.{text} "
            f"ELSE lpad(CAST((w.busy_hour + t.{hours} + 24) % 24 AS VARCHAR), 2, '0') || t.{text} END")


def _policy_tail(trig_name: str = "trig", inst_sql: str = "SELECT namespace, deployment, ts FROM rs") -> str:
    return f""",
wls AS (
  SELECT namespace, deployment, first(h ORDER BY n DESC, h) AS busy_hour, CAST(min(t) AS DATE) AS since
  FROM (SELECT namespace, deployment, hour(ts) AS h, count(*) AS n, min(ts) AS t FROM rs GROUP BY ALL)
  GROUP BY namespace, deployment),
tset(set_id, name, priority, timezone, has_interval, recurring, d0, d1, h0, c0, h1, c1, start_min, start_max,
     end_min, end_max, suspend) AS (VALUES {_SETS}),
pol AS (
  SELECT namespace, deployment, ascii(right(deployment, 1)) % 7 AS set_id,
         namespace AS policy_namespace, deployment || '-schedule' AS policy_name,
         CASE WHEN ascii(right(deployment, 1)) % 7 = 2 THEN 'shared' END AS hpa_namespace,
         deployment || '-hpa' AS hpa_name
  FROM wls),
trig_all AS (
  SELECT p.namespace, p.deployment, p.policy_namespace, p.policy_name, p.hpa_namespace, p.hpa_name,
         coalesce(nullif(p.hpa_namespace, ''), p.policy_namespace) AS hpa_target_namespace,
         t.name, t.priority, t.timezone, t.has_interval, t.recurring,
         strftime(w.since + CAST(t.d0 AS INTEGER), '%Y-%m-%d') AS start_date,
         strftime(w.since + CAST(t.d1 AS INTEGER), '%Y-%m-%d') AS end_date,
         {_set_clock('h0', 'c0')} AS start_time, {_set_clock('h1', 'c1')} AS end_time,
         t.start_min, t.start_max, t.end_min, t.end_max, t.suspend
  FROM pol p JOIN wls w ON p.namespace = w.namespace AND p.deployment = w.deployment JOIN tset t ON p.set_id = t.set_id),
{trig_name} AS (SELECT * FROM trig_all WHERE NOT suspend),
hpa AS (SELECT namespace AS hns, deployment || '-hpa' AS hname, 1 AS cur_min, 5 AS cur_max FROM wls),
inst AS ({inst_sql})"""


def _policy_cte() -> str:
    return RS + _policy_tail()


CLOCK_RE = r"^([0-9]|[01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])([.,][0-9]+)?$"
DATE_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _ok(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '{CLOCK_RE}'), false)"


def _mins(c: str) -> str:
    return (f"CASE WHEN {_ok(c)} THEN TRY_CAST(regexp_extract({c}, '{CLOCK_RE}', 1) AS INTEGER) * 60"
            f" + TRY_CAST(regexp_extract({c}, '{CLOCK_RE}', 2) AS INTEGER) END")


def _codes(c: str) -> str:
    return f"list_transform(string_split({c}, ','), lambda x: trim(x))"


STATES_TAIL = f""",
zones AS (SELECT name AS zone_name FROM pg_timezone_names()),
tz AS (SELECT trig.*, coalesce(z.zone_name, 'UTC') AS zone
       FROM trig LEFT JOIN zones z ON trig.timezone = z.zone_name),
j0 AS (
  SELECT i.ts, tz.*, timezone(tz.zone, i.ts AT TIME ZONE 'UTC') AS local_ts
  FROM inst i JOIN tz ON i.namespace = tz.namespace AND i.deployment = tz.deployment),
j1 AS (
  SELECT *, hour(local_ts) * 60 + minute(local_ts) AS cur, {_mins('start_time')} AS s, {_mins('end_time')} AS e,
         CASE WHEN NOT {_ok('start_time')} THEN 'failed to parse start time'
              WHEN NOT {_ok('end_time')} THEN 'failed to parse end time' END AS error,
         CASE WHEN NOT coalesce(has_interval, false) THEN false
              WHEN coalesce(recurring, '') <> '' THEN
                   list_contains({_codes('recurring')},
                                 ['SUN', 'M', 'TU', 'W', 'TH', 'F', 'SAT'][dayofweek(local_ts) + 1])
              WHEN coalesce(start_date, '') <> '' AND coalesce(end_date, '') <> '' THEN
                   coalesce(regexp_matches(start_date, '{DATE_RE}') AND regexp_matches(end_date, '{DATE_RE}')
                            AND ts > try_strptime(start_date, '%Y-%m-%d')
                            AND ts < try_strptime(end_date, '%Y-%m-%d'), false)
              ELSE false END AS gate
  FROM j0),
st AS (
  SELECT namespace, deployment, ts, policy_namespace, policy_name, hpa_target_namespace, hpa_name, name,
         coalesce(priority, 0) AS priority, start_min, start_max, end_min, end_max, local_ts, error,
         CASE WHEN error IS NOT NULL THEN 'Unknown' WHEN NOT gate THEN 'Unknown'
              WHEN (CASE WHEN s <= e THEN cur >= s AND cur < e ELSE cur >= s OR cur < e END) THEN 'Within'
              WHEN cur >= e THEN 'After' ELSE 'Before' END AS state
  FROM j1),
act AS (
  SELECT i.namespace, i.deployment, i.ts,
         first(name ORDER BY priority DESC, name) FILTER (WHERE state = 'Within') AS active_name,
         max(priority) FILTER (WHERE state = 'Within') AS active_priority,
         count(*) FILTER (WHERE state = 'Within') AS n_within
  FROM (SELECT DISTINCT namespace, deployment, ts FROM inst) i
  LEFT JOIN st ON i.namespace = st.namespace AND i.deployment = st.deployment AND i.ts = st.ts
  GROUP BY i.namespace, i.deployment, i.ts),
livepol AS (SELECT DISTINCT namespace, deployment, policy_namespace, policy_name, hpa_target_namespace, hpa_name FROM trig),
gb AS (
  SELECT i.namespace, i.deployment, i.ts, p.policy_namespace, p.policy_name, p.hpa_target_namespace, p.hpa_name,
         max(priority) FILTER (WHERE state = 'Within') AS top,
         list({{'np': -priority, 'name': name, 'mn': start_min, 'mx': start_max}} ORDER BY -priority, name)
           FILTER (WHERE state = 'Within') AS w,
         list({{'np': -priority, 'name': name, 'mn': end_min, 'mx': end_max}} ORDER BY -priority, name)
           FILTER (WHERE state = 'After') AS a
  FROM inst i LEFT JOIN livepol p ON i.namespace = p.namespace AND i.deployment = p.deployment
  LEFT JOIN st ON i.namespace = st.namespace AND i.deployment = st.deployment AND i.ts = st.ts
              AND p.policy_namespace = st.policy_namespace AND p.policy_name = st.policy_name
  GROUP BY ALL),
eb AS (
  SELECT gb.namespace, gb.deployment, gb.ts, gb.policy_namespace, gb.policy_name,
         CASE WHEN top IS NOT NULL THEN 'start' WHEN len(coalesce(a, [])) > 0 THEN 'end' ELSE 'none' END AS source,
         hpa.cur_min, hpa.cur_max,
         list_reduce(
           list_transform(CASE WHEN top IS NOT NULL THEN list_filter(w, lambda x: -x.np = top)
                               ELSE coalesce(a, []) END, lambda x: {{'mn': x.mn, 'mx': x.mx}}),
           lambda acc, x: CASE WHEN coalesce(x.mn < 0, false) OR coalesce(x.mx <= 0, false)
                                    OR coalesce(coalesce(x.mn, acc.mn) > coalesce(x.mx, acc.mx), false)
                               THEN acc
                               ELSE {{'mn': coalesce(x.mn, acc.mn), 'mx': coalesce(x.mx, acc.mx)}} END,
           {{'mn': hpa.cur_min, 'mx': hpa.cur_max}}) AS f
  FROM gb LEFT JOIN hpa ON gb.hpa_target_namespace = hpa.hns AND gb.hpa_name = hpa.hname),
bounds AS (
  SELECT namespace, deployment, ts, policy_namespace, policy_name, source,
         CASE WHEN cur_max IS NOT NULL THEN f.mn END AS min_replicas,
         CASE WHEN cur_max IS NOT NULL THEN f.mx END AS max_replicas,
         CASE WHEN policy_name IS NULL THEN 'no policy' WHEN cur_max IS NULL THEN 'hpa not found' END AS error
  FROM eb)"""
STATES = _policy_cte() + STATES_TAIL

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"

_reg("window_state", f"""WITH {STATES}
SELECT namespace, deployment, {TS}, name, CAST(priority AS BIGINT) AS priority,
       strftime(local_ts, '%Y-%m-%d %H:%M:%S') AS local_ts, state, error
FROM st""")

_reg("active_trigger", f"""WITH {STATES}
SELECT namespace, deployment, {TS}, active_name, CAST(active_priority AS DOUBLE) AS active_priority,
       CAST(n_within AS BIGINT) AS n_within
FROM act""")

_reg("higher_priority_active", f"""WITH {STATES}
SELECT namespace, deployment, {TS}, name, CAST(priority AS BIGINT) AS priority, state,
       coalesce(max(CASE WHEN state = 'Within' THEN priority END)
                  OVER (PARTITION BY namespace, deployment, ts) > priority, false) AS higher_active
FROM st""")

_reg("effective_bounds", f"""WITH {STATES}
SELECT namespace, deployment, policy_namespace, policy_name, {TS}, source, CAST(min_replicas AS DOUBLE) AS min_replicas,
       CAST(max_replicas AS DOUBLE) AS max_replicas, error
FROM bounds""")

_reg("schedule_timeline", f"""WITH {STATES},
lagged AS (
  SELECT *, row_number() OVER w AS rn,
         lag(min_replicas) OVER w AS pmin, lag(max_replicas) OVER w AS pmax
  FROM bounds WINDOW w AS (PARTITION BY namespace, deployment, policy_namespace, policy_name ORDER BY ts))
SELECT namespace, deployment, policy_namespace, policy_name, {TS}, source, CAST(min_replicas AS DOUBLE) AS min_replicas,
       CAST(max_replicas AS DOUBLE) AS max_replicas, error
FROM lagged
WHERE rn = 1 OR min_replicas IS DISTINCT FROM pmin OR max_replicas IS DISTINCT FROM pmax""")

_reg("trigger_transitions", f"""WITH {STATES},
lagged AS (
  SELECT *, row_number() OVER w AS rn, lag(active_name) OVER w AS from_trigger
  FROM act WINDOW w AS (PARTITION BY namespace, deployment ORDER BY ts))
SELECT namespace, deployment, {TS}, from_trigger, active_name AS to_trigger
FROM lagged WHERE rn = 1 OR from_trigger IS DISTINCT FROM active_name""")

_CRON_MAP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in
                     {"SUN": 0, "M": 1, "TU": 2, "W": 3, "TH": 4, "F": 5, "SAT": 6}.items())
_WEEKDAYS = (f"CASE WHEN coalesce(recurring, '') = '' THEN '*' "
             f"ELSE coalesce(nullif(array_to_string(list_filter(list_transform({_codes('recurring')}, "
             f"lambda c: CASE c {_CRON_MAP} END), lambda x: x IS NOT NULL), ','), ''), '*') END")


def _cron(c: str) -> str:
    return (f"CASE WHEN {_ok(c)} THEN CAST(TRY_CAST(regexp_extract({c}, '{CLOCK_RE}', 2) AS INTEGER) AS VARCHAR)"
            f" || ' ' || CAST(TRY_CAST(regexp_extract({c}, '{CLOCK_RE}', 1) AS INTEGER) AS VARCHAR)"
            f" || ' * * ' || {_WEEKDAYS} END")


_reg("trigger_cron_plan", f"""WITH {_policy_cte()}
SELECT policy_namespace, policy_name, name, {_cron('start_time')} AS start_cron,
       {_cron('end_time')} AS end_cron, {_WEEKDAYS} AS cron_weekdays
FROM trig""")


def _cfg_bad(mn: str, mx: str) -> str:
    return f"(coalesce({mn} < 0, false) OR coalesce({mx} <= 0, false) OR coalesce({mn} > {mx}, false))"


_reg("trigger_validation", f"""WITH {_policy_cte()},
zones AS (SELECT name AS zone_name FROM pg_timezone_names()),
v AS (
  SELECT t.policy_namespace, t.policy_name, t.name, [
    CASE WHEN NOT {_ok('start_time')} THEN 'start_time_invalid' END,
    CASE WHEN NOT {_ok('end_time')} THEN 'end_time_invalid' END,
    CASE WHEN NOT (coalesce(has_interval, false) AND (coalesce(recurring, '') <> ''
                   OR (coalesce(start_date, '') <> '' AND coalesce(end_date, '') <> '')))
         THEN 'no_valid_interval' END,
    CASE WHEN coalesce(timezone, '') <> '' AND z.zone_name IS NULL THEN 'unknown_timezone' END,
    CASE WHEN {_cfg_bad('start_min', 'start_max')} THEN 'start_config_invalid' END,
    CASE WHEN {_cfg_bad('end_min', 'end_max')} THEN 'end_config_invalid' END,
    CASE WHEN coalesce(hpa_name, '') = '' THEN 'hpa_ref_missing' END] AS rules
  FROM trig_all t LEFT JOIN zones z ON t.timezone = z.zone_name)
SELECT policy_namespace, policy_name, name, rule
FROM (SELECT policy_namespace, policy_name, name, unnest(rules) AS rule FROM v)
WHERE rule IS NOT NULL""")


# ---------------------------------------------------------------------------
# metric samples, resampling and the merged per-bucket frame
# ---------------------------------------------------------------------------

def _samples_cte(days: int | None = None) -> str:
    return _ev(days) + """,
srcs(metric_type, metric_name, src_rank) AS (VALUES
  ('cpu', 'container_cpu_usage_seconds_total', 0),
  ('memory', 'container_memory_usage_bytes', 0), ('memory', 'container_memory_working_set_bytes', 1),
  ('replicas', 'kube_deployment_status_replicas', 0),
  ('replicas', 'kube_horizontalpodautoscaler_status_current_replicas', 1),
  ('replicas', 'kube_deployment_status_replicas_ready', 2)),
ms0 AS (
  SELECT event_id, ts + to_minutes(CAST(scrape AS BIGINT)) AS ts, namespace, deployment, pod, 'main' AS container,
         CASE event_type WHEN 'view' THEN 'container_cpu_usage_seconds_total'
              WHEN 'click' THEN 'container_memory_usage_bytes' WHEN 'signup' THEN 'container_memory_working_set_bytes'
              WHEN 'purchase' THEN 'kube_deployment_status_replicas'
              WHEN 'error' THEN 'kube_horizontalpodautoscaler_status_current_replicas' END AS metric_name,
         CASE WHEN isnan(value) THEN NULL ELSE value + value / 10 * scrape END AS value
  FROM ev CROSS JOIN LATERAL (SELECT unnest(CASE WHEN event_type = 'view' THEN [0, 1, 2] ELSE [0] END) AS scrape) x),
ms AS (
  SELECT m.*, s.metric_type, s.src_rank,
         '__name__=' || m.metric_name || '_container=main_deployment=' || m.deployment
         || '_namespace=' || m.namespace || '_pod=' || m.pod AS series_id
  FROM ms0 m JOIN srcs s ON m.metric_name = s.metric_name
  WHERE m.metric_name IS NOT NULL),
best AS (SELECT namespace, deployment, metric_type, min(src_rank) AS b FROM ms GROUP BY ALL),
fb AS (
  SELECT ms.* FROM ms JOIN best b ON ms.namespace = b.namespace AND ms.deployment = b.deployment
                                 AND ms.metric_type = b.metric_type AND ms.src_rank = b.b),
c0 AS (
  SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY ts, value) AS v0,
         lag(ts) OVER (PARTITION BY series_id ORDER BY ts, value) AS t0
  FROM fb WHERE metric_type = 'cpu' AND value IS NOT NULL),
c1 AS (
  SELECT * EXCLUDE (v0, t0), CASE WHEN ts - t0 <= INTERVAL 5 MINUTE THEN v0 END AS pv,
         CASE WHEN ts - t0 <= INTERVAL 5 MINUTE THEN t0 END AS pts,
         time_bucket(INTERVAL '5 minutes', ts) AS bucket
  FROM c0),
c2 AS (
  SELECT namespace, deployment, pod, container, series_id, bucket,
         sum(CASE WHEN pv IS NULL THEN NULL WHEN value >= pv THEN value - pv ELSE value END) AS total,
         count(pv) AS npairs, max(ts) AS last_ts, min(ts) AS first_ts, arg_min(pts, ts) AS start0
  FROM c1 GROUP BY ALL),
cpu_rate AS (
  SELECT namespace, deployment, pod, container, series_id, bucket,
         CASE WHEN npairs > 0 AND epoch_us(last_ts) - epoch_us(coalesce(start0, first_ts)) > 0
              THEN total / ((epoch_us(last_ts) - epoch_us(coalesce(start0, first_ts))) / 1e6) END AS rate
  FROM c2),
cpu_pod AS (
  SELECT namespace, deployment, pod, container, bucket, sum(rate) AS value
  FROM cpu_rate WHERE rate IS NOT NULL GROUP BY ALL),
rsmp AS (
  SELECT namespace, deployment, metric_type, metric_name, pod, container, series_id,
         time_bucket(INTERVAL '5 minutes', ts) AS bucket,
         arg_max(value, ts) AS value, max(ts) AS last_ts, count(*) AS n_raw
  FROM fb WHERE value IS NOT NULL GROUP BY ALL),
mem_pod AS (
  SELECT namespace, deployment, pod, container, bucket, sum(value) AS value
  FROM rsmp WHERE metric_type = 'memory' GROUP BY ALL),
ser AS (
  SELECT namespace, deployment, pod, container, bucket, value, 'cpu' AS metric_type FROM cpu_pod
  UNION ALL
  SELECT namespace, deployment, pod, container, bucket, value, 'memory' FROM mem_pod
  UNION ALL
  SELECT namespace, deployment, pod, container, bucket, value, 'replicas' FROM rsmp
  WHERE metric_type = 'replicas')"""


_METRICS = ["cpu", "memory", "replicas"]
_STATS = [("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_samp")]
_WIDE_COLS = [f"{m}_{s}" for m in _METRICS for s, _ in _STATS]


def _merged_cte() -> str:
    aggs = ",\n         ".join(f"{fn}(CASE WHEN metric_type = '{m}' THEN value END) AS {m}_{s}"
                               for m in _METRICS for s, fn in _STATS)
    fills = ",\n         ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER fw, first_value({c} IGNORE NULLS) OVER bw) AS {c}"
        for c in _WIDE_COLS)
    return _samples_cte() + f""",
wide AS (
  SELECT namespace, deployment, bucket,
         {aggs}
  FROM ser GROUP BY ALL),
merged AS (
  SELECT namespace, deployment, bucket,
         {fills}
  FROM wide
  WINDOW fw AS (PARTITION BY namespace, deployment ORDER BY bucket
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         bw AS (PARTITION BY namespace, deployment ORDER BY bucket
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
feat AS (
  SELECT *, hour(bucket) AS hour, minute(bucket) AS minute, isodow(bucket) - 1 AS day_of_week,
         CASE WHEN isodow(bucket) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
         hour(bucket) + minute(bucket) / 60.0 AS time_of_day,
         hour(bucket) * 4 + minute(bucket) // 15 AS time_slot,
         weekofyear(bucket) AS week, strftime(bucket, '%Y-%m-%d') AS date,
         (isodow(bucket) - 1 < 5 AND hour(bucket) >= 9 AND hour(bucket) < 17) AS is_peak
  FROM merged),
grid AS (
  SELECT namespace, deployment, day_of_week, time_slot,
         avg(cpu_mean) AS cpu_mean, avg(memory_mean) AS memory_mean, avg(replicas_mean) AS replicas_mean,
         avg(time_of_day) AS time_of_day, avg(is_weekend) AS is_weekend
  FROM feat GROUP BY ALL)"""


_FEATURES = ["cpu_mean", "memory_mean", "replicas_mean", "time_of_day", "is_weekend"]


def _zgrid_cte() -> str:
    zs = ",\n         ".join(
        f"CASE WHEN count({c}) OVER w > 0 THEN CASE WHEN stddev_pop({c}) OVER w > 0 "
        f"THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0.0 END END AS z_{c}" for c in _FEATURES)
    return _merged_cte() + f""",
zgrid AS (
  SELECT *,
         {zs}
  FROM grid WINDOW w AS (PARTITION BY namespace, deployment))"""


def _assign_cte(k: int = 4) -> str:
    cents = ", ".join(f"avg(z_{c}) AS c_{c}" for c in _FEATURES)
    d2 = " + ".join(f"coalesce((z.z_{c} - c.c_{c}) * (z.z_{c} - c.c_{c}), 0.0)" for c in _FEATURES)
    return _zgrid_cte() + f""",
cent AS (
  SELECT namespace, deployment, CAST(floor(time_slot * {k} / 96) AS INTEGER) AS centroid, {cents}
  FROM zgrid GROUP BY ALL),
dist AS (
  SELECT z.namespace, z.deployment, z.day_of_week, z.time_slot, c.centroid, {d2} AS d2
  FROM zgrid z JOIN cent c ON z.namespace = c.namespace AND z.deployment = c.deployment),
lab AS (
  SELECT namespace, deployment, day_of_week, time_slot, centroid AS cluster, d2 AS distance2
  FROM (SELECT *, row_number() OVER (PARTITION BY namespace, deployment, day_of_week, time_slot
                                     ORDER BY d2, centroid) AS rn FROM dist)
  WHERE rn = 1)"""


BK = "strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket"
_KEYS = "namespace, deployment"

_reg("samples_resample_5m", f"""WITH {_samples_cte(14)},
r AS (
  SELECT namespace, deployment, metric_type, metric_name, pod, series_id,
         time_bucket(INTERVAL '5 minutes', ts) AS bucket, arg_max(value, ts) AS value,
         max(ts) AS last_ts, count(*) AS n_raw
  FROM ms WHERE value IS NOT NULL GROUP BY ALL)
SELECT namespace, deployment, metric_type, metric_name, pod, series_id, {BK}, round(value, 6) AS value,
       strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, CAST(n_raw AS BIGINT) AS n_raw
FROM r""")

_reg("samples_label_filter", f"""WITH {_samples_cte()}
SELECT CAST(event_id AS BIGINT) AS event_id, namespace, deployment, pod, container, metric_name, series_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value
FROM ms
WHERE metric_name = 'container_cpu_usage_seconds_total' AND regexp_matches(pod, '^(?:pod-1.*)$')""")

_reg("source_fallback", f"""WITH {_samples_cte()}
SELECT namespace, deployment, metric_type, metric_name, CAST(count(*) AS BIGINT) AS samples,
       round(sum(value), 6) AS value_sum
FROM fb GROUP BY ALL""")

_reg("counter_rate_sum", f"""WITH {_samples_cte()}
SELECT namespace, deployment, pod, container, {BK}, round(value, 6) AS value FROM cpu_pod""")

# a pair counts in every range that holds its later sample's bucket
_reg("counter_rate_sliding", f"""WITH {_samples_cte()},
pr AS (
  SELECT *, time_bucket(INTERVAL '5 minutes', ts) AS bucket, t0 IS NOT NULL AND ts - t0 <= INTERVAL 30 MINUTE AS pair
  FROM c0),
per AS (
  SELECT namespace, deployment, pod, container, series_id, bucket, count(*) FILTER (WHERE pair) AS n,
         sum(CASE WHEN value >= v0 THEN value - v0 ELSE value END) FILTER (WHERE pair) AS inc,
         sum(epoch_us(ts) - epoch_us(t0)) FILTER (WHERE pair) AS us
  FROM pr GROUP BY ALL),
wide AS (
  SELECT a.namespace, a.deployment, a.pod, a.container, a.series_id, a.bucket, sum(b.n) AS n, sum(b.inc) AS inc, sum(b.us) AS us
  FROM per a JOIN per b ON a.series_id = b.series_id AND b.bucket <= a.bucket AND b.bucket > a.bucket - INTERVAL 30 MINUTE
  GROUP BY ALL)
SELECT namespace, deployment, pod, container, {BK}, round(sum(inc / (us / 1e6)), 6) AS value
FROM wide WHERE n > 0 AND us > 0 GROUP BY namespace, deployment, pod, container, bucket""")

_reg("namespace_quantiles", f"""WITH {_samples_cte()},
nq AS (SELECT namespace, metric_name, count(value) AS n, quantile_cont(value, [0.05, 0.5, 0.95, 0.99]) AS q
       FROM ms0 WHERE metric_name IS NOT NULL GROUP BY ALL)
SELECT namespace, metric_name, CAST(n AS BIGINT) AS n, round(q[1], 6) AS p05, round(q[2], 6) AS p50, round(q[3], 6) AS p95,
       round(q[4], 6) AS p99
FROM nq""")

_reg("memory_sum_by_pod", f"""WITH {_samples_cte()}
SELECT namespace, deployment, pod, container, {BK}, round(value, 6) AS value FROM mem_pod""")

_reg("per_timestamp_stats", f"""WITH {_samples_cte()}
SELECT namespace, deployment, metric_type, {BK}, round(avg(value), 6) AS mean, round(max(value), 6) AS max,
       round(min(value), 6) AS min, round(stddev_samp(value), 6) AS std
FROM ser GROUP BY namespace, deployment, metric_type, bucket""")

_reg("max_per_timestamp", f"""WITH {_samples_cte()}
SELECT namespace, deployment, {BK}, round(greatest(CAST(0 AS DOUBLE), max(value)), 6) AS value
FROM ser WHERE metric_type = 'replicas' GROUP BY namespace, deployment, bucket""")

_reg("outer_merge_fill", f"""WITH {_merged_cte()}
SELECT namespace, deployment, {BK}, {", ".join(f"round({c}, 6) AS {c}" for c in _WIDE_COLS)}
FROM merged""")

_reg("unified_timestamps", f"""WITH {_samples_cte()}
SELECT DISTINCT namespace, deployment, {BK} FROM ser""")

_reg("time_features", f"""WITH {_merged_cte()}
SELECT namespace, deployment, {BK}, CAST(hour AS BIGINT) AS hour, CAST(minute AS BIGINT) AS minute,
       CAST(day_of_week AS BIGINT) AS day_of_week, CAST(is_weekend AS BIGINT) AS is_weekend,
       round(time_of_day, 6) AS time_of_day, CAST(time_slot AS BIGINT) AS time_slot,
       CAST(week AS BIGINT) AS week, date, is_peak
FROM feat""")

_reg("slot_grid", f"""WITH {_merged_cte()}
SELECT namespace, deployment, CAST(day_of_week AS BIGINT) AS day_of_week, CAST(time_slot AS BIGINT) AS time_slot,
       {", ".join(f"round({c}, 6) AS {c}" for c in _FEATURES)}
FROM grid""")

_reg("standardized_grid", f"""WITH {_zgrid_cte()}
SELECT namespace, deployment, CAST(day_of_week AS BIGINT) AS day_of_week, CAST(time_slot AS BIGINT) AS time_slot,
       {", ".join(f"round(z_{c}, 6) AS z_{c}" for c in _FEATURES)}
FROM zgrid""")

_reg("kmeans_assign_step", f"""WITH {_assign_cte()}
SELECT namespace, deployment, CAST(day_of_week AS BIGINT) AS day_of_week, CAST(time_slot AS BIGINT) AS time_slot,
       CAST(cluster AS BIGINT) AS cluster, round(distance2, 6) AS distance2
FROM lab""")

_REFINED = """
cp0 AS (
  SELECT g.namespace, g.deployment, l.cluster, min(g.time_slot) AS s0, max(g.time_slot) AS s1,
         list_sort(list_distinct(list(g.day_of_week))) AS days,
         avg(g.cpu_mean) AS avg_cpu, avg(g.memory_mean) AS avg_memory, avg(g.replicas_mean) AS avg_replicas,
         CAST(ceil(max(g.replicas_mean)) AS INTEGER) AS peak0,
         stddev_samp(g.cpu_mean) AS sd, count(g.cpu_mean) AS ncpu
  FROM grid g JOIN lab l ON g.namespace = l.namespace AND g.deployment = l.deployment
                         AND g.day_of_week = l.day_of_week AND g.time_slot = l.time_slot
  GROUP BY g.namespace, g.deployment, l.cluster),
cp1 AS (SELECT *, least((s1 + 1) * 15, 1439) AS last_minute FROM cp0),
cp AS (
  SELECT namespace, deployment, cluster AS pattern_id, s0 * 15 // 60 AS start_hour, s0 * 15 % 60 AS start_minute,
         last_minute // 60 AS end_hour, last_minute % 60 AS end_minute,
         days, round(coalesce(avg_cpu, 0.0), 9) AS avg_cpu, round(coalesce(avg_memory, 0.0), 9) AS avg_memory,
         round(coalesce(avg_replicas, 1.0), 9) AS avg_replicas, greatest(1, coalesce(peak0, 1)) AS peak_replicas,
         CASE WHEN ncpu > 0 THEN least(1.0, greatest(0.5, 1 - sd / (avg_cpu + 1e-10))) ELSE 0.7 END AS confidence
  FROM cp1),
cpd AS (
  SELECT * FROM cp WHERE (end_hour - start_hour) + (end_minute - start_minute) / 60.0 >= 1.0),
sup AS (
  SELECT p.namespace, p.deployment, p.pattern_id, count(*) AS support, avg(f.replicas_mean) AS ravg,
         CAST(ceil(max(f.replicas_mean)) AS INTEGER) AS rpeak
  FROM cpd p JOIN feat f ON p.namespace = f.namespace AND p.deployment = f.deployment
  WHERE f.hour BETWEEN p.start_hour AND p.end_hour AND list_contains(p.days, f.day_of_week)
  GROUP BY ALL),
refined AS (
  SELECT p.namespace, p.deployment, p.pattern_id, p.start_hour, p.start_minute, p.end_hour, p.end_minute, p.days,
         p.avg_cpu, p.avg_memory, round(coalesce(s.ravg, p.avg_replicas), 9) AS avg_replicas,
         coalesce(s.rpeak, p.peak_replicas) AS peak_replicas, p.confidence, s.support
  FROM cpd p JOIN sup s ON p.namespace = s.namespace AND p.deployment = s.deployment AND p.pattern_id = s.pattern_id
  WHERE s.support >= 10)"""

def _six(c: str) -> str:
    """Six decimals, halves up, of a value kept to nine."""
    return f"CAST(round(CAST({c} AS DECIMAL(30, 9)), 6) AS DOUBLE) AS {c}"


_PATTERN_OUT = f"""CAST(pattern_id AS BIGINT) AS pattern_id,
       CAST(start_hour AS BIGINT) AS start_hour, CAST(start_minute AS BIGINT) AS start_minute,
       CAST(end_hour AS BIGINT) AS end_hour, CAST(end_minute AS BIGINT) AS end_minute,
       array_to_string(days, ',') AS days, {_six('avg_cpu')}, {_six('avg_memory')}, {_six('avg_replicas')},
       CAST(peak_replicas AS BIGINT) AS peak_replicas, {_six('confidence')}"""

# patterns of a workload, merged: each joins the first leader before it that it matches
_MERGED = """,
mp AS (
  SELECT namespace, deployment, count(*) AS n,
         list({'days': days, 'r': avg_replicas, 'a': start_hour, 'b': end_hour} ORDER BY pattern_id) AS ps
  FROM refined GROUP BY ALL),
fold AS (
  SELECT namespace, deployment, n, ps, 0 AS j, CAST([] AS BIGINT[]) AS leaders FROM mp
  UNION ALL
  SELECT namespace, deployment, n, ps, j + 1,
         list_append(leaders, coalesce(list_min(list_filter(range(j), lambda q: leaders[q + 1] = q
           AND ps[q + 1].days = ps[j + 1].days AND abs(ps[q + 1].r - ps[j + 1].r) < 2
           AND ps[q + 1].a <= ps[j + 1].b AND ps[j + 1].a <= ps[q + 1].b)), j))
  FROM fold WHERE j < n),
led AS (
  SELECT r.*, f.leaders[row_number() OVER (PARTITION BY r.namespace, r.deployment ORDER BY r.pattern_id)] AS leader
  FROM refined r JOIN fold f ON r.namespace = f.namespace AND r.deployment = f.deployment AND f.j = f.n),
mrg AS (
  SELECT namespace, deployment, leader, min(start_hour) AS start_hour, min(start_minute) AS start_minute,
         max(end_hour) AS end_hour, max(end_minute) AS end_minute, any_value(days) AS days, round(avg(avg_cpu), 9) AS avg_cpu,
         round(avg(avg_memory), 9) AS avg_memory, round(avg(avg_replicas), 9) AS avg_replicas, max(peak_replicas) AS peak_replicas,
         round(avg(confidence), 9) AS confidence
  FROM led GROUP BY namespace, deployment, leader),
merged_p AS (
  SELECT * EXCLUDE (leader), row_number() OVER (PARTITION BY namespace, deployment ORDER BY leader) - 1 AS pattern_id FROM mrg)"""


def _v1_triggers_sql(with_clause: str) -> str:
    clock = "lpad(CAST({0}_hour AS VARCHAR), 2, '0') || ':' || lpad(CAST({0}_minute AS VARCHAR), 2, '0') || ':00'"
    return f"""WITH RECURSIVE {with_clause},
v1a AS (
  SELECT *, row_number() OVER (PARTITION BY namespace, deployment ORDER BY avg_replicas DESC, pattern_id) - 1 AS i,
         count(*) OVER (PARTITION BY namespace, deployment) AS n
  FROM merged_p),
v1b AS (SELECT *, row_number() OVER (PARTITION BY namespace, deployment ORDER BY confidence DESC, i) - 1 AS c FROM v1a),
v1c AS (SELECT *, CASE WHEN n > 10 THEN c ELSE i END AS pos FROM v1b WHERE n <= 10 OR c < 10),
v1d AS (
  SELECT *, CASE WHEN days = [0, 1, 2, 3, 4] THEN 'weekday' WHEN days = [5, 6] THEN 'weekend'
                 WHEN len(days) = 7 THEN 'daily' ELSE 'custom-' || CAST(i + 1 AS VARCHAR) END
         || CASE WHEN start_hour < 12 THEN '-morning' WHEN start_hour < 17 THEN '-afternoon' ELSE '-evening' END
         || CASE WHEN avg_replicas > 5 THEN '-high-load' WHEN avg_replicas > 2 THEN '-normal-load' ELSE '-low-load' END AS base,
         greatest(1, CAST(trunc(avg_replicas * (1 - 0.2)) AS BIGINT)) AS mn
  FROM v1c),
v1e AS (SELECT *, row_number() OVER (PARTITION BY namespace, deployment, base ORDER BY pos) AS k FROM v1d),
mined AS (
  SELECT namespace, deployment, CASE WHEN k > 1 THEN base || '-' || CAST(k AS VARCHAR) ELSE base END AS name,
         'pattern' AS pattern_type, 100 - pos * 10 AS priority, 'UTC' AS timezone, {clock.format('start')} AS start_time,
         {clock.format('end')} AS end_time,
         array_to_string(list_transform(days, lambda d: {CODES}[d + 1]), ',') AS recurring, mn AS min_replicas,
         greatest(mn + 1, CAST(trunc(peak_replicas * (1 + 0.2)) AS BIGINT)) AS max_replicas, 1 AS end_min_replicas,
         greatest(3, mn) AS end_max_replicas, confidence
  FROM v1e),
alone AS (
  SELECT DISTINCT namespace, deployment FROM feat f
  WHERE NOT EXISTS (SELECT 1 FROM mined m WHERE m.namespace = f.namespace AND m.deployment = f.deployment))
{TRIG_OUT} FROM (
  SELECT * FROM mined UNION ALL
  SELECT namespace, deployment, 'default-business-hours', 'default', 100, 'UTC', '09:00:00', '17:00:00', 'M,TU,W,TH,F',
         2, 10, 1, 3, 0.5 FROM alone)"""


_reg("cluster_patterns_fixed", f"""WITH {_assign_cte()},
{_REFINED}
SELECT namespace, deployment, {_PATTERN_OUT}, CAST(support AS BIGINT) AS support FROM refined""")

_reg("merged_patterns_fixed", f"""WITH RECURSIVE {_assign_cte()},
{_REFINED}{_MERGED}
SELECT namespace, deployment, {_PATTERN_OUT} FROM merged_p""")

_reg("v1_triggers_fixed", _v1_triggers_sql(f"{_assign_cte()},\n{_REFINED}{_MERGED}"))


_reg("v1_triggers_most_confident", ORACLE["v1_triggers_fixed"].replace("n > 10 THEN c", "n > 2 THEN c").replace("n <= 10 OR c < 10", "n <= 2 OR c < 2"))


def _dist(a: str, b: str) -> str:
    return " + ".join(f"({a}[{n}] - {b}[{n}]) * ({a}[{n}] - {b}[{n}])" for n in range(1, 6))


GOLDEN = "0.6180339887498949::DOUBLE"  # its multiples modulo 1 are the draws of the restarts


def _fit_cte() -> str:
    """Best-k clustering: ten starts (farthest-first, then drawn by squared distance), Lloyd steps for every k, brute-force silhouettes."""
    z = ", ".join(f"coalesce(round(z_{c}, 6), 0.0)" for c in _FEATURES)
    cent = ", ".join(f"round(avg(z[{n}]), 9)" for n in range(1, 6))
    nearest = (f"list_sort(list_transform({{0}}, lambda x: {{{{'d': {_dist('{1}', 'x.c')}, 'lab': x.lab}}}}))[1].lab")
    return _zgrid_cte() + f""",
cells0 AS (
  SELECT namespace, deployment, day_of_week, time_slot, [{z}] AS z, count(*) OVER (PARTITION BY namespace, deployment) AS n,
         row_number() OVER (PARTITION BY namespace, deployment ORDER BY day_of_week, time_slot) - 1 AS i
  FROM zgrid),
cells AS (SELECT * FROM cells0 WHERE n >= 3),
sd AS (
  SELECT c.namespace, c.deployment, r, 0 AS step, c.i, c.z, f.z AS seed,
         CASE r WHEN 0 THEN sqrt({_dist('c.z', 'f.z')}) ELSE pow(sqrt({_dist('c.z', 'f.z')}), 2) END AS near
  FROM cells c CROSS JOIN range(10) t(r) JOIN cells f ON c.namespace = f.namespace AND c.deployment = f.deployment
   AND f.i = CASE r WHEN 0 THEN 0 ELSE CAST(floor(((r * 8) * {GOLDEN} % 1) * c.n) AS BIGINT) END
  UNION ALL
  SELECT namespace, deployment, r, step + 1, i, z, nz,
         least(near, CASE r WHEN 0 THEN sqrt({_dist('z', 'nz')}) ELSE pow(sqrt({_dist('z', 'nz')}), 2) END)
  FROM (SELECT *, any_value(z) FILTER (WHERE i = ni) OVER (PARTITION BY namespace, deployment, r) AS nz
        FROM (SELECT *, CASE r WHEN 0 THEN first_value(i) OVER (PARTITION BY namespace, deployment, r ORDER BY near DESC, i)
                          ELSE min(i) FILTER (WHERE near > 0 AND upto >= ((r * 8 + step + 1) * {GOLDEN} % 1) * total)
                               OVER (PARTITION BY namespace, deployment, r) END AS ni
              FROM (SELECT *, max(near) OVER p AS far, sum(near) OVER p AS total,
                           sum(near) OVER (PARTITION BY namespace, deployment, r ORDER BY i) AS upto
                    FROM sd WINDOW p AS (PARTITION BY namespace, deployment, r)) w0) w1) q
  WHERE step < 7 AND far > 0),
seeds AS (SELECT DISTINCT namespace, deployment, r, step, seed FROM sd),
most AS (
  SELECT c.namespace, c.deployment, least(8, any_value(c.n) - 1, max(s.step) + 1) AS k
  FROM cells c JOIN seeds s ON s.r = 0 AND c.namespace = s.namespace AND c.deployment = s.deployment GROUP BY ALL),
ks AS (SELECT namespace, deployment, unnest(range(least(2, k), k + 1)) AS k FROM most),
start AS (
  SELECT ks.namespace, ks.deployment, ks.k, s.r, list({{'lab': s.step, 'c': s.seed}} ORDER BY s.step) AS cs
  FROM ks JOIN seeds s ON ks.namespace = s.namespace AND ks.deployment = s.deployment AND s.step < ks.k GROUP BY ALL),
lk AS (
  SELECT c.namespace, c.deployment, s.k, s.r, 0 AS iter, c.i, c.z, {nearest.format('s.cs', 'c.z')} AS lab, CAST(NULL AS INTEGER) AS prev
  FROM cells c JOIN start s ON c.namespace = s.namespace AND c.deployment = s.deployment
  UNION ALL
  SELECT l.namespace, l.deployment, l.k, l.r, l.iter + 1, l.i, l.z, {nearest.format('q.cs', 'l.z')}, l.lab
  FROM lk l JOIN (
    SELECT namespace, deployment, k, r, list({{'lab': lab, 'c': c}} ORDER BY lab) AS cs, bool_or(moved) AS moved
    FROM (SELECT namespace, deployment, k, r, lab, [{cent}] AS c, bool_or(lab IS DISTINCT FROM prev) AS moved
          FROM lk GROUP BY namespace, deployment, k, r, lab)
    GROUP BY namespace, deployment, k, r) q
    ON l.namespace = q.namespace AND l.deployment = q.deployment AND l.k = q.k AND l.r = q.r
  WHERE q.moved AND l.iter < 300),
tried AS (SELECT * FROM lk QUALIFY iter = max(iter) OVER (PARTITION BY namespace, deployment, k, r)),
inertia AS (
  SELECT namespace, deployment, k, r, sum(e) AS e
  FROM (SELECT namespace, deployment, k, r, lab, count(*) * ({" + ".join(f"var_pop(z[{n}])" for n in range(1, 6))}) AS e FROM tried GROUP BY ALL)
  GROUP BY ALL),
chosen AS (SELECT * FROM inertia QUALIFY row_number() OVER (PARTITION BY namespace, deployment, k ORDER BY round(e, 9), r) = 1),
fit AS (
  SELECT t.namespace, t.deployment, t.k, t.i, t.z, t.lab
  FROM tried t JOIN chosen c ON t.namespace = c.namespace AND t.deployment = c.deployment AND t.k = c.k AND t.r = c.r),
pd AS (
  SELECT a.namespace, a.deployment, a.i, b.i AS o, sqrt({_dist('a.z', 'b.z')}) AS d
  FROM cells a JOIN cells b ON a.namespace = b.namespace AND a.deployment = b.deployment AND a.i <> b.i),
pm AS (
  SELECT f.namespace, f.deployment, f.k, f.i, f.lab AS ca, g.lab AS cb, avg(pd.d) AS md
  FROM fit f JOIN pd ON f.namespace = pd.namespace AND f.deployment = pd.deployment AND f.i = pd.i
  JOIN fit g ON g.namespace = f.namespace AND g.deployment = f.deployment AND g.k = f.k AND g.i = pd.o
  GROUP BY ALL),
pa AS (
  SELECT namespace, deployment, k, i, max(CASE WHEN ca = cb THEN md END) AS a, min(CASE WHEN ca <> cb THEN md END) AS b
  FROM pm GROUP BY ALL),
sz AS (
  SELECT namespace, deployment, k, count(*) AS n, count(DISTINCT lab) AS c FROM fit GROUP BY ALL),
sil AS (
  SELECT sz.namespace, sz.deployment, sz.k, CASE WHEN any_value(c) < 2 OR any_value(c) >= any_value(n) THEN NULL ELSE
         avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) END AS score
  FROM sz JOIN pa ON sz.namespace = pa.namespace AND sz.deployment = pa.deployment AND sz.k = pa.k
  GROUP BY sz.namespace, sz.deployment, sz.k),
pick AS (
  SELECT *, row_number() OVER (PARTITION BY namespace, deployment ORDER BY coalesce(round(score, 9), -2) DESC, k) AS rn FROM sil),
lab0 AS (
  SELECT f.namespace, f.deployment, f.k, f.i, p.score, min(f.i) OVER (PARTITION BY f.namespace, f.deployment, f.lab) AS first_i
  FROM fit f JOIN pick p ON p.rn = 1 AND f.namespace = p.namespace AND f.deployment = p.deployment AND f.k = p.k),
lab AS (
  SELECT l.namespace, l.deployment, l.k, c.day_of_week, c.time_slot, l.score,
         dense_rank() OVER (PARTITION BY l.namespace, l.deployment ORDER BY l.first_i) - 1 AS cluster
  FROM lab0 l JOIN cells c ON l.namespace = c.namespace AND l.deployment = c.deployment AND l.i = c.i)"""


_reg("kmeans_best_k", f"""WITH RECURSIVE {_fit_cte()}
SELECT namespace, deployment, CAST(k AS BIGINT) AS k, CAST(day_of_week AS BIGINT) AS day_of_week,
       CAST(time_slot AS BIGINT) AS time_slot, CAST(cluster AS BIGINT) AS cluster, round(score, 6) AS score
FROM lab""")

_reg("v1_patterns", f"""WITH RECURSIVE {_fit_cte()},
{_REFINED}{_MERGED}
SELECT namespace, deployment, {_PATTERN_OUT} FROM merged_p""")

_reg("v1_triggers", _v1_triggers_sql(f"{_fit_cte()},\n{_REFINED}{_MERGED}"))

_reg("pattern_report", f"""WITH RECURSIVE {_fit_cte()},
{_REFINED}{_MERGED},
cnt AS (
  SELECT namespace, deployment, count(*) FILTER (WHERE metric_type = 'cpu') AS c,
         count(*) FILTER (WHERE metric_type = 'memory') AS m, count(*) FILTER (WHERE metric_type = 'replicas') AS r
  FROM ser GROUP BY ALL),
rep AS (
  SELECT namespace, deployment, list({{'startHour': start_hour, 'startMinute': start_minute, 'endHour': end_hour,
           'endMinute': end_minute, 'days': days, 'avgCpu': CAST(CAST(avg_cpu AS DECIMAL(30, 9)) AS DECIMAL(24, 6)),
           'avgMemory': CAST(CAST(avg_memory AS DECIMAL(30, 9)) AS DECIMAL(24, 6)), 'avgReplicas': CAST(CAST(avg_replicas AS DECIMAL(30, 9)) AS DECIMAL(24, 6)),
           'peakReplicas': peak_replicas, 'confidence': CAST(CAST(confidence AS DECIMAL(30, 9)) AS DECIMAL(24, 6))}} ORDER BY pattern_id) AS es
  FROM merged_p GROUP BY ALL)
SELECT c.namespace, c.deployment, CAST(coalesce(len(es), 0) AS BIGINT) AS patterns_detected,
       CAST(to_json({{'success': true, 'patterns': coalesce(es, []),
                'stats': {{'cpuDataPoints': c.c, 'memoryDataPoints': c.m, 'replicaDataPoints': c.r,
                          'patternsDetected': coalesce(len(es), 0)}}}}) AS VARCHAR) AS report
FROM cnt c LEFT JOIN rep ON c.namespace = rep.namespace AND c.deployment = rep.deployment""")

_reg("v1_default_triggers", f"""WITH {_samples_cte()},
wl AS (SELECT DISTINCT namespace, deployment FROM ms),
cpu AS (SELECT DISTINCT f.namespace, f.deployment FROM ({ORACLE["v1_triggers_fixed"]}) f
        JOIN ev ON ev.namespace = f.namespace AND ev.deployment = f.deployment AND f.pattern_type <> 'default'
               AND ev.event_type = 'view' AND ev.ts BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF})
SELECT namespace, deployment, 'default-business-hours' AS name, 'default' AS pattern_type,
       CAST(100 AS BIGINT) AS priority, 'UTC' AS timezone, '09:00:00' AS start_time, '17:00:00' AS end_time,
       'M,TU,W,TH,F' AS recurring, CAST(2 AS BIGINT) AS min_replicas, CAST(10 AS BIGINT) AS max_replicas,
       CAST(1 AS BIGINT) AS end_min_replicas, CAST(3 AS BIGINT) AS end_max_replicas, 0.5 AS confidence
FROM wl WHERE NOT EXISTS (SELECT 1 FROM cpu WHERE cpu.namespace = wl.namespace AND cpu.deployment = wl.deployment)""")


# ---------------------------------------------------------------------------
# documents and run statistics
# ---------------------------------------------------------------------------

RS_ALL = _samples_cte() + """,
rs_all AS (
  SELECT namespace, deployment, metric_type, metric_name, pod, container, series_id,
         time_bucket(INTERVAL '5 minutes', ts) AS bucket, arg_max(value, ts) AS value
  FROM ms WHERE value IS NOT NULL GROUP BY ALL)"""

_reg("matrix_json_roundtrip", f"""WITH {RS_ALL}
SELECT namespace, deployment, pod, metric_name, series_id, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS ts,
       round(value, 6) AS value
FROM rs_all""")

_reg("matrix_replica_series", f"""WITH {RS_ALL}
SELECT namespace, deployment, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS ts,
       round(greatest(CAST(0 AS DOUBLE), max(value)), 6) AS value
FROM rs_all WHERE metric_type = 'replicas' GROUP BY namespace, deployment, bucket""")


def _trigger_struct_sql() -> str:
    return ("{'name': name, 'priority': CAST(priority AS INTEGER), 'timezone': timezone, "
            "'interval': {'recurring': recurring}, 'startTime': start_time, 'endTime': end_time, "
            "'startHPAConfig': {'minReplicas': CAST(min_replicas AS INTEGER), "
            "'maxReplicas': CAST(max_replicas AS INTEGER)}, "
            "'endHPAConfig': {'minReplicas': CAST(end_min_replicas AS INTEGER), "
            "'maxReplicas': CAST(end_max_replicas AS INTEGER)}}")


ALLTRIG = v2_trigger_cte() + """,
alltrig AS (SELECT * FROM trig UNION ALL SELECT * FROM dflt)"""

_reg("trigger_json", f"""WITH {ALLTRIG}
SELECT namespace, deployment, name, CAST(to_json({_trigger_struct_sql()}) AS VARCHAR) AS trigger_json
FROM alltrig""")

_reg("policy_documents", f"""WITH {ALLTRIG}
SELECT namespace, deployment, CAST(count(*) AS BIGINT) AS n_triggers,
       CAST(to_json({{'apiVersion': 'tempora/v1', 'kind': 'ScalingSchedule',
                'metadata': {{'name': deployment || '-schedule', 'namespace': coalesce(nullif(namespace, ''), 'default')}},
                'spec': {{'HPAObjectRef': {{'name': deployment || '-hpa',
                                           'namespace': coalesce(nullif(namespace, ''), 'default')}},
                         'triggers': list({_trigger_struct_sql()} ORDER BY priority DESC, name)}}}}) AS VARCHAR)
         AS document
FROM alltrig GROUP BY namespace, deployment""")

_reg("run_stats", f"""WITH {ALLTRIG},
{_samples_cte().replace(EV + ",", "", 1).strip()},
pts AS (
  SELECT namespace, deployment, count(*) FILTER (WHERE metric_type = 'cpu') AS cpu_points,
         count(*) FILTER (WHERE metric_type = 'memory') AS memory_points,
         count(*) FILTER (WHERE metric_type = 'replicas') AS replicas_points
  FROM fb GROUP BY ALL),
pc AS (SELECT namespace, deployment, count(*) AS patterns FROM pat GROUP BY ALL),
tc AS (SELECT namespace, deployment, count(*) AS triggers FROM alltrig GROUP BY ALL),
rst AS (
  SELECT namespace, deployment, round(avg(value), 2) AS avg_replicas,
         CAST(trunc(max(value)) AS BIGINT) AS max_replicas, CAST(trunc(min(value)) AS BIGINT) AS min_replicas,
         count(*) AS data_points
  FROM cl GROUP BY ALL)
SELECT r.namespace, r.deployment, CAST(r.data_points AS BIGINT) AS data_points,
       CAST(p.cpu_points AS BIGINT) AS cpu_points, CAST(p.memory_points AS BIGINT) AS memory_points,
       CAST(p.replicas_points AS BIGINT) AS replicas_points,
       CAST(coalesce(pc.patterns, 0) AS BIGINT) AS patterns, CAST(coalesce(tc.triggers, 0) AS BIGINT) AS triggers,
       round(r.avg_replicas, 6) AS avg_replicas, r.max_replicas, r.min_replicas
FROM rst r
LEFT JOIN pts p ON r.namespace = p.namespace AND r.deployment = p.deployment
LEFT JOIN pc ON r.namespace = pc.namespace AND r.deployment = pc.deployment
LEFT JOIN tc ON r.namespace = tc.namespace AND r.deployment = tc.deployment""")


# ---------------------------------------------------------------------------
# policy tables
# ---------------------------------------------------------------------------

_reg("policies_for_hpa", f"""WITH {_policy_cte()},
polt AS (SELECT *, coalesce(nullif(hpa_namespace, ''), policy_namespace) AS tns FROM pol)
SELECT h.hns AS hpa_namespace, h.hname AS hpa_name, p.policy_namespace, p.policy_name
FROM hpa h JOIN polt p ON h.hns = p.tns AND h.hname = p.hpa_name""")

_reg("dangling_refs", f"""WITH {_policy_cte()},
polt AS (SELECT *, coalesce(nullif(hpa_namespace, ''), policy_namespace) AS tns FROM pol)
SELECT policy_namespace, policy_name, tns AS hpa_target_namespace, hpa_name
FROM polt p
WHERE coalesce(hpa_name, '') <> ''
  AND NOT EXISTS (SELECT 1 FROM hpa h WHERE h.hns = p.tns AND h.hname = p.hpa_name)""")

_reg("policy_snapshot_diff", f"""WITH {RS},
snap AS (
  SELECT CASE WHEN dayofmonth(ts) <= 15 THEN 1 ELSE 2 END AS half, namespace AS policy_namespace,
         deployment || '-schedule' AS policy_name, count(DISTINCT isodow(ts)) AS generation
  FROM rs GROUP BY ALL),
a AS (SELECT * FROM snap WHERE half = 1),
b AS (SELECT * FROM snap WHERE half = 2)
SELECT coalesce(a.policy_namespace, b.policy_namespace) AS policy_namespace,
       coalesce(a.policy_name, b.policy_name) AS policy_name,
       CAST(a.generation AS DOUBLE) AS gen_before, CAST(b.generation AS DOUBLE) AS gen_after,
       CASE WHEN a.generation IS NULL THEN 'new' WHEN b.generation IS NULL THEN 'deleted'
            WHEN a.generation <> b.generation THEN 'changed' ELSE 'unchanged' END AS status
FROM a FULL OUTER JOIN b ON a.policy_namespace = b.policy_namespace AND a.policy_name = b.policy_name""")

_reg("namespaces", f"""WITH {_policy_cte()}
SELECT policy_namespace AS namespace FROM pol UNION SELECT 'default'""")


# ---------------------------------------------------------------------------
# planned hour-of-day analyzer
# ---------------------------------------------------------------------------

def _planned_tail() -> str:
    return f""",
hpts AS (SELECT namespace, deployment, date_trunc('hour', ts) AS hour_ts, arg_max(value, ts) AS value
         FROM cl GROUP BY ALL),
pts_h AS (SELECT *, hour(hour_ts) AS hour,
                 CASE WHEN isodow(hour_ts) - 1 >= 5 THEN 'weekend' ELSE 'weekday' END AS day_type FROM hpts),
spl0 AS (
  SELECT namespace, deployment,
         quantile_cont(value, 0.95) FILTER (WHERE day_type = 'weekday') AS weekday_p95,
         quantile_cont(value, 0.95) FILTER (WHERE day_type = 'weekend') AS weekend_p95,
         quantile_cont(value, 0.5) AS overall_p50, count(*) AS points
  FROM pts_h GROUP BY ALL),
spl AS (
  SELECT *, CASE WHEN weekday_p95 > 0 THEN abs(weekday_p95 - weekend_p95) / weekday_p95 * 100 END AS diff_pct,
         coalesce(CASE WHEN weekday_p95 > 0 THEN abs(weekday_p95 - weekend_p95) / weekday_p95 * 100 END
                  > 20, false) AS split
  FROM spl0),
hpk AS (
  SELECT p.namespace, p.deployment, CASE WHEN s.split THEN p.day_type ELSE 'daily' END AS dtype, p.hour,
         s.overall_p50, quantile_cont(p.value, 0.5) AS p50, quantile_cont(p.value, 0.95) AS p95
  FROM pts_h p JOIN spl s ON p.namespace = s.namespace AND p.deployment = s.deployment
  WHERE s.points >= 72 GROUP BY ALL),
isl AS (
  SELECT *, hour - row_number() OVER (PARTITION BY namespace, deployment, dtype ORDER BY hour) AS grp
  FROM hpk WHERE p95 > overall_p50 * 1.5),
gw AS (
  SELECT namespace, deployment, dtype, grp, min(hour) AS start_hour, max(hour) + 1 AS end_hour,
         CAST(ceil(max(p50)) AS INTEGER) AS min_r, CAST(ceil(max(p95)) AS INTEGER) AS max_r, max(p95) AS peak_p95
  FROM isl GROUP BY ALL),
gen AS (
  SELECT namespace, deployment,
         'ai-peak-' || dtype || '-' || lpad(CAST(start_hour AS VARCHAR), 2, '0') || '-'
           || lpad(CAST(end_hour AS VARCHAR), 2, '0') AS name,
         dtype AS day_type,
         100 - (row_number() OVER (PARTITION BY namespace, deployment ORDER BY peak_p95 DESC, dtype, start_hour) - 1)
           * 10 AS priority,
         CASE dtype WHEN 'weekday' THEN 'M,TU,W,TH,F' WHEN 'weekend' THEN 'SAT,SUN' ELSE 'M,TU,W,TH,F,SAT,SUN' END AS recurring,
         lpad(CAST(start_hour AS VARCHAR), 2, '0') || ':00:00' AS start_time,
         CASE WHEN start_hour = 0 AND end_hour = 24 THEN '23:59:59' ELSE lpad(CAST(end_hour % 24 AS VARCHAR), 2, '0') || ':00:00' END AS end_time,
         min_r AS min_replicas, greatest(max_r, min_r) AS max_replicas, peak_p95
  FROM gw)"""


CL30 = _cl(30)
PLANNED = CL30 + _planned_tail()


# every minute of the week, by each window's own clock
_IN = "CASE WHEN s <= e THEN cur >= s AND cur < e ELSE cur >= s OR cur < e END"
_DAY = "['SUN', 'M', 'TU', 'W', 'TH', 'F', 'SAT'][dayofweek({}) + 1]"
OVERLAP_TAIL = f""",
wk AS (SELECT TIMESTAMP '2024-01-22' + to_minutes(CAST(m AS BIGINT)) AS ts FROM range(10080) r(m)),
gmin AS (
  SELECT namespace, deployment, name, ts
  FROM (SELECT g.namespace, g.deployment, g.name, g.recurring, wk.ts, hour(wk.ts) * 60 + minute(wk.ts) AS cur,
               {_mins('g.start_time')} AS s, {_mins('g.end_time')} AS e FROM gen g CROSS JOIN wk)
  WHERE list_contains({_codes('recurring')}, {_DAY.format('ts')}) AND {_IN}),
mloc AS (
  SELECT m.*, wk.ts, timezone(coalesce(z.name, 'UTC'), wk.ts AT TIME ZONE 'UTC') AS local_ts, {_mins('m.start_time')} AS s, {_mins('m.end_time')} AS e
  FROM manual m LEFT JOIN pg_timezone_names() z ON m.timezone = z.name CROSS JOIN wk
  WHERE NOT starts_with(m.name, 'ai-') AND m.has_interval AND {_ok('m.start_time')} AND {_ok('m.end_time')}),
mmin AS (
  SELECT namespace, deployment, name, ts FROM (SELECT *, hour(local_ts) * 60 + minute(local_ts) AS cur FROM mloc)
  WHERE {_IN} AND CASE WHEN coalesce(recurring, '') <> '' THEN list_contains({_codes('recurring')}, {_DAY.format('local_ts')})
                       ELSE coalesce(ts > try_strptime(start_date, '%Y-%m-%d') AND ts < try_strptime(end_date, '%Y-%m-%d'), false) END),
hits AS (
  SELECT g.namespace, g.deployment, g.name, m.name AS m_name, count(*) AS minutes
  FROM gmin g JOIN mmin m ON g.namespace = m.namespace AND g.deployment = m.deployment AND g.ts = m.ts GROUP BY ALL),
ovl AS (
  SELECT g.namespace, g.deployment, g.name, coalesce(bool_or(h.minutes >= 60), false) AS suppressed,
         min(h.m_name) FILTER (WHERE h.minutes >= 60) AS blocked_by
  FROM (SELECT DISTINCT namespace, deployment, name FROM gen) g
  LEFT JOIN hits h ON g.namespace = h.namespace AND g.deployment = h.deployment AND g.name = h.name GROUP BY ALL)"""

_reg("data_gate", f"""WITH {PLANNED}
SELECT namespace, deployment, CAST(count(*) AS BIGINT) AS hourly_points, count(*) >= 72 AS sufficient,
       CASE WHEN count(*) >= 72 THEN 'Analyzed' ELSE 'InsufficientData' END AS status
FROM pts_h GROUP BY ALL""")

_reg("hour_percentiles", f"""WITH {PLANNED}
SELECT namespace, deployment, CAST(hour AS BIGINT) AS hour, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.95), 6) AS p95, CAST(count(*) AS BIGINT) AS n
FROM pts_h GROUP BY ALL""")

_reg("weekend_split", f"""WITH {PLANNED}
SELECT namespace, deployment, round(weekday_p95, 6) AS weekday_p95, round(weekend_p95, 6) AS weekend_p95,
       round(overall_p50, 6) AS overall_p50, round(diff_pct, 6) AS diff_pct, split
FROM spl""")

_reg("peak_windows", f"""WITH {PLANNED}
SELECT namespace, deployment, name, day_type, CAST(priority AS BIGINT) AS priority, recurring, start_time,
       end_time, CAST(min_replicas AS BIGINT) AS min_replicas, CAST(max_replicas AS BIGINT) AS max_replicas,
       round(peak_p95, 6) AS peak_p95
FROM gen""")

_reg("manual_overlap", f"""WITH {CL30}{_policy_tail('manual')}{_planned_tail()}{OVERLAP_TAIL}
SELECT namespace, deployment, name, suppressed, blocked_by FROM ovl""")

_reg("deviation", f"""WITH {CL30}{_policy_tail('manual')}{_planned_tail()}{OVERLAP_TAIL},
ai AS (SELECT g.* FROM gen g JOIN ovl o ON g.namespace = o.namespace AND g.deployment = o.deployment
                                         AND g.name = o.name
       WHERE NOT o.suppressed),
ai_flat AS (
  SELECT a.namespace, a.deployment, p.policy_namespace, p.policy_name, p.hpa_namespace, p.hpa_name,
         coalesce(nullif(p.hpa_namespace, ''), p.policy_namespace) AS hpa_target_namespace,
         a.name, CAST(a.priority AS INTEGER) AS priority, 'UTC' AS timezone,
         true AS has_interval, a.recurring, CAST(NULL AS VARCHAR) AS start_date, CAST(NULL AS VARCHAR) AS end_date,
         a.start_time, a.end_time, CAST(a.min_replicas AS INTEGER) AS start_min,
         CAST(a.max_replicas AS INTEGER) AS start_max, CAST(NULL AS INTEGER) AS end_min,
         CAST(NULL AS INTEGER) AS end_max, false AS suspend
  FROM ai a JOIN pol p ON a.namespace = p.namespace AND a.deployment = p.deployment),
trig AS (SELECT * FROM manual UNION ALL SELECT * FROM ai_flat){STATES_TAIL}
SELECT r.namespace, r.deployment, strftime(r.ts, '%Y-%m-%d %H:%M:%S') AS ts, act.active_name,
       round(r.value, 6) AS value, CAST(ai.min_replicas AS BIGINT) AS min_replicas,
       CAST(ai.max_replicas AS BIGINT) AS max_replicas
FROM rs r
JOIN act ON r.namespace = act.namespace AND r.deployment = act.deployment AND r.ts = act.ts
JOIN ai ON ai.namespace = act.namespace AND ai.deployment = act.deployment AND ai.name = act.active_name
WHERE starts_with(act.active_name, 'ai-')
  AND (r.value < ai.min_replicas * (1 - 0.2) OR r.value > ai.max_replicas * (1 + 0.2))""")

_reg("active_trigger_rowwise", f"""WITH {STATES}
SELECT namespace, deployment, {TS}, active_name, CAST(active_priority AS DOUBLE) AS active_priority
FROM act""")

_reg("policies_for_changed_hpa", f"""WITH {_policy_cte()},
snap AS (
  SELECT CASE WHEN dayofmonth(ts) <= 15 THEN 1 ELSE 2 END AS half, namespace, deployment,
         count(DISTINCT isodow(ts)) AS generation
  FROM rs GROUP BY ALL),
chg AS (
  SELECT a.namespace, a.deployment || '-hpa' AS name
  FROM snap a JOIN snap b ON a.namespace = b.namespace AND a.deployment = b.deployment
  WHERE a.half = 1 AND b.half = 2 AND a.generation <> b.generation),
polt AS (SELECT *, coalesce(nullif(hpa_namespace, ''), policy_namespace) AS tns FROM pol)
SELECT policy_namespace, policy_name FROM polt p
WHERE EXISTS (SELECT 1 FROM chg c WHERE c.namespace = p.tns AND c.name = p.hpa_name)""")

_reg("policy_documents_roundtrip", f"""WITH {ALLTRIG}
SELECT coalesce(nullif(namespace, ''), 'default') AS policy_namespace, deployment || '-schedule' AS policy_name,
       coalesce(nullif(namespace, ''), 'default') AS hpa_target_namespace, deployment || '-hpa' AS hpa_name,
       name, CAST(priority AS BIGINT) AS priority, timezone, recurring, start_time, end_time,
       CAST(min_replicas AS BIGINT) AS start_min, CAST(max_replicas AS BIGINT) AS start_max,
       CAST(end_min_replicas AS BIGINT) AS end_min, CAST(end_max_replicas AS BIGINT) AS end_max, false AS suspend
FROM alltrig""")


def _pair_dist() -> str:
    return "sqrt(" + " + ".join(f"coalesce((a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c}), 0.0)" for c in _FEATURES) + ")"


# brute force over all cell pairs of a workload (the Spark side never emits pairs)
_reg("silhouette_fixed_labels", f"""WITH {_assign_cte()},
zl AS (
  SELECT z.*, l.cluster FROM zgrid z JOIN lab l ON z.namespace = l.namespace AND z.deployment = l.deployment
    AND z.day_of_week = l.day_of_week AND z.time_slot = l.time_slot),
pairs AS (
  SELECT a.namespace, a.deployment, a.day_of_week, a.time_slot, a.cluster AS ca, b.cluster AS cb,
         {_pair_dist()} AS d
  FROM zl a JOIN zl b ON a.namespace = b.namespace AND a.deployment = b.deployment
   AND NOT (a.day_of_week = b.day_of_week AND a.time_slot = b.time_slot)),
pc AS (
  SELECT namespace, deployment, day_of_week, time_slot, ca, cb, avg(d) AS md
  FROM pairs GROUP BY ALL),
si AS (
  SELECT namespace, deployment, day_of_week, time_slot,
         max(CASE WHEN ca = cb THEN md END) AS a, min(CASE WHEN ca <> cb THEN md END) AS b
  FROM pc GROUP BY ALL),
s AS (
  SELECT namespace, deployment,
         avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS sil
  FROM si GROUP BY ALL),
n AS (SELECT namespace, deployment, count(*) AS n_cells, count(DISTINCT cluster) AS n_clusters FROM zl GROUP BY ALL)
SELECT n.namespace, n.deployment,
       round(CASE WHEN n.n_clusters < 2 OR n.n_clusters >= n.n_cells THEN NULL ELSE coalesce(s.sil, 0.0) END, 6)
         AS silhouette,
       CAST(n.n_cells AS BIGINT) AS n_cells, CAST(n.n_clusters AS BIGINT) AS n_clusters
FROM n LEFT JOIN s ON n.namespace = s.namespace AND n.deployment = s.deployment""")


_PREPARED = f"""(SELECT tr.*, coalesce(z.zone_name, 'UTC') AS zone, {_mins('tr.start_time')} AS s, {_mins('tr.end_time')} AS e
          FROM trig tr LEFT JOIN (SELECT name AS zone_name FROM pg_timezone_names()) z ON tr.timezone = z.zone_name
          WHERE {_ok('tr.start_time')} AND {_ok('tr.end_time')})"""
_SPAN = "(SELECT namespace, deployment, min(ts) AS t0, max(ts) AS t1 FROM rs GROUP BY ALL)"
_DAYS = """CROSS JOIN LATERAL (SELECT unnest(range(CAST(sp.t0 AS DATE) - INTERVAL 1 DAY,
                                            CAST(sp.t1 AS DATE) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS day) d"""
_TICKS = f"""
  SELECT DISTINCT k.namespace, k.deployment, k.ts FROM (
    SELECT t.namespace, t.deployment, sp.t0, sp.t1,
           timezone('UTC', (CAST(d.day AS TIMESTAMP) + to_minutes(CAST(m.mm AS BIGINT))) AT TIME ZONE t.zone) AS ts
    FROM {_PREPARED} t
    JOIN {_SPAN} sp ON t.namespace = sp.namespace AND t.deployment = sp.deployment
    {_DAYS}
    CROSS JOIN LATERAL (SELECT unnest([t.s, t.e, 0]) AS mm) m
    UNION ALL SELECT namespace, deployment, t0, t1, t0 FROM {_SPAN}
    UNION ALL
    SELECT t.namespace, t.deployment, sp.t0, sp.t1, CAST(x.at AS TIMESTAMP)
    FROM {_PREPARED} t JOIN {_SPAN} sp ON t.namespace = sp.namespace AND t.deployment = sp.deployment
    CROSS JOIN LATERAL (SELECT unnest([try_strptime(t.start_date, '%Y-%m-%d') + INTERVAL 1 SECOND,
                                       try_strptime(t.end_date, '%Y-%m-%d')]) AS at) x
    WHERE coalesce(t.recurring, '') = '' AND t.start_date IS NOT NULL) k
  WHERE k.ts BETWEEN k.t0 AND k.t1"""

_reg("schedule_boundaries", f"""WITH {RS}{_policy_tail(inst_sql=_TICKS)}{STATES_TAIL},
lagged AS (
  SELECT *, row_number() OVER w AS rn,
         lag(min_replicas) OVER w AS pmin, lag(max_replicas) OVER w AS pmax
  FROM bounds WINDOW w AS (PARTITION BY namespace, deployment, policy_namespace, policy_name ORDER BY ts))
SELECT namespace, deployment, policy_namespace, policy_name, {TS}, source, CAST(min_replicas AS DOUBLE) AS min_replicas,
       CAST(max_replicas AS DOUBLE) AS max_replicas, error
FROM lagged
WHERE rn = 1 OR min_replicas IS DISTINCT FROM pmin OR max_replicas IS DISTINCT FROM pmax""")

_reg("stream_resample_batch", f"""WITH {EV}
SELECT namespace, deployment, strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS ts,
       round(greatest(CAST(0 AS DOUBLE), max(value)), 6) AS value, CAST(count(*) AS BIGINT) AS n
FROM ev WHERE value IS NOT NULL
GROUP BY namespace, deployment, time_bucket(INTERVAL '5 minutes', ts)""")

_reg("profile_partials_merge", f"""WITH {RS}
SELECT namespace, deployment, CAST(isodow(ts) - 1 AS BIGINT) AS dow, CAST(hour(ts) AS BIGINT) AS hour,
       round(avg(value), 6) AS avg, round(max(value), 6) AS max, round(min(value), 6) AS min,
       round(stddev_pop(value), 6) AS std, CAST(count(*) AS BIGINT) AS count
FROM rs GROUP BY ALL""")


_reg("deviation_alert_intervals", f"""WITH {CL30}{_policy_tail('manual')}{_planned_tail()}{OVERLAP_TAIL},
ai AS (SELECT g.* FROM gen g JOIN ovl o ON g.namespace = o.namespace AND g.deployment = o.deployment
                                         AND g.name = o.name
       WHERE NOT o.suppressed),
ai_flat AS (
  SELECT a.namespace, a.deployment, p.policy_namespace, p.policy_name, p.hpa_namespace, p.hpa_name,
         coalesce(nullif(p.hpa_namespace, ''), p.policy_namespace) AS hpa_target_namespace,
         a.name, CAST(a.priority AS INTEGER) AS priority, 'UTC' AS timezone,
         true AS has_interval, a.recurring, CAST(NULL AS VARCHAR) AS start_date, CAST(NULL AS VARCHAR) AS end_date,
         a.start_time, a.end_time, CAST(a.min_replicas AS INTEGER) AS start_min,
         CAST(a.max_replicas AS INTEGER) AS start_max, CAST(NULL AS INTEGER) AS end_min,
         CAST(NULL AS INTEGER) AS end_max, false AS suspend
  FROM ai a JOIN pol p ON a.namespace = p.namespace AND a.deployment = p.deployment),
trig AS (SELECT * FROM manual UNION ALL SELECT * FROM ai_flat){STATES_TAIL}
SELECT DISTINCT r.namespace, r.deployment,
       strftime(date_trunc('hour', r.ts), '%Y-%m-%d %H:%M:%S') AS interval_start
FROM rs r
JOIN act ON r.namespace = act.namespace AND r.deployment = act.deployment AND r.ts = act.ts
JOIN ai ON ai.namespace = act.namespace AND ai.deployment = act.deployment AND ai.name = act.active_name
WHERE starts_with(act.active_name, 'ai-')
  AND (r.value < ai.min_replicas * (1 - 0.2) OR r.value > ai.max_replicas * (1 + 0.2))""")


# events of triggers: clock jobs of every trigger with an interval (dated ones run daily), and a
# rebuild at the span's start and at each midnight
_KNOWN = f"list_filter({_codes('t.recurring')}, lambda x: list_contains(['SUN', 'M', 'TU', 'W', 'TH', 'F', 'SAT'], x))"
_EVENT_ROWS = f""",
mid AS (
  SELECT namespace, deployment, t0 AS ts FROM {_SPAN}
  UNION
  SELECT namespace, deployment, unnest(range(date_trunc('day', t0) + INTERVAL 1 DAY, t1 + INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) FROM {_SPAN}),
evt AS (
  SELECT t.namespace, t.deployment, t.policy_namespace, t.policy_name, t.hpa_target_namespace, t.hpa_name, t.name,
         coalesce(t.priority, 0) AS priority, m.kind, t.start_min, t.start_max, t.end_min, t.end_max,
         timezone('UTC', (CAST(d.day AS TIMESTAMP) + to_minutes(CAST(CASE m.kind WHEN 'start' THEN t.s ELSE t.e END AS BIGINT)))
                         AT TIME ZONE t.zone) AS ts, sp.t0, sp.t1
  FROM {_PREPARED} t JOIN {_SPAN} sp ON t.namespace = sp.namespace AND t.deployment = sp.deployment
  {_DAYS}
  CROSS JOIN (VALUES ('start'), ('end')) m(kind)
  WHERE t.has_interval AND (coalesce(t.recurring, '') <> '' OR (coalesce(t.start_date, '') <> '' AND coalesce(t.end_date, '') <> ''))
    AND (coalesce(len({_KNOWN}), 0) = 0 OR list_contains({_KNOWN}, ['SUN', 'M', 'TU', 'W', 'TH', 'F', 'SAT'][dayofweek(d.day) + 1]))),
inst AS (SELECT DISTINCT namespace, deployment, ts FROM evt WHERE ts BETWEEN t0 AND t1 UNION SELECT * FROM mid)"""

_EVENTS = RS + _policy_tail().rsplit(",\ninst AS", 1)[0] + _EVENT_ROWS + STATES_TAIL + """,
oth AS (
  SELECT v.namespace, v.deployment, v.policy_name, v.ts, v.name, v.kind, max(o.priority) AS top,
         first({'name': o.name, 'mn': o.start_min, 'mx': o.start_max} ORDER BY o.priority DESC, o.name) AS nxt
  FROM evt v JOIN st o ON v.namespace = o.namespace AND v.deployment = o.deployment AND v.policy_name = o.policy_name
                      AND v.ts = o.ts AND o.name <> v.name AND o.state = 'Within'
  GROUP BY ALL),
again AS (
  SELECT st.*, max(priority) FILTER (WHERE state = 'Within') OVER (PARTITION BY st.namespace, st.deployment, policy_name, st.ts) AS top
  FROM st JOIN mid ON st.namespace = mid.namespace AND st.deployment = mid.deployment AND st.ts = mid.ts),
evd AS (
  SELECT v.namespace, v.deployment, v.policy_namespace, v.policy_name, v.hpa_target_namespace, v.hpa_name, v.ts, v.name, v.priority, v.kind,
         CASE WHEN v.kind = 'start' THEN CASE WHEN coalesce(top > v.priority, false) THEN NULL
                        ELSE {'name': v.name, 'mn': v.start_min, 'mx': v.start_max} END
                   WHEN nxt IS NULL THEN {'name': v.name, 'mn': v.end_min, 'mx': v.end_max}
                   WHEN top > v.priority THEN NULL ELSE nxt END AS c
  FROM evt v LEFT JOIN oth x ON v.namespace = x.namespace AND v.deployment = x.deployment AND v.policy_name = x.policy_name
                            AND v.ts = x.ts AND v.name = x.name AND v.kind = x.kind
  WHERE v.ts BETWEEN v.t0 AND v.t1
  UNION ALL
  SELECT namespace, deployment, policy_namespace, policy_name, hpa_target_namespace, hpa_name, ts, name, priority, 'refresh',
         CASE WHEN state = 'Within' THEN {'name': name, 'mn': start_min, 'mx': start_max} ELSE {'name': name, 'mn': end_min, 'mx': end_max} END
  FROM again WHERE (state = 'Within' AND priority = top) OR (state = 'After' AND top IS NULL))"""

_reg("trigger_events", f"""WITH {_EVENTS}
SELECT policy_namespace, policy_name, {TS}, name, kind, c.name AS applied, CAST(c.mn AS DOUBLE) AS mn,
       CAST(c.mx AS DOUBLE) AS mx FROM evd""")

_REPLAY = f"""{_EVENTS},
pe AS (
  SELECT namespace, deployment, policy_namespace, policy_name, hpa_target_namespace, hpa_name, ts, name, kind, c,
         row_number() OVER (PARTITION BY policy_namespace, policy_name
                            ORDER BY ts, list_position(['end', 'start', 'refresh'], kind), priority DESC, name) AS event
  FROM evd),
rp AS (
  SELECT p.policy_namespace, p.policy_name, CAST(0 AS BIGINT) AS event, any_value(h.cur_min) AS mn, any_value(h.cur_max) AS mx,
         CAST(NULL AS VARCHAR) AS reason
  FROM pe p JOIN hpa h ON p.hpa_target_namespace = h.hns AND p.hpa_name = h.hname GROUP BY ALL
  UNION ALL
  SELECT r.policy_namespace, r.policy_name, p.event,
         CASE WHEN ok THEN coalesce(p.c.mn, r.mn) ELSE r.mn END, CASE WHEN ok THEN coalesce(p.c.mx, r.mx) ELSE r.mx END,
         CASE WHEN ok THEN NULL WHEN p.c.mn < 0 THEN 'minReplicas cannot be negative'
              WHEN p.c.mx <= 0 THEN 'maxReplicas must be greater than 0'
              ELSE 'minReplicas (' || coalesce(p.c.mn, r.mn) || ') cannot be greater than maxReplicas (' || coalesce(p.c.mx, r.mx) || ')' END
  FROM rp r JOIN pe p ON r.policy_namespace = p.policy_namespace AND r.policy_name = p.policy_name AND p.event = r.event + 1
  CROSS JOIN LATERAL (SELECT NOT (coalesce(p.c.mn < 0, false) OR coalesce(p.c.mx <= 0, false)
                                  OR coalesce(coalesce(p.c.mn, r.mn) > coalesce(p.c.mx, r.mx), false)) AS ok) q)"""

_reg("bounds_replay", f"""WITH RECURSIVE {_REPLAY}
SELECT p.namespace, p.deployment, p.policy_namespace, p.policy_name, CAST(p.event AS BIGINT) AS event, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts,
       p.name, p.kind, p.c.name AS applied, CAST(r.mn AS DOUBLE) AS min_replicas, CAST(r.mx AS DOUBLE) AS max_replicas,
       CASE WHEN r.mx IS NULL THEN 'hpa not found' END AS error
FROM pe p LEFT JOIN rp r ON p.policy_namespace = r.policy_namespace AND p.policy_name = r.policy_name AND p.event = r.event""")

_reg("rejected_updates", f"""WITH RECURSIVE {_REPLAY}
SELECT p.namespace, p.deployment, p.policy_namespace, p.policy_name, CAST(p.event AS BIGINT) AS event, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts,
       p.name, p.kind, p.c.name AS applied, r.reason, CAST(r.mn AS DOUBLE) AS min_replicas, CAST(r.mx AS DOUBLE) AS max_replicas
FROM pe p JOIN rp r ON p.policy_namespace = r.policy_namespace AND p.policy_name = r.policy_name AND p.event = r.event
WHERE r.reason IS NOT NULL""")

_reg("active_trigger_by_interval", f"""WITH {STATES}
SELECT namespace, deployment, {TS}, active_name, CAST(active_priority AS DOUBLE) AS active_priority
FROM act""")

_reg("effective_bounds_by_interval", f"""SELECT * FROM ({ORACLE["effective_bounds"]}) b WHERE policy_name IS NOT NULL""")

# streams ---------------------------------------------------------------------
_reg("stream_resample", f"""WITH {EV},
w AS (
  SELECT namespace, deployment, time_bucket(INTERVAL '5 minutes', ts) AS b, max(value) AS mx, count(*) AS n
  FROM ev WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)
SELECT namespace, deployment, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, round(greatest(CAST(0 AS DOUBLE), mx), 6) AS value,
       CAST(n AS BIGINT) AS n
FROM w WHERE b + INTERVAL 5 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM ev) - INTERVAL 10 MINUTE""")

_reg("stream_profile", f"""WITH {EV}
SELECT namespace, deployment, CAST(isodow(ts) - 1 AS BIGINT) AS dow, CAST(hour(ts) AS BIGINT) AS hour,
       round(avg(value), 6) AS avg, round(max(value), 6) AS max, round(min(value), 6) AS min,
       round(stddev_pop(value), 6) AS std, CAST(count(*) AS BIGINT) AS count
FROM ev WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-28' - 14 AND DATE '2024-01-28' AND value IS NOT NULL AND NOT isnan(value)
GROUP BY ALL""")

_RAW_STATES = RS + _policy_tail(inst_sql="SELECT namespace, deployment, ts FROM ev") + STATES_TAIL

_reg("stream_active_trigger", f"""WITH {_RAW_STATES}
SELECT e.namespace, e.deployment, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS ts, active_name,
       CAST(active_priority AS DOUBLE) AS active_priority
FROM ev e JOIN act a ON e.namespace = a.namespace AND e.deployment = a.deployment AND e.ts = a.ts""")

_reg("stream_transitions", f"""WITH {_RAW_STATES},
lagged AS (
  SELECT *, row_number() OVER w AS rn, lag(active_name) OVER w AS from_trigger
  FROM act WINDOW w AS (PARTITION BY namespace, deployment ORDER BY ts))
SELECT namespace, deployment, {TS}, from_trigger, active_name AS to_trigger
FROM lagged WHERE rn = 1 OR from_trigger IS DISTINCT FROM active_name""")

# timers: the winner at every instant at which it can change, up to the watermark of the whole stream
_CLOCK = "(SELECT namespace, deployment, min(ts) AS t0, (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev) AS t1 FROM rs GROUP BY ALL)"
_reg("stream_timed_transitions", f"""WITH {RS}{_policy_tail(inst_sql=_TICKS.replace(_SPAN, _CLOCK))}{STATES_TAIL},
lagged AS (
  SELECT *, row_number() OVER w AS rn, lag(active_name) OVER w AS from_trigger
  FROM act WHERE EXISTS (SELECT 1 FROM trig t WHERE t.namespace = act.namespace AND t.deployment = act.deployment)
  WINDOW w AS (PARTITION BY namespace, deployment ORDER BY ts))
SELECT namespace, deployment, {TS}, from_trigger, active_name AS to_trigger
FROM lagged WHERE rn = 1 OR from_trigger IS DISTINCT FROM active_name""")

_ALL_LIVE = _policy_tail(inst_sql="SELECT namespace, deployment, ts FROM ev").replace("SELECT * FROM trig_all WHERE NOT suspend", "SELECT * FROM trig_all")
_reg("stream_policy_versions", f"""WITH {RS}{_ALL_LIVE}{STATES_TAIL},
own AS (
  SELECT st.namespace, st.deployment, st.ts, first(st.name ORDER BY st.priority DESC, st.name) AS active_name, max(st.priority) AS active_priority
  FROM st JOIN trig t ON st.namespace = t.namespace AND st.deployment = t.deployment AND st.name = t.name
  WHERE state = 'Within' AND (NOT t.suspend OR st.ts >= TIMESTAMP '2024-01-15') GROUP BY ALL)
SELECT e.namespace, e.deployment, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS ts, active_name,
       CASE WHEN e.ts >= TIMESTAMP '2024-01-15' THEN 2.0
            WHEN EXISTS (SELECT 1 FROM trig t WHERE t.namespace = e.namespace AND t.deployment = e.deployment AND NOT t.suspend) THEN 1.0 END::DOUBLE
         AS generation, CAST(active_priority AS DOUBLE) AS active_priority
FROM ev e LEFT JOIN own o ON e.namespace = o.namespace AND e.deployment = o.deployment AND e.ts = o.ts""")

_ALERTS = ORACLE["deviation"].rsplit("SELECT r.namespace", 1)[0]
_reg("stream_deviation_alerts", f"""{_ALERTS.rstrip()},
closed AS (SELECT max(ts) - INTERVAL 10 MINUTE AS upto FROM rs)
SELECT r.namespace, r.deployment, strftime(date_trunc('hour', r.ts), '%Y-%m-%d %H:%M:%S') AS interval_start,
       strftime(min(r.ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(act.active_name, r.ts) AS active_name,
       round(arg_min(r.value, r.ts), 6) AS value
FROM rs r
JOIN act ON r.namespace = act.namespace AND r.deployment = act.deployment AND r.ts = act.ts
JOIN ai ON ai.namespace = act.namespace AND ai.deployment = act.deployment AND ai.name = act.active_name
WHERE starts_with(act.active_name, 'ai-')
  AND (r.value < ai.min_replicas * (1 - 0.2) OR r.value > ai.max_replicas * (1 + 0.2))
GROUP BY r.namespace, r.deployment, date_trunc('hour', r.ts)
HAVING date_trunc('hour', r.ts) + INTERVAL 1 HOUR <= (SELECT upto FROM closed)""")
