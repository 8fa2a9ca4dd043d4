"""DuckDB SQL that states each registered query independently, on tables derived from `events`.

The statements follow the plain definition: facts are paired with sessions and buckets by range conditions. None of
the block, hour or whole-day shortcuts of the Spark jobs appear here.
"""

from __future__ import annotations

import re

FIRST_DAY, LAST_DAY = "2024-01-01", "2024-02-01"
AS_OF = "2024-02-01 18:00:00"
NOW, HOURS = "2024-02-01 18:30:00", 768
START, END = "2024-01-01 00:00:00", "2024-02-01 23:59:59.999"
GROUP = "G1"
NEW_VALUE = "77.5"


def _t(text: str) -> str:
    return f"TIMESTAMP '{text}'"


def _at(seconds: str) -> str:
    return f"ts + to_seconds({seconds})"


def _ceil(us: str, unit: int = 60_000_000) -> str:
    return f"CAST(ceil(({us}) / {unit}.0) AS BIGINT)"


def _round(us: str) -> str:
    return f"CAST(round(({us}) / 60000000.0) AS BIGINT)"


def _us(start: str, end: str) -> str:
    return f"(epoch_us({end}) - epoch_us({start}))"


def _whole(x: str) -> str:
    return f"CAST(round({x}) AS BIGINT)"


def _time(x: str, name: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def _num(x: str, name: str) -> str:
    return f"CAST({x} AS DOUBLE) AS {name}"


def _int(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


DIST = "(((n * 7 + i * 13) % 600) + CASE WHEN (n + i) % 2 = 0 THEN 0.5 ELSE 0 END)"
LADEN = "CASE WHEN (n + i) % 2 = 0 THEN 'L' ELSE 'U' END"
DAY_NAME = "strftime(day, '%Y-%m-%d') AS day"

# Named relations. Later ones may use earlier ones; `_sql` adds what a query needs.
PARTS = {
    "b": """
        SELECT CASE WHEN user_id % 2 = 0 THEN 'T1' ELSE 'T2' END AS tml_id,
               ['YT', 'YC', 'QC'][CAST((user_id // 2) % 3 AS INTEGER) + 1] AS eq_type,
               'E' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS eq_no,
               event_id, user_id, ts, value, CAST(floor(value * 60) AS BIGINT) AS secs
        FROM events""",
    "eq": """
        SELECT DISTINCT tml_id, eq_type, eq_no,
               CASE user_id % 10 WHEN 4 THEN 'Y' WHEN 2 THEN NULL ELSE 'N' END AS remove_flag
        FROM b""",
    "ign": f"""
        SELECT tml_id, eq_type, eq_no, ts AS on_t, CASE WHEN event_id % 23 <> 0 THEN {_at("secs")} END AS off_t FROM b""",
    "login": f"""
        SELECT tml_id, eq_type, eq_no, {_at("secs // 20")} AS on_t,
               CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 3 = 0 THEN {_at("secs * 4 // 10")}
                    ELSE {_at("secs * 9 // 10")} END AS off_t
        FROM b WHERE event_id % 5 <> 0
        UNION ALL
        SELECT tml_id, eq_type, eq_no, {_at("secs * 5 // 10")}, {_at("secs * 9 // 10")}
        FROM b WHERE event_id % 5 <> 0 AND event_id % 3 = 0""",
    "brk": f"""
        SELECT tml_id, eq_type, eq_no, {_at("secs * 2 // 10")} AS on_t,
               CASE WHEN event_id % 17 <> 0 THEN {_at("secs * 5 // 10")} END AS off_t
        FROM b WHERE event_id % 4 = 1""",
    "travel": f"""
        SELECT tml_id, eq_type, eq_no, ts AS stime, {_at("secs // 4")} AS etime,
               CAST(round(value * 10, 1) AS DECIMAL(20, 6)) AS dist,
               CASE WHEN event_id % 19 <> 0 THEN CAST(round(value, 2) AS DECIMAL(20, 6)) END AS fuel
        FROM b WHERE event_id % 4 <> 3""",
    "tran": f"""
        SELECT tml_id, eq_type, eq_no, event_id AS n, {_at("secs")} AS cmpl,
               CAST(round(value * 8, 1) AS DECIMAL(20, 6)) AS dist, CAST(round(value, 2) AS DECIMAL(20, 6)) AS fuel
        FROM b WHERE event_id % 3 <> 2""",
    "tran_step": f"""
        SELECT tml_id, eq_type, eq_no, cmpl, CAST({DIST} AS DECIMAL(20, 6)) AS dist, {LADEN} AS laden
        FROM tran, unnest(range(1, n % 4 + 1)) AS u(i) WHERE n % 8 <> 0""",
    "job": f"""
        SELECT tml_id, eq_type, eq_no, n, event_id, CASE WHEN n % 7 <> 0 THEN 'J' || n END AS job_id,
               CASE n % 5 WHEN 0 THEN 'LD' WHEN 1 THEN 'DS' WHEN 2 THEN 'MI' WHEN 3 THEN 'MO' END AS job_type,
               {_at("secs * (3 * k - 2) // 10")} AS fetched, {_at("secs * 3 * k // 10")} AS cmpl,
               CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN NULL WHEN n % 3 = 0 THEN '20' ELSE '40' END AS cntr_len,
               'C' || n % 997 AS cntr_no, 'Q' || n % 9 AS from_eq_no, 'R' || n % 9 AS to_eq_no,
               'U' || n % 40 AS user_id, 'F' || n % 12 AS from_loc, 'G' || n % 12 AS to_loc,
               'X' || event_id AS eq_tran_id, CAST(round(value / 3, 2) AS DECIMAL(20, 6)) AS fuel
        FROM (SELECT b.*, k, event_id * 3 + k AS n FROM b, unnest([1, 2, 3]) AS u(k))""",
    "step": f"""
        SELECT job.*, (n * 7 + i * 13) % 600 AS sec,
               CASE (n + i) % 3 WHEN 0 THEN 'Waiting' WHEN 1 THEN 'Working' END AS activity,
               CAST({DIST} AS DECIMAL(20, 6)) AS dist, {LADEN} AS laden
        FROM job, unnest(range(1, n % 4 + 1)) AS u(i) WHERE n % 8 <> 0""",
    "leg": f"""
        SELECT job.*, i, 'S' || i AS from_step, 'S' || i + 1 AS to_step,
               {_whole(f"CAST({DIST} AS DECIMAL(20, 6))")} AS eta_d,
               {_whole(f"CAST({DIST} + (n + i) % 5 AS DECIMAL(20, 6))")} AS ata_d,
               (n * 3 + i) % 400 AS eta_s, (n * 5 + i) % 400 AS ata_s
        FROM job, unnest(range(1, n % 3 + 1)) AS u(i) WHERE n % 5 <> 0""",
    "cfg": """
        SELECT tml_id, gp, eq_type, name AS value_type, seq,
               printf('%.1f', CAST(base + extra + CASE gp WHEN 'G2' THEN 1 ELSE 0 END AS DOUBLE)) AS value
        FROM (SELECT tml_id, eq_type, count(*) % 10 AS extra FROM b GROUP BY ALL),
             (VALUES ('G1'), ('G2')) AS g(gp),
             (VALUES ('SCH_DOWN', 60.0, 1), ('USCH_DOWN', 45.5, 2), ('TML_CLOSE', 120.0, 3),
                     ('OFFLINE_OPR_DELAY', 30.0, 4), ('TOS_FAILURE_ONLINE', 15.0, 5), ('ONLINE_DOWN', 10.0, 6),
                     ('OTHER_IDLE', 5.0, 7)) AS s(name, base, seq)
        WHERE NOT (eq_type = 'QC' AND name = 'OTHER_IDLE')""",
    "conf": """
        SELECT tml_id, eq_type,
               coalesce(max(CAST(value AS DOUBLE)) FILTER (value_type = 'SCH_DOWN'), 0) AS sch,
               coalesce(max(CAST(value AS DOUBLE)) FILTER (value_type = 'USCH_DOWN'), 0) AS unsch,
               coalesce(max(CAST(value AS DOUBLE)) FILTER (value_type = 'TML_CLOSE'), 0) AS close,
               coalesce(max(CAST(value AS DOUBLE)) FILTER (value_type = 'OFFLINE_OPR_DELAY'), 0) AS offline,
               coalesce(max(CAST(value AS DOUBLE)) FILTER (value_type = 'TOS_FAILURE_ONLINE'), 0) AS failure,
               coalesce(max(CAST(value AS DOUBLE)) FILTER (value_type = 'ONLINE_DOWN'), 0) AS online,
               coalesce(max(CAST(value AS DOUBLE)) FILTER (value_type = 'OTHER_IDLE'), 0) AS other
        FROM cfg GROUP BY ALL""",
    "keys": "SELECT DISTINCT tml_id, eq_type FROM eq",
    "days": f"""
        SELECT CAST(d AS DATE) AS day, CAST(d AS TIMESTAMP) AS s, d + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS e
        FROM generate_series({_t(FIRST_DAY)}, {_t(LAST_DAY)}, INTERVAL 1 DAY) AS g(d)""",
    "spine": f"""
        SELECT tml_id, eq_type, h AS s_time, strftime(h, '%Y%m%d%H') AS hour_step,
               CASE WHEN h = date_trunc('hour', {_t(NOW)}) THEN {_t(NOW)}
                    ELSE h + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND END AS e_time
        FROM keys, generate_series(date_trunc('hour', {_t(NOW)}) - INTERVAL {HOURS - 1} HOUR, {_t(NOW)}, INTERVAL 1 HOUR) AS g(h)""",
    # jobs with the day they complete in
    "day_job": "SELECT job.*, day, s, greatest(fetched, s) AS day_fetch FROM job JOIN days ON cmpl BETWEEN s AND e",
    "envelope": """
        SELECT tml_id, eq_type, eq_no, day, greatest(min(fetched), s) AS js, max(cmpl) AS je
        FROM day_job GROUP BY tml_id, eq_type, eq_no, day, s""",
}


def _strict(name: str) -> str:
    return f"""
        SELECT tml_id, eq_type, eq_no, day, greatest(on_t, s) AS on_t, least(coalesce(off_t, {_t(AS_OF)}), e) AS off_t
        FROM {name}, days
        WHERE (off_t IS NULL AND on_t < e) OR (on_t >= s AND off_t <= e) OR (off_t > s AND on_t < s) OR (on_t < e AND off_t > e)"""


def _loose(name: str, open_end: str) -> str:
    return f"""
        SELECT tml_id, eq_type, eq_no, day, greatest(on_t, s) AS on_t, least(coalesce(off_t, {open_end}), e) AS off_t
        FROM {name}, days WHERE on_t <= e AND coalesce(off_t, {_t(AS_OF)}) >= s"""


PARTS |= {
    "ign_strict": _strict("ign"),
    "login_strict": _strict("login"),
    "ign_day": _loose("ign", "e"),
    "login_day": _loose("login", "e"),
    "brk_day": _loose("brk", _t(AS_OF)),
}


def _worked(name: str, fetched: str) -> str:
    return f"""
        SELECT x.tml_id, x.eq_type, x.eq_no, x.day, on_t, off_t, min({fetched}) AS js, max(cmpl) AS je
        FROM {name} x LEFT JOIN day_job j
          ON x.tml_id = j.tml_id AND x.eq_type = j.eq_type AND x.eq_no = j.eq_no AND x.day = j.day AND cmpl BETWEEN on_t AND off_t
        GROUP BY ALL"""


def _hour_rows(name: str) -> str:
    first = "first_on + to_hours(seq - 1)"
    return f"""
        SELECT tml_id, eq_type, eq_no, day, seq,
               CASE WHEN seq = 1 THEN first_on ELSE date_trunc('hour', {first}) END AS st,
               CASE WHEN seq = gap THEN last_off ELSE date_trunc('hour', first_on + to_hours(seq)) - INTERVAL 1 MILLISECOND END AS et
        FROM (SELECT *, {_ceil("abs(" + _us("first_on", "last_off") + ")", 3_600_000_000)} AS gap
              FROM (SELECT tml_id, eq_type, eq_no, day, min(on_t) AS first_on, max(off_t) AS last_off FROM {name} GROUP BY ALL)),
             LATERAL unnest(range(1, gap + 1)) AS u(seq)"""


PARTS |= {
    "ign_worked": _worked("ign_day", "day_fetch"),
    "ign_worked_raw": _worked("ign_day", "fetched"),
    "login_worked": _worked("login_day", "day_fetch"),
    "ign_hour": _hour_rows("ign_day"),
    "login_hour": _hour_rows("login_day"),
}


def _sql(body: str) -> str:
    """Prefix a query with the named relations it uses, directly or through others."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop()))
        for name in PARTS:
            if name in words and name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b", " ".join([body, *(PARTS[n] for n in needed)])):
                needed.add(name)
                todo.append(PARTS[name])
    ctes = ", ".join(f"{name} AS ({text})" for name, text in PARTS.items() if name in needed)
    return f"WITH {ctes} {body}"


H = f"sp.tml_id, sp.eq_type, {_time('s_time', 's_time')}, {_time('e_time', 'e_time')}, hour_step"
KEY_JOIN = "sp.tml_id = f.tml_id AND sp.eq_type = f.eq_type"
BUCKET = f"{KEY_JOIN} AND cmpl BETWEEN s_time AND e_time"
BY_HOUR = "GROUP BY sp.tml_id, sp.eq_type, sp.s_time, sp.e_time, sp.hour_step"
RANGE = f"cmpl BETWEEN {_t(START)} AND {_t(END)}"
WINDOW = f"cmpl BETWEEN {_t(NOW)} - INTERVAL {HOURS} HOUR AND {_t(NOW)}"
UNIT = "tml_id, eq_type, eq_no"


def _json_list(label: str, column: str, source: str, by: str) -> str:
    item = f"""'{{"{label}":' || coalesce('"' || {column} || '"', 'null') || ',"jobQty":' || q || '}}'"""
    return f"""SELECT {by}, '[' || string_agg({item}, ',' ORDER BY {column} NULLS FIRST) || ']' AS txt
               FROM (SELECT {by}, {column}, count(*) AS q FROM {source} GROUP BY ALL) GROUP BY ALL"""


def _rn(order: str, name: str, by: str = UNIT) -> str:
    columns = ", ".join(f"{c.strip()} NULLS FIRST" for c in order.split(","))
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {columns}) AS {name}"


def _reports_execution() -> dict[str, str]:
    legs = "sum(eta_d), sum(ata_d), sum(eta_s), sum(ata_s)".split(", ")
    names = ["eta_distance", "ata_distance", "eta_time_sec", "ata_time_sec"]
    leg_sums = ", ".join(_int(s, n) for s, n in zip(legs, names))
    leg_list = f"""from_step, to_step, user_id, {_int("eta_d", "eta_distance")}, {_int("ata_d", "ata_distance")},
        {_int("eta_s", "eta_time_sec")}, {_int("ata_s", "ata_time_sec")}, {_int("ata_s - eta_s", "trv_efc_time")},
        {_int("ata_d - eta_d", "trv_efc_distance")}"""
    leg_order = "eq_no, cmpl, cntr_no, user_id, i"
    working = "CASE WHEN coalesce(activity, 'Working') = 'Working' THEN sec ELSE 0 END"
    waiting = "CASE WHEN activity = 'Waiting' THEN sec ELSE 0 END"
    d = _whole("dist")
    laden = [f"CASE WHEN laden = '{x}' THEN {{}} ELSE 0 END" for x in "LU"]
    cmpl = _time("cmpl", "job_cmpl_time")
    return {
        "travel_eff_hourly": f"SELECT {H}, {leg_sums} FROM spine sp LEFT JOIN leg f ON {BUCKET} {BY_HOUR}",
        "travel_eff_by_job": f"SELECT {UNIT}, job_id, cntr_no, {leg_sums} FROM leg WHERE {RANGE} GROUP BY {UNIT}, job_id, cntr_no",
        "travel_eff_legs": f"""SELECT tml_id, eq_type, job_id, {_rn(leg_order, "r_seq", "tml_id, eq_type, job_id, cntr_no")}, cntr_no, eq_no, {leg_list}
            FROM leg WHERE job_id IS NOT NULL""",
        "cycle_time_legs": f"""SELECT tml_id, eq_type, job_id, {_rn(leg_order, "r_seq", "tml_id, eq_type, job_id")}, cntr_no, eq_no, {leg_list}
            FROM leg WHERE job_id IS NOT NULL""",
        "travel_with_job_hourly": f"""SELECT {H}, {_whole("f.d")} AS trv_dist, {_whole("j.d")} AS trv_job_dist
            FROM spine sp
            LEFT JOIN (SELECT tml_id, eq_type, strftime(etime, '%Y%m%d%H') AS hk, sum(dist) AS d FROM travel
                       WHERE stime >= {_t(NOW)} - INTERVAL {HOURS} HOUR AND etime <= {_t(NOW)} GROUP BY ALL) f ON {KEY_JOIN} AND hk = hour_step
            LEFT JOIN (SELECT tml_id, eq_type, strftime(cmpl, '%Y%m%d%H') AS hk, sum(dist) AS d FROM tran WHERE {WINDOW} GROUP BY ALL) j
                   ON sp.tml_id = j.tml_id AND sp.eq_type = j.eq_type AND j.hk = hour_step""",
        "travel_with_job_by_unit": f"""SELECT t.tml_id, t.eq_type, t.eq_no, t.d AS total_dist, {_num("j.d", "job_dist")}, {_num("t.d - coalesce(j.d, 0)", "no_job_dist")}
            FROM (SELECT {UNIT}, {_whole("sum(dist)")} AS d FROM travel WHERE stime >= {_t(START)} AND etime <= {_t(END)} GROUP BY ALL) t
            LEFT JOIN (SELECT {UNIT}, sum(dist) AS d FROM tran WHERE {RANGE} GROUP BY ALL) j USING ({UNIT})""",
        "travel_with_job_rows": f"""SELECT tml_id, eq_type, {_rn("cmpl, cntr_no, job_type, from_loc, to_loc, user_id, eq_tran_id", "r_seq")},
                {cmpl}, cntr_no, eq_no, job_type, from_loc, to_loc, {_int("dist", "dist")}, user_id, eq_tran_id
            FROM (SELECT {UNIT}, cmpl, cntr_no, job_type, from_loc, to_loc, user_id, eq_tran_id, sum({d}) AS dist FROM step WHERE {RANGE} GROUP BY ALL)""",
        "cycle_time_hourly": f"""SELECT {H}, {_int(f"CASE WHEN count(f.n) > 0 THEN sum({working}) END", "working_time_sec")}, {_int(f"sum({waiting})", "waiting_time_sec")}
            FROM spine sp LEFT JOIN (SELECT * FROM step WHERE job_id IS NOT NULL) f ON {BUCKET} {BY_HOUR}""",
        "cycle_time_by_job": f"""SELECT tml_id, eq_type, job_id, cntr_no, {cmpl}, {_int(f"sum({working})", "working_time")}, {_int(f"sum({waiting})", "waiting_time")}, {_int("sum(sec)", "total_time")}
            FROM step WHERE {RANGE} AND job_id IS NOT NULL GROUP BY tml_id, eq_type, job_id, cntr_no, cmpl""",
        "laden_hourly": f"""SELECT {H}, {_num(f"sum({laden[0].format('dist')})", "laden_dist")}, {_num(f"sum({laden[1].format('dist')})", "unladen_dist")}
            FROM spine sp LEFT JOIN tran_step f ON {BUCKET} {BY_HOUR}""",
        "laden_by_unit": f"""SELECT {UNIT}, {_int(f"sum({laden[0].format(d)})", "laden_dist")}, {_int(f"sum({laden[1].format(d)})", "unladen_dist")}, {_int(f"sum({d})", "total_dist")}
            FROM tran_step WHERE {RANGE} GROUP BY {UNIT}""",
        "laden_rows": f"""SELECT tml_id, eq_type, {_rn("cmpl, cntr_no, job_type, user_id", "r_seq")}, {cmpl}, cntr_no, eq_no, job_type,
                {_int("l", "laden_dist")}, {_int("u", "unladen_dist")}, {_int("t", "total_dist")}, user_id
            FROM (SELECT {UNIT}, cmpl, cntr_no, job_type, user_id, sum({laden[0].format(d)}) AS l, sum({laden[1].format(d)}) AS u, sum({d}) AS t
                  FROM step WHERE {RANGE} GROUP BY ALL)""",
        "fuel_hourly": f"""SELECT {H}, {_num("sum(coalesce(fuel, 0))", "fuel")} FROM spine sp
            LEFT JOIN travel f ON {KEY_JOIN} AND stime >= s_time AND etime <= e_time {BY_HOUR}""",
        "fuel_by_unit": f"""SELECT t.tml_id, t.eq_type, t.eq_no, {_num("t.f", "fuel_cons")}, {_num("j.f", "job_fuel")}
            FROM (SELECT {UNIT}, sum(coalesce(fuel, 0)) AS f FROM travel WHERE stime >= {_t(START)} AND etime <= {_t(END)} GROUP BY ALL) t
            LEFT JOIN (SELECT {UNIT}, sum(fuel) AS f FROM tran WHERE {RANGE} GROUP BY ALL) j USING ({UNIT})""",
        "fuel_rows": f"""SELECT tml_id, eq_type, {_rn("cntr_no, job_type, fuel, user_id", "r_seq")}, eq_no, cntr_no, job_type, {_int("d", "trv_dist")}, {_num("fuel", "fuel")}, user_id
            FROM (SELECT {UNIT}, cntr_no, job_type, fuel, user_id, sum({d}) AS d FROM step WHERE {RANGE} GROUP BY ALL)""",
        "execution_hourly": f"""SELECT {H}, count(f.n) FILTER (job_id IS NOT NULL) AS with_job_count,
                count(f.n) FILTER (job_id IS NULL) AS without_job_count, count(f.n) AS total_count
            FROM spine sp LEFT JOIN job f ON {BUCKET} {BY_HOUR}""",
        "execution_by_unit": f"""SELECT {UNIT}, count(job_id) AS with_job_count, count(*) - count(job_id) AS without_job_count, count(*) AS total_count
            FROM job WHERE {RANGE} GROUP BY {UNIT}""",
        "execution_rows": f"""SELECT tml_id, eq_type, {_rn("cmpl, cntr_no, job_type, from_loc, to_loc, user_id", "r_seq")}, {cmpl}, cntr_no, eq_no, job_type, from_loc, to_loc, {_int("d", "dist")}, user_id
            FROM (SELECT {UNIT}, cmpl, cntr_no, job_type, from_loc, to_loc, user_id, sum({d}) AS d FROM step WHERE {RANGE} GROUP BY ALL)""",
    }


def _reports_productivity() -> dict[str, str]:
    hourly = f"(SELECT *, strftime(cmpl, '%Y%m%d%H') AS hk FROM job WHERE {WINDOW})"
    ranged = f"(SELECT * FROM job WHERE {RANGE})"
    by_hour = "tml_id, eq_type, hk"
    match = "ON sp.tml_id = {0}.tml_id AND sp.eq_type = {0}.eq_type AND hour_step = {0}.hk"
    return {
        "productivity_hourly": f"""SELECT sp.tml_id, sp.eq_type, {_time("s_time", "s_date")}, {_time("e_time", "e_date")}, hour_step,
                q.job_qty, t.txt AS job_type_qty_str, l.txt AS cntr_len_qty_str
            FROM spine sp
            LEFT JOIN (SELECT {by_hour}, count(*) AS job_qty FROM {hourly} GROUP BY ALL) q {match.format("q")}
            LEFT JOIN ({_json_list("jobType", "job_type", hourly, by_hour)}) t {match.format("t")}
            LEFT JOIN ({_json_list("cntrLen", "cntr_len", hourly, by_hour)}) l {match.format("l")}""",
        "productivity_by_unit": f"""SELECT {UNIT}, job_qty, t.txt AS job_type_qty_str, l.txt AS cntr_len_qty_str
            FROM (SELECT {UNIT}, count(*) AS job_qty FROM {ranged} GROUP BY ALL)
            LEFT JOIN ({_json_list("jobType", "job_type", ranged, UNIT)}) t USING ({UNIT})
            LEFT JOIN ({_json_list("cntrLen", "cntr_len", ranged, UNIT)}) l USING ({UNIT})""",
        "productivity_jobs": f"""SELECT tml_id, eq_type, {_rn("cmpl, cntr_no, job_type, from_eq_no, to_eq_no, user_id, cntr_len", "seq")},
                {_time("cmpl", "job_cmpl_time")}, cntr_len, eq_no, cntr_no, job_type, from_eq_no, to_eq_no, user_id
            FROM job WHERE {RANGE}""",
    }


def _reached(minutes: str) -> str:
    return f"""CASE WHEN st >= date_trunc('hour', js) AND et < je THEN {_ceil("abs(" + _us("js", "et") + ")")}
             WHEN st >= date_trunc('hour', js) AND je BETWEEN st AND et THEN {_ceil("abs(" + _us("js", "je") + ")")} END AS {minutes}"""


def _in_hour(minutes: str) -> str:
    return f"""CASE WHEN js <= et AND je >= st AND js <= je THEN {_ceil(_us("greatest(js, st)", "least(je, et)"))} END AS {minutes}"""


def _work_columns(start: str, end: str, minutes: str) -> str:
    return f"""{_time("CASE WHEN js BETWEEN st AND et THEN js END", start)}, {_time("CASE WHEN je BETWEEN st AND et THEN je END", end)},
        {_reached(minutes)}"""


def _reports_utilization() -> dict[str, str]:
    unit_day = f"{UNIT}, {DAY_NAME}"
    kept = "(SELECT * FROM eq WHERE coalesce(remove_flag, 'N') <> 'Y')"
    same_unit = "x.tml_id = y.tml_id AND x.eq_type = y.eq_type AND x.eq_no = y.eq_no AND x.day = y.day"
    session_us, work_us = f"abs({_us('on_t', 'off_t')})", f"abs({_us('js', 'je')})"

    def summary(worked: str, name: str) -> str:
        return f"""SELECT k.tml_id, k.eq_type, strftime(k.day, '%Y-%m-%d') AS day, {_int("a", name)}, {_int("w", "job_performed_time_min")}
            FROM (SELECT * FROM keys, days) k
            LEFT JOIN (SELECT tml_id, eq_type, day, sum({_ceil(session_us)}) AS a, sum({_ceil(work_us)}) AS w FROM {worked} GROUP BY ALL) v
                   ON k.tml_id = v.tml_id AND k.eq_type = v.eq_type AND k.day = v.day"""

    def listing(worked: str, on: str, off: str, length: str, minutes) -> str:
        return f"""SELECT {unit_day}, {_time("on_t", on)}, {_time("off_t", off)}, {minutes(session_us)} AS {length},
            {_time("js", "job_start_time")}, {_time("je", "job_end_time")}, {minutes(work_us)} AS job_performed_time_min FROM {worked}"""

    def hours(rows: str, worked: str, prefix: str) -> str:
        return f"""SELECT x.tml_id, x.eq_type, strftime(x.day, '%Y-%m-%d') AS day, {_int("seq", "hour_seq")}, x.eq_no,
                {_time("st", prefix + "_start_time")}, {_time("et", prefix + "_end_time")}, {_work_columns("job_start_time", "job_end_time", "job_performed_time_min")}
            FROM {rows} x LEFT JOIN {worked} y ON {same_unit} AND date_trunc('hour', on_t) <= st AND date_trunc('hour', off_t) >= st"""

    inside = f"{same_unit} AND x.on_t <= y.on_t AND x.off_t >= y.off_t"
    return {
        "avail_summary": f"""SELECT k.tml_id, k.eq_type, strftime(k.day, '%Y-%m-%d') AS day, count(u.eq_no) * 24 AS available_hour,
                {_ceil("sum(" + _us("js", "je") + ")", 3_600_000_000)} AS job_performed_hour
            FROM (SELECT * FROM keys, days) k LEFT JOIN {kept} u ON k.tml_id = u.tml_id AND k.eq_type = u.eq_type
            LEFT JOIN envelope v ON u.tml_id = v.tml_id AND u.eq_type = v.eq_type AND u.eq_no = v.eq_no AND k.day = v.day
            GROUP BY k.tml_id, k.eq_type, k.day""",
        "avail_by_unit": f"""SELECT u.tml_id, u.eq_type, u.eq_no, strftime(d.day, '%Y-%m-%d') AS day, {_time("s", "avail_start_time")}, {_time("e", "avail_end_time")},
                {_int("1440", "avail_min")}, {_time("js", "job_start_time")}, {_time("je", "job_end_time")}, {_ceil(_us("js", "je"))} AS job_performed_min
            FROM {kept} u CROSS JOIN days d
            LEFT JOIN envelope v ON u.tml_id = v.tml_id AND u.eq_type = v.eq_type AND u.eq_no = v.eq_no AND d.day = v.day""",
        "avail_hours": f"""SELECT x.tml_id, x.eq_type, strftime(x.day, '%Y-%m-%d') AS day, hour_step, x.eq_no, {_time("st", "start_time")}, {_time("et", "end_time")},
                {_work_columns("job_start_time", "job_end_time", "job_performed_time_min")}
            FROM (SELECT u.*, day, {_int("h", "hour_step")}, s + to_hours(h - 1) AS st, s + to_hours(h) - INTERVAL 1 MILLISECOND AS et
                  FROM {kept} u, days, range(1, 25) AS g(h)) x
            LEFT JOIN envelope y ON {same_unit}""",
        "ignition_summary": summary("ign_worked_raw", "ign_time_min"),
        "ignition_by_session": listing("ign_worked", "ign_start_time", "ign_end_time", "ign_time_min", _ceil),
        "ignition_hours": hours("ign_hour", "ign_worked", "ign"),
        "login_summary": summary("login_worked", "log_time_min"),
        "login_by_session": listing("login_worked", "log_in_time", "log_out_time", "log_time_min", _round),
        "login_hours": hours("login_hour", "login_worked", "log"),
        "break_summary": f"""SELECT k.tml_id, k.eq_type, strftime(k.day, '%Y-%m-%d') AS day, {_int("a", "ign_time_min")}, {_int("w", "brk_end_time_min")}
            FROM (SELECT * FROM keys, days) k
            LEFT JOIN (SELECT tml_id, eq_type, day, sum({_round(session_us)}) AS a, sum({_round(f"abs({_us('bs', 'be')})")}) AS w
                       FROM (SELECT x.tml_id, x.eq_type, x.eq_no, x.day, x.on_t, x.off_t, min(y.on_t) AS bs, max(y.off_t) AS be
                             FROM ign_day x LEFT JOIN brk_day y ON {inside} GROUP BY ALL) GROUP BY ALL) v
                   ON k.tml_id = v.tml_id AND k.eq_type = v.eq_type AND k.day = v.day""",
        "break_by_session": f"""SELECT x.tml_id, x.eq_type, x.eq_no, strftime(x.day, '%Y-%m-%d') AS day, {_time("x.on_t", "ign_on_time")}, {_time("x.off_t", "ign_off_time")},
                {_time("y.on_t", "brk_start_time")}, {_time("y.off_t", "brk_end_time")}, {_ceil("abs(" + _us("y.on_t", "y.off_t") + ")")} AS brk_time_min
            FROM ign_day x LEFT JOIN brk_day y ON {inside}""",
        "break_hours": f"""SELECT x.tml_id, x.eq_type, strftime(x.day, '%Y-%m-%d') AS day, {_int("seq", "hour_seq")}, x.eq_no,
                {_time("st", "ign_start_time")}, {_time("et", "ign_end_time")}, {_work_columns("brk_start_time", "brk_end_time", "brk_time_min")}
            FROM ign_hour x LEFT JOIN (SELECT {UNIT}, day, on_t AS js, off_t AS je FROM brk_day) y
              ON {same_unit} AND date_trunc('hour', js) <= date_trunc('hour', st) AND date_trunc('hour', je) >= date_trunc('hour', st)""",
    }


def _oee_sessions(split: bool) -> str:
    if split:
        sec = "CASE WHEN job_id IS NOT NULL THEN sec ELSE 0 END"
        wait = "CASE WHEN job_id IS NOT NULL AND activity = 'Waiting' THEN sec ELSE 0 END"
    else:
        sec, wait = "sec", "CASE WHEN activity = 'Waiting' THEN sec ELSE 0 END"
    idle = "greatest(" + _ceil(_us("on_t", "in_t")) + ", 0)"
    fetched = "greatest(" + _ceil(_us("in_t", "ff")) + ", 0)"
    return f"""SELECT tml_id, eq_type, day, count(DISTINCT eq_no) * 1440 AS cal, sum(jm) AS job, sum(wm) AS wait, sum(nm) AS no_job,
            sum({_ceil(_us("on_t", "off_t"))}) AS util, sum({idle}) AS log_idle, sum({_ceil(_us("in_t", "out_t"))}) AS log, sum({fetched}) AS fetch_idle
        FROM (SELECT g.tml_id, g.eq_type, g.eq_no, g.day, g.on_t, g.off_t, l.on_t AS in_t, l.off_t AS out_t, min(fetched) AS ff,
                     ceil(sum(js) / 60.0) AS jm, ceil(sum(jw) / 60.0) AS wm, ceil(sum(jn) / 60.0) AS nm
              FROM ign_strict g
              LEFT JOIN login_strict l ON g.tml_id = l.tml_id AND g.eq_type = l.eq_type AND g.eq_no = l.eq_no AND g.day = l.day
                   AND g.on_t <= l.on_t AND g.off_t >= l.off_t
              LEFT JOIN (SELECT {UNIT}, day, job_id, fetched, cmpl, sum({sec}) AS js, sum({wait}) AS jw,
                                sum(CASE WHEN job_id IS NULL THEN sec ELSE 0 END) AS jn
                         FROM step JOIN days ON cmpl BETWEEN s AND e GROUP BY ALL) j
                   ON l.tml_id = j.tml_id AND l.eq_type = j.eq_type AND l.eq_no = j.eq_no AND l.day = j.day AND j.cmpl BETWEEN l.on_t AND l.off_t
              GROUP BY g.tml_id, g.eq_type, g.eq_no, g.day, g.on_t, g.off_t, l.on_t, l.off_t)
        GROUP BY ALL"""


def _reports_oee() -> dict[str, str]:
    def report(split: bool) -> str:
        values = {
            "tml_close_min": "close", "top_min": "cal - close", "no_demand_min": "cal - close - (util + unsch) - sch",
            "sch_down_time_min": "sch", "at_min": "util + unsch", "unsch_down_time_min": "unsch", "offline_opr_delay_min": "offline",
            "tos_failure_online_min": "failure", "online_down_time_min": "online", "idle_time_min": "util - job - failure",
            "other_idle_time_min": "other",
        }
        whole = {
            "calendar_time_min": "cal", "util_time_min": "util", "online_opr_delay_min": "util - job", "log_in_idle_time_min": "log_idle",
            "job_fetching_idle_time_min": "fetch_idle", "drv_shift_idle_time_min": "cal - log", "toc_min": "job",
            "non_value_opr_time_min": "wait", "vot_min": "job - wait + no_job" if split else "job - wait",
        }
        if split:
            whole |= {"execution_with_job_min": "job - wait", "rehandle_without_job_min": "no_job"}
        columns = [_num(x, n) for n, x in values.items()] + [_int(x, n) for n, x in whole.items()]
        return f"SELECT tml_id, eq_type, {DAY_NAME}, {', '.join(columns)} FROM ({_oee_sessions(split)}) JOIN conf USING (tml_id, eq_type)"

    minutes = "CAST(round(sum({}) / 60.0) AS BIGINT)"
    tree = {
        "top_min": "cal - close", "tml_close_min": "close", "at_min": "ign + unsch + offline", "sch_down_time_min": "sch",
        "no_demand_min": "cal - close - ign - unsch - offline - sch", "offline_opr_delay_min": "offline", "unsch_down_time_min": "unsch",
        "idle_time_min": "ign - job - no_job - failure", "tos_failure_online_min": "failure",
    }
    tree_whole = {
        "calendar_time_min": "cal", "util_time_min": "ign", "toc_min": "job + no_job", "online_opr_delay_min": "ign - job - no_job",
        "vot_min": "job - wait", "non_value_opr_time_min": "wait",
    }
    columns = [_num(x, n) for n, x in tree.items()] + [_int(x, n) for n, x in tree_whole.items()]
    return {
        "oee_vehicle": report(False),
        "oee_crane": report(True),
        "oee_tree": f"""SELECT tml_id, eq_type, {DAY_NAME}, {', '.join(columns)}
            FROM (SELECT tml_id, eq_type, day, cal FROM (SELECT tml_id, eq_type, count(*) * 1440 AS cal FROM eq GROUP BY ALL), days)
            LEFT JOIN (SELECT g.tml_id, g.eq_type, g.day, {_round("sum(" + _us("on_t", "off_t") + ")")} AS ign FROM ign_strict g JOIN eq USING ({UNIT}) GROUP BY ALL)
                 USING (tml_id, eq_type, day)
            LEFT JOIN (SELECT tml_id, eq_type, day, {minutes.format("CASE WHEN job_id IS NOT NULL THEN sec ELSE 0 END")} AS job,
                              {minutes.format("CASE WHEN job_id IS NOT NULL AND activity = 'Waiting' THEN sec ELSE 0 END")} AS wait,
                              {minutes.format("CASE WHEN job_id IS NULL THEN sec ELSE 0 END")} AS no_job
                       FROM step JOIN days ON cmpl BETWEEN s AND e GROUP BY ALL) USING (tml_id, eq_type, day)
            JOIN conf USING (tml_id, eq_type)""",
    }


def _config() -> dict[str, str]:
    columns = """tml_id AS bi_ov_tml_id, gp AS bi_ov_tml_gp, eq_type AS bi_ov_eq_type, value_type AS bi_ov_value_type,
        {} AS bi_ov_value, CAST(seq AS BIGINT) AS bi_ov_value_seq"""
    changed = f"CASE WHEN gp = '{GROUP}' AND value_type = 'SCH_DOWN' THEN '{NEW_VALUE}' ELSE value END"
    return {
        "oee_config_list": f"SELECT {columns.format('value')} FROM cfg WHERE gp = '{GROUP}'",
        "oee_config_set": f"SELECT {columns.format(changed)} FROM cfg",
        "pivot_config": """SELECT tml_id, eq_type, sch AS sch_down_time_min, unsch AS unsch_down_time_min, close AS tml_close_min,
            offline AS offline_opr_delay_min, failure AS tos_failure_online_min, online AS online_down_time_min,
            other AS other_idle_time_min FROM conf""",
    }


def _operators() -> dict[str, str]:
    def cut(name: str) -> str:
        return f"""SELECT {UNIT}, {DAY_NAME}, {_time("on_t", "on_time")}, {_time("off_t", "off_time")}, count(*) AS n
            FROM {name} GROUP BY {UNIT}, {name}.day, on_t, off_t"""

    return {
        "hour_spine": f"SELECT {H} FROM spine sp",
        "unit_hours": f"""SELECT {UNIT}, {DAY_NAME}, {_int("h", "hour_step")}, {_time("s + to_hours(h - 1)", "start_time")},
            {_time("s + to_hours(h) - INTERVAL 1 MILLISECOND", "end_time")} FROM eq, days, range(1, 25) AS g(h)""",
        "span_hours": f"""SELECT {UNIT}, {DAY_NAME}, {_int("seq", "hour_seq")}, {_time("st", "start_time")}, {_time("et", "end_time")} FROM ign_hour""",
        "clamp_sessions_strict": cut("ign_strict"),
        "clamp_sessions_loose": cut("ign_day"),
        "clamp_breaks": cut("brk_day"),
        "session_contains_point": f"""SELECT {UNIT}, {DAY_NAME}, {_time("on_t", "on_time")}, {_time("off_t", "off_time")},
            {_time("js", "first_fetch")}, {_time("je", "last_done")} FROM login_worked""",
        "session_contains_session": f"""SELECT DISTINCT x.tml_id, x.eq_type, x.eq_no, strftime(x.day, '%Y-%m-%d') AS day, {_time("x.on_t", "on_time")},
                {_time("x.off_t", "off_time")}, {_time("y.on_t", "in_time")}, {_time("y.off_t", "out_time")}
            FROM ign_strict x LEFT JOIN login_strict y ON x.tml_id = y.tml_id AND x.eq_type = y.eq_type AND x.eq_no = y.eq_no AND x.day = y.day
                 AND x.on_t <= y.on_t AND x.off_t >= y.off_t""",
        "explode_steps": f"""SELECT {UNIT}, job_id, cntr_no, {_num("sec", "interval_sec")}, activity AS activity_type, {_num("dist", "step_dist")},
            laden AS laden_status FROM step""",
        "explode_legs": f"""SELECT {UNIT}, job_id, cntr_no, {_int("i - 1", "leg_no")}, from_step, to_step, {_int("eta_d", "eta_distance")},
            {_int("ata_d", "ata_distance")}, {_int("eta_s", "eta_time_sec")}, {_int("ata_s", "ata_time_sec")} FROM leg""",
        "container_length": "SELECT tml_id, eq_type, cntr_len, count(*) AS job_qty FROM job GROUP BY ALL",
        "counts_as_json": f"""SELECT u.tml_id, u.eq_type, u.eq_no, u.job_id, t.txt AS job_type_qty_str FROM (SELECT DISTINCT {UNIT}, job_id FROM job) u
            JOIN ({_json_list("jobType", "job_type", "job", UNIT + ", job_id")}) t
              ON u.tml_id = t.tml_id AND u.eq_type = t.eq_type AND u.eq_no = t.eq_no AND u.job_id IS NOT DISTINCT FROM t.job_id""",
        "global_seq": f"""SELECT tml_id, eq_type, {_rn("cmpl, eq_no, eq_tran_id, cntr_no", "seq", "tml_id, eq_type")}, eq_no, {_time("cmpl", "job_cmpl_time")}, eq_tran_id, cntr_no FROM job""",
    }


# Reports asked for at a moment inside the data: sessions still open then end before they start on later days.
OPEN_AS_OF = "2024-01-12 09:30:00"
OPEN = (
    "oee_vehicle", "oee_crane", "oee_tree", "ignition_by_session", "login_hours", "break_summary", "break_by_session",
    "session_contains_session",
)
# Hour lists that show the minutes of each hour, and their column.
PER_HOUR = {
    "avail_hours": "job_performed_time_min", "ignition_hours": "job_performed_time_min",
    "login_hours": "job_performed_time_min", "break_hours": "brk_time_min",
}


def oracle_sql() -> dict[str, str]:
    bodies = (
        _reports_oee() | _reports_productivity() | _reports_execution() | _reports_utilization() | _config() | _operators()
    )
    statements = {name: _sql(body) for name, body in bodies.items()}
    for name in OPEN:
        statements[f"{name}_open"] = statements[name].replace(_t(AS_OF), _t(OPEN_AS_OF))
    for name, minutes in PER_HOUR.items():
        statements[f"{name}_per_hour"] = statements[name].replace(_reached(minutes), _in_hour(minutes))
    return statements
