"""Instants of printed stamps, feature cells and logical entries as SQL for a second engine, by other means than the operators'.

Stamps are taken apart by patterns of their own, wall clocks are turned into instants by trying the offsets that the engine's
zone tables have around a reading, and the unit of bare digits follows from their number."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

#: Layouts: pattern and, as a template, year|month|day|hour|minute|second|fraction|zone|half.
FORMS = (
    (r"^(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))? ?([Zz]|[+-]\d\d:?\d\d)?(?:\[[^\]]*\])?$", r"\1|\2|\3|\4|\5|\6|\7|\8|"),
    (r"^(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d) ?([Zz]|[+-]\d\d:?\d\d)?$", r"\1|\2|\3|\4|\5|00||\6|"),
    (r"^[.*]?(?:[A-Z][a-z][a-z],? )?([A-Z][a-z][a-z]) {1,2}(\d{1,2}) (\d{4}) (\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?: ([A-Za-z]{1,5}|[+-]\d\d:?\d\d))?$", r"\3|\1|\2|\4|\5|\6|\7|\8|"),
    (r"^[.*]?(?:[A-Z][a-z][a-z],? )?([A-Z][a-z][a-z]) {1,2}(\d{1,2}) (\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?: ([A-Z]{2,5}))? (\d{4})$", r"\8|\1|\2|\3|\4|\5|\6|\7|"),
    (r"^[.*]?(?:[A-Z][a-z][a-z],? )?([A-Z][a-z][a-z]) {1,2}(\d{1,2}) (\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?: ([A-Za-z]{1,5}|[+-]\d\d:?\d\d))?$", r"|\1|\2|\3|\4|\5|\6|\7|"),
    (r"^(\d{4})/(\d\d)/(\d\d)[ T](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?$", r"\1|\2|\3|\4|\5|\6|\7||"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}),? (\d{1,2}):(\d\d):(\d\d)(?:\.(\d+))?(?: ([AaPp])[Mm])?$", r"\3|\1|\2|\4|\5|\6|\7||\8"),
    (r"^(\d{1,2})-([A-Z][a-z][a-z])-(\d{4}) (\d\d):(\d\d):(\d\d)(?:\.(\d+))?$", r"\3|\2|\1|\4|\5|\6|\7||"),
    (r"^(?:[A-Z][a-z][a-z], )?(\d{1,2}) ([A-Z][a-z][a-z]) (\d{4}) (\d\d):(\d\d):(\d\d) ([+-]\d\d:?\d\d|[A-Z]{1,5})$", r"\3|\2|\1|\4|\5|\6||\7|"),
    (r"^\[?(\d{1,2})/([A-Z][a-z][a-z])/(\d{4}):(\d\d):(\d\d):(\d\d) ([+-]\d\d:?\d\d)\]?$", r"\3|\2|\1|\4|\5|\6||\7|"),
    (r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(?:[.,](\d+))?([Zz]|[+-]\d\d:?\d\d)?$", r"\1|\2|\3|\4|\5|\6|\7|\8|"),
    (r"^(\d{1,2}):(\d\d):(\d\d)(?:\.(\d+))?$", r"|||\1|\2|\3|\4||"),
)
DAY = 86_400_000_000


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def _abbreviations() -> str:
    """Rows (zone, abbreviation, offset in microseconds): what the zone tables of this machine call clocks since 1970."""
    rows = set()
    for name in available_timezones():
        zone, at = ZoneInfo(name), datetime(1970, 1, 1, tzinfo=timezone.utc)
        while at.year < 2038:
            there = at.astimezone(zone)
            if (abbr := there.tzname()) and abbr[0].isalpha():
                rows.add((name, abbr, int(there.utcoffset().total_seconds()) * 1_000_000))
            at += timedelta(days=40)
    return ", ".join(f"({_q(z)}, {_q(a)}, {o})" for z, a, o in sorted(rows))


def _offset(us: str, zone: str = "zone") -> str:
    return f"(epoch_us(timezone({zone}, make_timestamptz({us}))) - ({us}))"


BLANK = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11) || chr(65279)"
HOST = f"nullif(lower(split_part(trim(hostname, {BLANK}), '.', 1)), '')"


def instants() -> str:
    """att(src, row_id, host, plain, us): every row of both tables; us is null where the stamp names no instant."""
    canon = " ".join(f"WHEN regexp_matches(t, {_q(p)}) THEN regexp_replace(t, {_q(p)}, {_q(r)})" for p, r in FORMS)
    months = "'JanFebMarAprMayJunJulAugSepOctNovDec'"
    part = lambda i: f"split_part(c, '|', {i})"
    local = lambda date: f"epoch_us(({date})::TIMESTAMP) + clock"
    ymd = lambda y: f"try_cast({y} || '-' || lpad(mo::VARCHAR, 2, '0') || '-' || lpad(da, 2, '0') AS DATE)"
    return f"""WITH own AS (SELECT lower(split_part(trim(hostname, {BLANK}), '.', 1)) AS host, coalesce(d.tz_name, s.z) AS zone FROM device_inventory d LEFT JOIN (SELECT site_id, min(tz_name) AS z FROM site_manifest GROUP BY 1) s USING (site_id)),
hz AS (SELECT host, min(zone) AS zone FROM own WHERE host <> '' GROUP BY 1 HAVING min(zone) IN (SELECT name FROM pg_timezone_names())),
ab AS (SELECT zone, abbr, list(o) AS os FROM (VALUES {_abbreviations()}) t(zone, abbr, o) WHERE zone IN (SELECT zone FROM hz) GROUP BY 1, 2),
src0 AS (SELECT 'log_event' AS src, seq AS row_id, trim("timestamp", {BLANK}) AS t, "timestamp" AS raw, {HOST} AS host, epoch_us(received_at) AS seen FROM log_event UNION ALL SELECT 'classified_event', event_id, trim("timestamp", {BLANK}), "timestamp", {HOST}, epoch_us(received_at) FROM classified_event),
src1 AS (SELECT row_number() OVER () AS n, src0.*, hz.zone, coalesce(regexp_matches(raw, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(?:\\.\\d+)?Z$'), false) AS plain, CASE {canon} END AS c FROM src0 LEFT JOIN hz USING (host)),
f0 AS (SELECT *, {part(1)} AS y, CASE WHEN length({part(2)}) < 3 THEN try_cast({part(2)} AS INT) ELSE (strpos({months}, {part(2)}) + 2) // 3 END AS mo, {part(3)} AS da, try_cast({part(4)} AS INT) AS h, try_cast({part(5)} AS INT) AS mi, try_cast({part(6)} AS INT) AS s, rpad(left({part(7)}, 6), 6, '0')::BIGINT AS fr, {part(8)} AS z, lower({part(9)}) AS half FROM src1 WHERE c IS NOT NULL),
f1 AS (SELECT *, CASE WHEN h <= 23 AND mi <= 59 AND s <= 59 AND (half = '' OR h BETWEEN 1 AND 12) THEN ((h + CASE WHEN half = 'p' AND h < 12 THEN 12 WHEN half = 'a' AND h = 12 THEN -12 ELSE 0 END) * 3600 + mi * 60 + s) * 1000000::BIGINT + fr END AS clock,
 CASE WHEN z IN ('Z', 'z', 'UTC', 'GMT', 'UT') THEN 0 WHEN regexp_matches(z, '^[+-]') THEN CASE left(z, 1) WHEN '-' THEN -1 ELSE 1 END * (replace(z, ':', '')[2:3]::BIGINT * 60 + replace(z, ':', '')[4:5]::BIGINT) * 60000000 END AS fixed, make_timestamp(seen) AS st FROM f0),
f2 AS (SELECT *, y <> '' AS dated, CASE WHEN y <> '' THEN [{local(ymd("y"))}] WHEN da <> '' THEN list_transform(range(-9, 2), lambda k: CASE WHEN k >= -1 OR da::INT = 29 THEN {local(ymd("(year(st) + k)::VARCHAR"))} END) ELSE list_transform(range(-2, 2), lambda k: epoch_us(date_trunc('day', st)) + k * {DAY} + clock) END AS locals FROM f1),
g0 AS (SELECT n, dated, seen, zone, z, fixed, unnest(locals) AS l FROM f2),
g1 AS (SELECT g0.*, CASE WHEN fixed IS NOT NULL THEN [fixed] WHEN g0.zone IS NULL THEN NULL WHEN z = '' THEN list_distinct([{_offset(f"l - {DAY}", "g0.zone")}, {_offset(f"l + {DAY}", "g0.zone")}]) ELSE ab.os END AS os, CASE WHEN fixed IS NULL AND g0.zone IS NOT NULL AND z = '' THEN {_offset(f"l - {DAY}", "g0.zone")} END AS before FROM g0 LEFT JOIN ab ON ab.zone = g0.zone AND ab.abbr = z WHERE l IS NOT NULL),
g2 AS (SELECT *, l - unnest(os) AS x FROM g1 WHERE os IS NOT NULL),
g3 AS (SELECT *, CASE WHEN fixed IS NOT NULL THEN true ELSE x + {_offset("x")} = l END AS fits FROM g2),
g4 AS (SELECT n, dated, seen, l, z, any_value(before) AS before, bool_or(fits) AS good, max(x) FILTER (fits AND x <= seen) AS f_late, min(x) FILTER (fits) AS f_first, max(x) FILTER (x <= seen) AS a_late, min(x) AS a_first, any_value(fixed) AS fixed FROM g3 GROUP BY n, dated, seen, l, z),
g5 AS (SELECT n, dated, seen, CASE WHEN fixed IS NOT NULL THEN a_first WHEN good THEN coalesce(f_late, f_first) WHEN z = '' THEN l - before ELSE coalesce(a_late, a_first) END AS us FROM g4),
g6 AS (SELECT n, CASE WHEN bool_or(dated) THEN max(us) ELSE max(us) FILTER (us <= seen) END AS us FROM g5 GROUP BY n),
ep AS (SELECT n, CASE WHEN length(whole) < 12 THEN whole::BIGINT * 1000000 + rpad(left(frac, 6), 6, '0')::BIGINT WHEN length(whole) < 15 THEN whole::BIGINT * 1000 + rpad(left(frac, 3), 3, '0')::BIGINT WHEN length(whole) < 18 THEN whole::BIGINT ELSE try_cast(whole AS BIGINT) // 1000 END AS us FROM (SELECT n, split_part(t, '.', 1) AS whole, split_part(t, '.', 2) AS frac FROM src1 WHERE regexp_matches(t, '^\\d{{9,19}}(?:\\.\\d+)?$'))),
att AS (SELECT src, row_id, host, plain, coalesce(g6.us, ep.us) AS us FROM src1 LEFT JOIN g6 USING (n) LEFT JOIN ep USING (n))"""


CELLS = """, ce AS (SELECT DISTINCT ON (event_id) event_id, coalesce(nullif(lower(trim(category)), ''), 'other') AS category, coalesce(lower(trim(severity)), '') AS severity, coalesce(repeats, 1) AS repeats FROM classified_event),
ci AS (SELECT DISTINCT ON (row_id) row_id, host, us FROM att WHERE src = 'classified_event'),
cell AS (SELECT host AS hostname, category, severity, count(*) AS n_events, sum(repeats)::BIGINT AS total_repeats, coalesce(max(us), -1) AS last_us FROM ce JOIN ci ON row_id = event_id WHERE host IS NOT NULL GROUP BY 1, 2, 3)"""


def queries() -> dict[str, str]:
    return {
        "p2_found": instants() + CELLS + " SELECT * FROM cell",
        "p2_feature_rows": instants() + CELLS + " SELECT hostname, sum(n_events)::BIGINT AS n_events, sum(total_repeats)::BIGINT AS total_repeats, max(last_us) AS last_us, string_agg(category || '/' || severity || '=' || n_events || ':' || total_repeats || ':' || last_us, ',' ORDER BY category, severity) AS features FROM cell GROUP BY 1",
        "p3_found": instants() + " SELECT src AS src_table, row_id, us AS utc_us FROM att WHERE us IS NOT NULL AND NOT plain",
    }


#: Frames of log lines: name, pattern of the line's begin, and where severity and origin stand in it (group numbers, 0 for none).
FRAMES = (
    ("pri", r"^<(\d{1,3})>\d{1,2} (?:-|\d{4}-\d\d-\d\d)\S* \S+ (\S+) \S+ \S+ (?:-|\[)", 1, 2),
    ("bsd", r"^(?:<(\d{1,3})>)?[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d(?:\.\d+)? \S+ ([^\s:\[]+)(?:\[[^\]]*\])?:", 1, 2),
    ("typed", r"^\d{1,2}:\d\d:\d\d(?:\.\d+)? ?§", 0, 0),
    ("slash", r"^\d{4}/\d\d/\d\d \d\d:\d\d:\d\d(?:\.\d+)? (?:([a-z]+): )?(\w+): ", 1, 2),
    ("comma", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+ ([A-Za-z]+) (\S+): ", 1, 2),
    ("letter", r"^([IWEFD])\d{4} \d\d:\d\d:\d\d\.\d+ +\d+ ([^\s:]+):\d+\]", 1, 2),
    ("pairs", r'^(?:\w+=(?:"[^"]*"|[^ "]*) )*(?:time|ts)="?\d{4}-\d\d-\d\d.*\bmsg=', 0, 0),
    ("object", r'^\{\s*(?:"[A-Za-z]|$)', 0, 0),
    ("bars", r"^\d{4}-\d\d-\d\d[T ][^|]* \| ([A-Za-z]+) +\| ([^\s|]+) +\| ", 1, 2),
    ("brackets", r"^\[[A-Z][a-z]{2} [A-Z][a-z]{2} \d\d \d\d:\d\d:\d\d(?:\.\d+)? \d{4}\] \[(\w+):([a-z]+)\d?\]", 2, 1),
    ("thread", r"^\d\d-[A-Z][a-z]{2}-\d{4} \d\d:\d\d:\d\d\.\d+ ([A-Z]+) \[[^\]]*\] (\S+) ", 1, 2),
)
#: What programs call the severities, most urgent first.
CALLED = (("emerg", "emergency", "emergencies", "panic"), ("alert", "alerts"), ("crit", "critical", "fatal", "f"), ("err", "error", "errors", "severe", "e"), ("warning", "warn", "warnings", "w"), ("notice", "notification", "notifications"), ("info", "informational", "information", "config", "i"), ("debug", "debugging", "trace", "fine", "finer", "finest", "verbose", "d"))


def entries() -> str:
    """en(src_table, first_seq, last_seq, severity_raw, appname): logical entries, each line tried against all frames."""
    kind = " ".join(f"WHEN regexp_matches(l, {_q(p)}) THEN {_q(n)}" for n, p, _, _ in FRAMES)
    group = lambda i: " ".join(f"WHEN {_q(f[0])} THEN regexp_extract(l, {_q(f[1])}, {f[i]})" for f in FRAMES if f[i])
    names = " ".join(f"WHEN lower(w) IN ({', '.join(map(_q, ws))}) THEN {_q(ws[0])}" for ws in CALLED)
    order = "[" + ", ".join(_q(ws[0]) for ws in CALLED) + "]"
    keyed = lambda keys: f"""nullif(regexp_extract(l, '"(?:{keys})"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 1), '')"""
    told = lambda keys: f"""nullif(regexp_extract(l, '(?:^|\\s)(?:{keys})="?([^\\s"]+)', 1), '')"""
    return f"""WITH ln AS (SELECT 'raw_line' AS src_table, coalesce(stream, '') AS stream, seq, regexp_replace(regexp_replace(line, '^' || chr(65279), ''), '\\r+$', '') AS l FROM raw_line
 UNION ALL SELECT 'log_event', coalesce({HOST}, ''), seq, regexp_replace(regexp_replace(message, '^' || chr(65279), ''), '\\r+$', '') FROM log_event WHERE appname = 'syslog' AND "timestamp" = ''),
lk AS (SELECT *, CASE {kind} END AS kind, coalesce(trim(l, {BLANK}) = '', true) AS blank FROM ln),
lw AS (SELECT *, CASE kind WHEN 'pairs' THEN {told("level|lvl|severity")} ELSE nullif(CASE kind {group(2)} END, '') END AS w0, CASE kind WHEN 'pairs' THEN {told("app|logger|component")} WHEN 'typed' THEN 'scrt-session' ELSE nullif(CASE kind {group(3)} END, '') END AS a0,
 {keyed("level|lvl|severity")} AS jw, {keyed("app|logger|component")} AS ja, try_cast(nullif(regexp_extract(l, ': %[A-Za-z]\\w*-([0-7])-\\w+: ', 1), '') AS INT) AS tag FROM lk),
lf AS (SELECT *, last_value(CASE WHEN kind IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY src_table, stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_seq FROM lw),
le AS (SELECT src_table, stream, first_seq, max(seq) FILTER (NOT blank) AS last_seq, any_value(kind) FILTER (kind IS NOT NULL) AS k, any_value(w0) FILTER (kind IS NOT NULL) AS w0, any_value(a0) FILTER (kind IS NOT NULL) AS a0, any_value(tag) FILTER (kind = 'bsd') AS tag, arg_min(jw, seq) FILTER (jw IS NOT NULL) AS jw, arg_min(ja, seq) FILTER (ja IS NOT NULL) AS ja FROM lf WHERE first_seq IS NOT NULL GROUP BY 1, 2, 3),
lg AS (SELECT *, CASE WHEN k = 'object' THEN jw ELSE w0 END AS w FROM le),
en AS (SELECT src_table, stream, first_seq, last_seq, coalesce(CASE WHEN k IN ('pri', 'bsd') THEN {order}[(coalesce(try_cast(w AS INT), tag) & 7) + 1] ELSE CASE {names} END END, 'info') AS severity_raw, nullif(CASE WHEN k = 'object' THEN ja ELSE a0 END, '-') AS appname FROM lg)"""


def entry_queries() -> dict[str, str]:
    text = """, tx AS (SELECT src_table, stream, first_seq, string_agg(coalesce(l, ''), chr(10) ORDER BY seq) AS text FROM lf JOIN (SELECT src_table, stream, first_seq, last_seq FROM en) USING (src_table, stream, first_seq) WHERE seq <= last_seq GROUP BY 1, 2, 3)"""
    return {
        "p1_found": entries() + " SELECT src_table, first_seq, last_seq, severity_raw, appname FROM en",
        "p1_log_events": entries() + text + " SELECT src_table, stream, first_seq, last_seq, severity_raw, appname, text FROM en JOIN tx USING (src_table, stream, first_seq)",
    }
