"""Queries over log_event, and the same questions as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import rules
from logloom.functions.session import table
from logloom.operators import events

Query = Callable[[SparkSession, str], DataFrame]
PATTERN = r"peer .* (left|hold)"
WORD = "link down"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.classify(table(spark, sf_dir, "log_event"))


def _joined(c: str):
    return F.array_join(c, "|")


def classify_events(spark, sf_dir):
    return _classified(spark, sf_dir)


def severity_counts(spark, sf_dir):
    return events.severity_counts(_classified(spark, sf_dir))


def category_counts(spark, sf_dir):
    return events.category_counts(_classified(spark, sf_dir))


def health_score(spark, sf_dir):
    return events.health(_classified(spark, sf_dir))


def action_items(spark, sf_dir):
    items = events.action_items(_classified(spark, sf_dir))
    return items.withColumns({"devices": _joined("devices"), "sample_messages": _joined("sample_messages"), "rank": F.col("rank").cast("bigint")})


def top_devices(spark, sf_dir):
    rows = events.top_devices(_classified(spark, sf_dir))
    return rows.withColumn("categories", F.array_join(F.array_sort(F.transform(F.map_entries("categories"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ","))


def top_offenders(spark, sf_dir):
    return events.top_offenders(_classified(spark, sf_dir))


def events_top300(spark, sf_dir):
    return events.newest_by_severity(_classified(spark, sf_dir)).select("seq", "severity", "timestamp")


def search_logs(spark, sf_dir):
    return events.search(_classified(spark, sf_dir), PATTERN).select("seq", "hostname", "message")


def search_totals(spark, sf_dir):
    own = _classified(spark, sf_dir)
    return own.agg(F.count("*").alias("scanned"), F.count_if(F.contains(F.lower("message"), F.lit(WORD))).alias("matched"))


def recovery_events(spark, sf_dir):
    return _classified(spark, sf_dir).where(F.col("description").isin(*rules.RECOVERIES)).select("seq", "description")


def incident_events(spark, sf_dir):
    return events.incidents(_classified(spark, sf_dir)).select("seq", "severity", "description")


def summary_bullets(spark, sf_dir):
    return events.summary(_classified(spark, sf_dir)).withColumn("ord", F.col("ord").cast("bigint"))


def item_context(spark, sf_dir):
    return events.item_context(events.action_items(_classified(spark, sf_dir)))


def alert_class(spark, sf_dir):
    return events.alert_class(_classified(spark, sf_dir))


def strip_ansi(spark, sf_dir):
    return table(spark, sf_dir, "log_event").where(F.contains("message", F.lit("\x1b"))).select("seq", events.strip_escapes(F.col("message")).alias("clean"))


def short_hosts(spark, sf_dir):
    return table(spark, sf_dir, "log_event").groupBy(events.short_host(F.col("hostname")).alias("host")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    own = (classify_events, severity_counts, category_counts, health_score, action_items, top_devices, top_offenders, events_top300, search_logs, search_totals, recovery_events, incident_events, summary_bullets, item_context, alert_class, strip_ansi, short_hosts)
    return {f.__name__: f for f in own}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def classified_sql(source: str = "log_event") -> str:
    case = " ".join(f"WHEN regexp_matches(k, {_q(p)}) THEN {i}" for i, (p, *_) in enumerate(rules.CLASSIFICATION))
    values = ", ".join(f"({i}, {_q(s)}, {_q(c)}, {_q(d)})" for i, (_, s, c, d) in enumerate(rules.CLASSIFICATION))
    acts = ", ".join(f"({_q(s)}, {_q(c)}, {_q(a)})" for s, c, a in rules.ACTIONS)
    return f"""WITH ev AS (SELECT seq, coalesce("timestamp", '') AS ts, coalesce(hostname, '') AS host, coalesce(appname, '') AS app, coalesce(severity_raw, '') AS raw,
 regexp_replace(coalesce(message, ''), {_q(rules.ESCAPES)}, '', 'g') AS clean FROM {source}),
kk AS (SELECT *, lower(app || ' ' || clean) AS k FROM ev),
ruled AS (SELECT *, CASE {case} END AS rid FROM kk),
told AS (SELECT r.*, v.sev AS vs, v.cat AS vc, v.descr AS vd FROM ruled r LEFT JOIN (VALUES {values}) v(id, sev, cat, descr) ON v.id = r.rid),
c0 AS (SELECT seq, ts AS "timestamp", split_part(host, '.', 1) AS hostname, app AS appname,
 CASE WHEN coalesce(vs, 'info') = 'info' AND lower(raw) IN ('crit', 'emerg', 'alert') THEN 'high' ELSE coalesce(vs, 'info') END AS severity, raw AS severity_raw, coalesce(vc, 'other') AS category,
 coalesce(vd, nullif(regexp_replace(substr(clean, 1, 120), '^\\s+|\\s+$', '', 'g'), ''), nullif(app, ''), 'General log message') AS description, substr(clean, 1, 500) AS message, substr(clean, 1, 200) AS sample_message FROM told),
c AS (SELECT c0.*, coalesce(a.act, {_q(rules.OTHER_ACTION)}) AS action, CASE c0.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END AS sev_rank
 FROM c0 LEFT JOIN (VALUES {acts}) a(sev, cat, act) ON a.sev = c0.severity AND a.cat = c0.category),
inc AS (SELECT * FROM c WHERE severity IN ('critical', 'high', 'medium') AND description NOT IN ({", ".join(map(_q, rules.RECOVERIES))}))"""


def _items_sql() -> str:
    return """, grp AS (SELECT severity, description, count(*) AS n, arg_max(category, ("timestamp", -seq)) AS category, max(("timestamp", -seq)) AS newest FROM inc GROUP BY ALL),
hs AS (SELECT severity, description, hostname, row_number() OVER (PARTITION BY severity, description ORDER BY hostname) AS k FROM (SELECT DISTINCT severity, description, hostname FROM inc WHERE hostname <> '')),
hl AS (SELECT severity, description, string_agg(hostname, '|' ORDER BY k) AS devices, count(*) AS n_dev, min(hostname) AS one FROM hs WHERE k <= 10 GROUP BY ALL),
ms AS (SELECT severity, description, substr(message, 1, 300) AS m, row_number() OVER (PARTITION BY severity, description ORDER BY "timestamp" DESC, seq) AS k FROM inc),
ml AS (SELECT severity, description, string_agg(m, '|' ORDER BY k) AS sample_messages FROM ms WHERE k <= 3 GROUP BY ALL),
items AS (SELECT g.severity, g.category, g.description, g.n AS "count", row_number() OVER (ORDER BY CASE g.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, g.n DESC, g.newest DESC) AS "rank",
 coalesce(h.devices, '') AS devices, coalesce(h.n_dev, 0) AS n_dev, h.one, coalesce(m.sample_messages, '') AS sample_messages FROM grp g LEFT JOIN hl h USING (severity, description) LEFT JOIN ml m USING (severity, description))"""


def _health_sql() -> str:
    return """sc AS (SELECT greatest(0, least(100, 100 - least(count(*) FILTER (severity = 'critical') * 5, 40) - least(count(*) FILTER (severity = 'high') * 2, 30) - least(count(*) FILTER (severity = 'medium'), 15))) AS score FROM c),
hg AS (SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade,
 CASE WHEN score >= 90 THEN 'Healthy' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Attention Needed' WHEN score >= 40 THEN 'Degraded' ELSE 'Critical' END AS grade_label FROM sc)"""


def oracle_sql() -> dict[str, str]:
    c = classified_sql()
    rec = ", ".join(map(_q, rules.RECOVERIES))

    def told(text: str, *values: str) -> str:
        parts = text.split("{}")
        return " || ".join([_q(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, _q(p))]])

    return {
        "classify_events": c + ' SELECT seq, "timestamp", hostname, appname, severity, severity_raw, category, description, action, message, sample_message FROM c',
        "severity_counts": c + " SELECT s.severity, count(c.seq) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) s(severity) LEFT JOIN c USING (severity) GROUP BY 1",
        "category_counts": c + " SELECT category, count(*) AS n FROM c GROUP BY 1",
        "health_score": c + ", " + _health_sql() + " SELECT score, grade, grade_label FROM hg",
        "action_items": c + _items_sql() + ' SELECT severity, category, description, "count", "rank", devices, sample_messages FROM items',
        "top_devices": c + """, f AS (SELECT hostname, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, max((-sev_rank, "timestamp", -seq)) AS fst FROM c WHERE hostname <> '' GROUP BY 1),
 g AS (SELECT hostname, string_agg(category || '=' || n, ',' ORDER BY category || '=' || n) AS categories FROM (SELECT hostname, category, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1)
 SELECT hostname, total, critical, high, medium, categories FROM f JOIN g USING (hostname) ORDER BY critical DESC, high DESC, total DESC, fst DESC LIMIT 20""",
        "top_offenders": c + " SELECT coalesce(nullif(hostname, ''), 'unknown') AS hostname, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, min(seq) LIMIT 10",
        "events_top300": c + ' SELECT seq, severity, "timestamp" FROM c ORDER BY sev_rank, "timestamp" DESC, seq LIMIT 300',
        "search_logs": c + f" SELECT seq, hostname, message FROM c WHERE regexp_matches(message, {_q('(?i)' + PATTERN)})",
        "search_totals": c + f" SELECT count(*) AS scanned, count(*) FILTER (contains(lower(message), {_q(WORD)})) AS matched FROM c",
        "recovery_events": c + f" SELECT seq, description FROM c WHERE description IN ({rec})",
        "incident_events": c + " SELECT seq, severity, description FROM inc",
        "summary_bullets": c + _items_sql() + ", " + _health_sql() + """, cc AS (SELECT category, count(*) AS n, min(seq) AS f FROM c GROUP BY 1 ORDER BY n DESC, f LIMIT 3)
 SELECT 1::BIGINT AS ord, 'Health score ' || score || '/100 — Grade ' || grade || ' (' || grade_label || ')' AS bullet FROM hg
 UNION ALL SELECT 2, 'Severity: critical=' || count(*) FILTER (severity = 'critical') || ', high=' || count(*) FILTER (severity = 'high') || ', medium=' || count(*) FILTER (severity = 'medium') FROM c
 UNION ALL SELECT 3, 'Top categories: ' || string_agg(category || ' (' || n || ')', ', ' ORDER BY n DESC, f) FROM cc HAVING count(*) > 0
 UNION ALL SELECT "rank" + 3, upper(severity) || ' — ' || description || ' (' || "count" || '× on ' || CASE WHEN n_dev = 1 THEN one ELSE n_dev || ' devices' END || ')' FROM items WHERE "rank" <= 3
 UNION ALL SELECT 4, 'No critical, high, or medium severity issues detected.' FROM inc HAVING count(*) = 0""",
        "item_context": c + _items_sql() + " SELECT severity, description, CASE WHEN n_dev = 0 THEN " + told(events.DEVICE_TEXTS[0]) + " WHEN n_dev = 1 THEN " + told(events.DEVICE_TEXTS[1], "devices") + " WHEN n_dev <= 3 THEN " + told(events.DEVICE_TEXTS[2], "n_dev", "replace(devices, '|', ', ')") + " ELSE " + told(events.DEVICE_TEXTS[3], "n_dev", "array_to_string(string_split(devices, '|')[1:5], ', ')")
        + " END AS devices_text, CASE " + " ".join(f'WHEN "count" > {n} THEN ' + told(t, """format('{:,}', "count")""") for n, t in events.URGENCY_TEXTS) + " END AS urgency FROM items",
        "alert_class": c + " SELECT alerts, CASE " + " ".join(f"WHEN alerts >= {n} THEN '{k}'" for n, k in events.ALERT_CLASSES) + " END AS class FROM (SELECT count(*) FILTER (severity IN ('critical', 'high')) AS alerts FROM c)",
        "strip_ansi": f"SELECT seq, regexp_replace(message, {_q(rules.ESCAPES)}, '', 'g') AS clean FROM log_event WHERE contains(message, chr(27))",
        "short_hosts": "SELECT split_part(coalesce(hostname, ''), '.', 1) AS host, count(*) AS n FROM log_event GROUP BY 1",
    }
