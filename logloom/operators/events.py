"""Classification of log events and the aggregates over classified events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import rules
from logloom.functions.guards import needed
from logloom.functions.session import once, ranked, stored
from logloom.functions.stamps import rare

STRIP = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def strip_escapes(c: Column) -> Column:
    """Without terminal escape sequences; texts without the escape character aren't searched."""
    return F.when(F.contains(c, F.lit("\x1b")), F.regexp_replace(c, rules.ESCAPES, "")).otherwise(c)


def short_host(c: Column) -> Column:
    return F.substring_index(F.coalesce(c, F.lit("")), ".", 1)


def severity_rank(c: Column) -> Column:
    out = F.lit(len(rules.SEVERITIES))
    for i, s in reversed(list(enumerate(rules.SEVERITIES))):
        out = F.when(c == s, i).otherwise(out)
    return out


def first_rule(key: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Number of the first pattern found in key, evaluated once; null for none.

    A pattern is tried only on keys that hold one of the texts that it needs."""

    def chain(k: Column) -> Column:
        out = None
        for i, p in enumerate(patterns):
            hit = k.rlike(p)
            if words := needed(p):
                may = F.contains(k, F.lit(words[0]))
                for w in words[1:]:
                    may = may | F.contains(k, F.lit(w))
                hit = may & hit
            out = F.when(hit, i) if out is None else out.when(hit, i)
        return out

    return rare(key, chain)


def classify(events: DataFrame, table: tuple = rules.CLASSIFICATION) -> DataFrame:
    """seq and the classified event of each row of events(seq, timestamp, hostname, appname, severity_raw, message).

    The first rule of the table that fits decides; null texts count as empty; events that no rule fits are info/other,
    described by their message, their program or a fixed text, and high where the raw severity is urgent. Repeated rows
    stay; further columns are dropped."""
    text = lambda c: F.coalesce(c, F.lit(""))
    ev = events.select("seq", *[text(c).alias(c) for c in ("timestamp", "hostname", "appname", "severity_raw")], strip_escapes(text("message")).alias("clean"))
    ev = ev.withColumn("rule", first_rule(F.lower(F.concat("appname", F.lit(" "), "clean")), [r[0] for r in table]))
    told = lambda i: F.try_element_at(F.array(*[F.lit(r[i]) for r in table]), F.col("rule") + 1)
    snippet = strip(F.substring("clean", 1, 120))
    described = F.when(snippet != "", snippet).when(F.col("appname") != "", F.col("appname")).otherwise("General log message")
    urgent = F.lower("severity_raw").isin(*rules.URGENT_RAW)
    ev = ev.withColumns({"severity": F.coalesce(told(1), F.when(urgent, "high").otherwise("info")), "category": F.coalesce(told(2), F.lit("other")), "description": F.coalesce(told(3), described)})
    # A rule that says info is lifted as well.
    ev = ev.withColumn("severity", F.when(urgent & (F.col("severity") == "info"), "high").otherwise(F.col("severity")))
    return ev.select(
        "seq", "timestamp", short_host(F.col("hostname")).alias("hostname"), "appname", "severity", "severity_raw", "category", "description", action(F.col("severity"), F.col("category")).alias("action"), F.substring("clean", 1, 500).alias("message"), F.substring("clean", 1, 200).alias("sample_message")
    )


def action(severity: Column, category: Column) -> Column:
    known = F.create_map(*[F.lit(x) for s, c, t in rules.ACTIONS for x in (f"{s}/{c}", t)])
    return F.coalesce(F.try_element_at(known, F.concat_ws("/", severity, category)), F.lit(rules.OTHER_ACTION))


def severity_counts(classified: DataFrame) -> DataFrame:
    """severity, n of all five severities, 0 where none occurs."""
    one = classified.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES])
    return one.select(F.expr("stack({}, {}) as (severity, n)".format(len(rules.SEVERITIES), ", ".join(f"'{s}', {s}" for s in rules.SEVERITIES))))


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(F.count("*").alias("n"))


def health(classified: DataFrame, external_alerts: int = 0) -> DataFrame:
    """One row: score, grade, label."""
    return scored(classified.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES]), external_alerts)


def scored(counts: DataFrame, external_alerts: int = 0) -> DataFrame:
    """score, grade, grade_label of counts(critical, high, medium, ...)."""
    lost = F.least(F.col("critical") * 5, F.lit(40)) + F.least(F.col("high") * 2, F.lit(30)) + F.least(F.col("medium"), F.lit(15)) + min(external_alerts * 3, 15)
    one = counts.select(F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost)).cast("bigint").alias("score"))
    grade, label = None, None
    for least, g, name in rules.GRADES:
        grade = F.when(F.col("score") >= least, g) if grade is None else grade.when(F.col("score") >= least, g)
        label = F.when(F.col("score") >= least, name) if label is None else label.when(F.col("score") >= least, name)
    return one.select("score", grade.alias("grade"), label.alias("grade_label"))


def incidents(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("severity").isin("critical", "high", "medium") & ~F.col("description").isin(*rules.RECOVERIES))


def rolled(classified: DataFrame) -> DataFrame:
    """severity, category, incident, description, hostname, n, newest, first: counts from one pass, stored; all that summaries ask.

    Descriptions and hosts are told apart for incidents only, so the table has a row per kind of incident and host."""
    hit = F.col("severity").isin("critical", "high", "medium") & ~F.col("description").isin(*rules.RECOVERIES)
    own = lambda c: F.when(hit, F.col(c)).otherwise("").alias(c)
    rows = once(classified.select("seq", "timestamp", "severity", "category", "description", "hostname"), incident=hit)
    hit = F.col("incident")
    return stored(rows.groupBy("severity", "category", "incident", own("description"), own("hostname")).agg(F.count("*").alias("n"), F.max(F.struct("timestamp", (-F.col("seq")).alias("at"))).alias("newest"), F.min("seq").alias("first")), "rolled")


def item_groups(roll: DataFrame, devices: int = 10) -> DataFrame:
    """severity, description, count, category, newest, devices of each group of incidents of rolled()."""
    own, key = roll.where("incident"), ["severity", "description"]
    groups = own.groupBy(*key).agg(F.sum("n").alias("count"), F.max_by("category", "newest").alias("category"), F.max("newest").alias("newest"))
    hosts = own.where("hostname != ''").select(*key, "hostname").distinct()
    hosts = hosts.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("hostname"))).where(F.col("at") <= devices)
    hosts = hosts.groupBy(*key).agg(F.array_sort(F.collect_list("hostname")).alias("devices"))
    return groups.join(hosts, key, "left").withColumn("devices", F.coalesce("devices", F.array().cast("array<string>")))


def _item_order() -> list[Column]:
    return [severity_rank(F.col("severity")).asc(), F.desc("count"), F.desc("newest")]


def action_items(classified: DataFrame, devices: int = 10, samples: int = 3) -> DataFrame:
    """severity, category, description, count, rank, devices, sample_messages of each group of incidents.

    Groups are (severity, description): counts and devices from one pass, samples from a second one, in which the limit of
    rank goes below the shuffle, so a group that holds most events sends a few rows per task."""
    key = ["severity", "description"]
    texts = incidents(classified).withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("timestamp"), "seq"))).where(F.col("at") <= samples)
    texts = texts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.substring("message", 1, 300).alias("m")))), lambda r: r["m"]).alias("sample_messages"))
    items = ranked(item_groups(rolled(classified), devices).join(texts, key, "left"), _item_order(), "rank")
    return items.select("severity", "category", "description", "count", "rank", "devices", F.coalesce("sample_messages", F.array().cast("array<string>")).alias("sample_messages"))


def top_devices(classified: DataFrame, limit: int = 20) -> DataFrame:
    """hostname, total, critical, high, medium, categories MAP of the hosts with most critical, high and all events."""
    own = classified.where("hostname != ''")
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    per = own.groupBy("hostname", "category").agg(F.count("*").alias("n"), *map(n, ("critical", "high", "medium")), F.max(F.struct(-severity_rank(F.col("severity")), "timestamp", -F.col("seq"))).alias("first"))
    rows = per.groupBy("hostname").agg(F.sum("n").alias("total"), *[F.sum(s).alias(s) for s in ("critical", "high", "medium")], F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("categories"), F.max("first").alias("first"))
    return rows.orderBy(F.desc("critical"), F.desc("high"), F.desc("total"), F.desc("first")).limit(limit).drop("first")


def top_offenders(classified: DataFrame, limit: int = 10) -> DataFrame:
    """hostname, n of the hosts with most events; events without host count as `unknown`."""
    name = F.when(F.col("hostname") != "", F.col("hostname")).otherwise("unknown")
    rows = classified.groupBy(name.alias("hostname")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(limit).drop("first")


def newest_by_severity(classified: DataFrame, limit: int = 300) -> DataFrame:
    return classified.orderBy(severity_rank(F.col("severity")), F.desc("timestamp"), "seq").limit(limit)


class PatternError(ValueError):
    """A pattern that can't be searched for."""


def checked(pattern: str) -> str:
    """The pattern, or PatternError where it is none."""
    try:
        re.compile(pattern)
    except re.error as error:
        raise PatternError(f"invalid regex: {error}") from error
    return pattern


def search(classified: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Events whose message the pattern finds, whatever the case; a pattern without special characters is looked up as text."""
    hit = F.contains(F.lower("message"), F.lit(pattern.lower())) if re.fullmatch(r"[\w ]+", pattern) else F.col("message").rlike(f"(?i){checked(pattern)}")
    found = classified.where(hit)
    return found.orderBy("seq").limit(limit) if limit else found


def summary(classified: DataFrame) -> DataFrame:
    """ord, bullet: score, severities, the three largest categories and up to three items, as text, from one pass over the events."""
    roll = rolled(classified)
    count = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0))
    known = roll.agg(*[count(s).alias(s) for s in rules.SEVERITIES])
    score = scored(known).select(F.lit(1).alias("ord"), F.format_string("Health score %d/100 — Grade %s (%s)", "score", "grade", "grade_label").alias("bullet"))
    sev = known.select(F.lit(2).alias("ord"), F.format_string("Severity: critical=%d, high=%d, medium=%d", "critical", "high", "medium").alias("bullet"))
    cats = roll.groupBy("category").agg(F.sum("n").alias("n"), F.min("first").alias("first")).orderBy(F.desc("n"), "first").limit(3)
    cats = cats.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", F.format_string("%s (%d)", "category", "n").alias("t")))).alias("xs")).where("size(xs) > 0").select(F.lit(3).alias("ord"), F.concat(F.lit("Top categories: "), F.array_join(F.transform("xs", lambda x: x["t"]), ", ")).alias("bullet"))
    items = item_groups(roll).orderBy(*_item_order()).limit(3).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_item_order())))  # three rows
    where = F.when(F.size("devices") == 1, F.col("devices")[0]).otherwise(F.concat(F.size("devices").cast("string"), F.lit(" devices")))
    tops = items.select((F.col("rank") + 3).alias("ord"), F.format_string("%s — %s (%d× on %s)", F.upper("severity"), "description", "count", where).alias("bullet"))
    calm = roll.where("incident").agg(F.count("*").alias("n")).where("n = 0").select(F.lit(4).alias("ord"), F.lit("No critical, high, or medium severity issues detected.").alias("bullet"))
    return score.unionByName(sev).unionByName(cats).unionByName(tops).unionByName(calm)


#: How the number of devices and events of an item is told, and when a count of alerts changes its class.
DEVICE_TEXTS = ("No specific devices captured.", "Single device affected: {}. Likely isolated issue.", "{} devices affected: {}. Check for shared upstream / common link.", "{} devices affected ({}…). Possible systemic issue — check shared infrastructure (switch / PSU / IGP).")
URGENCY_TEXTS = ((1000, "⚠️ Very high event rate ({} occurrences) — flooding logs."), (100, "Elevated event rate ({}) — sustained issue."), (10, "Moderate event rate ({}) — monitor for escalation."), (-1, "Low event rate ({}) — may be transient."))
ALERT_CLASSES = ((3, "crit"), (1, "high"), (0, "ok"))


def _told(text: str, *values: Column) -> Column:
    parts = text.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))])


def item_context(items: DataFrame) -> DataFrame:
    """severity, description, devices_text, urgency of action_items(): how many devices and events, in words."""
    n, none = F.size("devices"), DEVICE_TEXTS[0]
    number, names = n.cast("string"), F.array_join("devices", ", ")
    where = F.when(n == 0, none).when(n == 1, _told(DEVICE_TEXTS[1], F.get("devices", F.lit(0)))).when(n <= 3, _told(DEVICE_TEXTS[2], number, names)).otherwise(_told(DEVICE_TEXTS[3], number, F.array_join(F.slice("devices", 1, 5), ", ")))
    urgency = None
    for above, text in URGENCY_TEXTS:
        told = _told(text, F.format_number("count", 0))
        urgency = F.when(F.col("count") > above, told) if urgency is None else urgency.when(F.col("count") > above, told)
    return items.select("severity", "description", where.alias("devices_text"), urgency.alias("urgency"))


def alert_class(classified: DataFrame) -> DataFrame:
    """alerts, class: critical and high events together."""
    one = classified.agg(F.count_if(F.col("severity").isin("critical", "high")).alias("alerts"))
    out = None
    for least, name in ALERT_CLASSES:
        out = F.when(F.col("alerts") >= least, name) if out is None else out.when(F.col("alerts") >= least, name)
    return one.select("alerts", out.alias("class"))
