"""Rules that configurations have to keep, and searches over a fleet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import config_rules as R
from logloom.functions.hosts import BLANKS
from logloom.operators.events import PatternError, checked


def check(configs: DataFrame, rules: tuple = R.COMPLIANCE) -> DataFrame:
    """rule_id, severity, device, passed, reason of every rule that applies to a device of configs(host, platform, text).

    A rule applies by platform and, where it has a condition, only if that is found. Forbidden patterns decide first, then
    least counts, then required patterns."""
    text = F.col("text")
    found = lambda p: text.rlike(f"(?im){p}")
    verdicts = []
    for rule_id, _, severity, platforms, required, forbidden, condition, least in rules:
        reason = F.lit("ok")
        if required:
            hit = found(required[0])
            for p in required[1:]:
                hit = hit | found(p)
            reason = F.when(hit, reason).otherwise("None of the required patterns matched")
        if least:
            n = F.regexp_count(text, F.lit(f"(?im){least[0]}"))
            reason = F.when(n < least[1], F.concat(F.lit("Only "), n.cast("string"), F.lit(f" match(es) of '{least[0][:40]}'; need ≥{least[1]}"))).otherwise(reason)
        for p in reversed(forbidden):
            reason = F.when(found(p), f"Forbidden pattern matched: {p[:60]}").otherwise(reason)
        applies = F.col("platform").isin(*platforms)
        if condition:
            gate = found(condition[0])
            for p in condition[1:]:
                gate = gate | found(p)
            applies = applies & gate
        verdicts.append(F.when(applies, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), reason.alias("reason"))))
    rows = configs.select(F.col("host").alias("device"), F.explode(F.array_compact(F.array(*verdicts))).alias("v"))
    return rows.select("v.rule_id", "v.severity", "device", (F.col("v.reason") == "ok").alias("passed"), "v.reason")


def rollup(checks: DataFrame) -> DataFrame:
    """rule_id, n_pass, n_fail, percent passed, failing ARRAY<STRUCT<device, reason>> in order of devices: as long as the fleet at most."""
    failing = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("device", "reason"))))
    rows = checks.groupBy("rule_id").agg(F.count_if("passed").alias("n_pass"), F.count_if(~F.col("passed")).alias("n_fail"), failing.alias("failing"))
    return rows.withColumn("percent", F.call_function("div", 200 * F.col("n_pass") + F.col("n_pass") + F.col("n_fail"), 2 * (F.col("n_pass") + F.col("n_fail"))))


def totals(checks: DataFrame) -> DataFrame:
    """total, passed, failed, per_mille: passed checks of a thousand, 0 where there are none."""
    t = checks.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    return t.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.when(F.col("total") > 0, F.floor(1000 * F.col("passed") / F.col("total"))).otherwise(F.lit(0)).cast("bigint").alias("per_mille"))


def compiled(pattern: str) -> str:
    """The pattern as it is searched for: plain words literally. One that is no pattern, or that finds nothing everywhere, is an error."""
    if not re.search(r"[\\.*+?^$\[\](){}|]", pattern):
        return re.escape(pattern)
    if re.search(checked(pattern), ""):
        raise PatternError("invalid regex: it matches the empty text")
    return pattern


def search_fleet(configs: DataFrame, pattern: str, case_insensitive: bool = True, shown: int = 5, around: int = 40) -> DataFrame:
    """device, platform, match_count, snippets of the devices whose text the pattern finds; plain words are taken literally.

    A snippet is a match with what stands `around` it, the first `shown` of them, line feeds marked."""
    own = F.lit(("(?im)" if case_insensitive else "(?m)") + compiled(pattern))
    text = F.col("text")
    rows = configs.select(F.col("host").alias("device"), "platform", "text", F.regexp_extract_all(text, own, F.lit(0)).alias("found")).where("size(found) > 0")
    # Where a match begins: behind the parts and matches before it.
    part = F.transform(F.slice(F.split(text, ("(?im)" if case_insensitive else "(?m)") + compiled(pattern), -1), 1, shown), F.length)
    rows = rows.withColumns({"first": F.slice("found", 1, shown), "parts": part})
    begin = lambda i: F.aggregate(F.slice("parts", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice("first", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))

    def snippet(x: Column, i: Column) -> Column:
        low = F.greatest(begin(i) - around, F.lit(0))
        high = F.least(begin(i) + F.length(x) + around, F.length("text"))
        return F.replace(F.substring(F.col("text"), low + 1, high - low), F.lit("\n"), F.lit(" ⏎ "))

    return rows.select("device", "platform", F.size("found").cast("bigint").alias("match_count"), F.transform("first", snippet).alias("snippets"))


#: Stages in which evidence is looked through - what is taken, and what it has to hold.
QUOTED, TOKEN = r"['\"]([^'\"]{4,80})['\"]", r"\w{3,}"
CONFIG_LINE = r"(?i)^(?:set|no|router|interface|protocols|service|ip\s+|snmp|ssh|ntp|aaa)"
ADDRESS, INTERFACE = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\b(?:ge|xe|et|ae|Ethernet|Port-Channel)[-/\d.]+\b"
STAGES = (("pieces", QUOTED, 1, TOKEN, 80), ("lines", None, 0, CONFIG_LINE, 120), ("pieces", ADDRESS, 0, ".", 15), ("pieces", INTERFACE, 0, ".", 120))


def _holding(texts: Column, pattern: str) -> Column:
    return F.filter(texts, lambda x: x.rlike(pattern))


def fingerprint(findings: DataFrame) -> DataFrame:
    """id, fingerprint of findings(id, evidence): what the first stage that takes something takes first, else null."""
    text = F.btrim(F.coalesce("evidence", F.lit("")), F.lit(BLANKS))
    rows = findings.select("id", text.alias("text")).withColumn("lines", F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS))))
    taken = []
    for kind, pattern, group, holds, most in STAGES:
        offered = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if kind == "pieces" else F.col("lines")
        taken.append(F.substring(F.try_element_at(_holding(offered, holds), F.lit(1)), 1, most))
    return rows.select("id", F.coalesce(*taken).alias("fingerprint"))
