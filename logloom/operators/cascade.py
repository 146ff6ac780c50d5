"""Single lines by a cascade of collector formats; the first that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import config_rules as R
from logloom.functions.stamps import rare
from logloom.operators.events import strip


def severity_of_pri(pri: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, R.RAW_SEVERITIES)), pri.try_cast("int").bitwiseAND(7) + 1)


def parse(lines: DataFrame) -> DataFrame:
    """seq, fmt and the LogEvent of each line of lines(seq, line, default_host); blank lines and empty terminal rows drop out.

    A line that no format fits is a message of program `syslog` with raw severity info and an empty timestamp. Null lines
    are blank, a null default_host is ''. Repeated rows stay."""
    clean = lines.select("seq", F.coalesce("default_host", F.lit("")).alias("default_host"), strip(F.regexp_replace("line", "^\ufeff+", "")).alias("line")).where("line != ''")
    line = F.col("line")

    def which(x: Column) -> Column:
        out = None
        for name, p, _ in R.LINE_FORMATS:
            out = F.when(x.rlike(p), name) if out is None else out.when(x.rlike(p), name)
        return out.otherwise("free")

    clean = clean.withColumn("fmt", rare(line, which))

    def part(k: int, free: Column) -> Column:
        def pick(x: Column) -> Column:
            out = None
            for name, p, groups in R.LINE_FORMATS:
                v = F.regexp_extract(x, p, groups[k]) if groups[k] else F.lit("")
                out = F.when(F.col("fmt") == name, v) if out is None else out.when(F.col("fmt") == name, v)
            return out.otherwise(free)

        return rare(line, pick)

    none = F.lit("")
    out = clean.select("seq", "fmt", "default_host", part(0, none).alias("pri"), part(1, none).alias("timestamp"), part(2, none).alias("h"), part(3, F.lit("syslog")).alias("app"), strip(part(4, line)).alias("message"))
    out = out.where("fmt != 'terminal' or message != ''")
    app = F.when(F.col("fmt") == "terminal", "scrt-session").otherwise(F.col("app"))
    return out.select("seq", "fmt", "timestamp", F.when(F.col("h") != "", F.col("h")).otherwise(F.col("default_host")).alias("hostname"), app.alias("appname"), F.coalesce(severity_of_pri(F.when(F.col("pri") != "", F.col("pri"))), F.lit("info")).alias("severity_raw"), "message")


def parse_routing(lines: DataFrame) -> DataFrame:
    """The LogEvent of each line of a routing daemon's log: program in lower case, ISO time, severity hinted by words."""
    text = F.regexp_replace("line", r"\s+$", "")
    rows = lines.select("seq", F.coalesce("default_host", F.lit("")).alias("hostname"), text.alias("line")).where("line != ''")
    hit = F.col("line").rlike(R.ROUTING_LINE)
    g = lambda k: F.regexp_extract("line", R.ROUTING_LINE, k)
    rows = rows.select("seq", "hostname", F.when(hit, F.regexp_replace(F.regexp_replace(g(1), r"\s+", "T"), "/", "-")).otherwise("").alias("timestamp"), F.when(hit, F.lower(g(2))).otherwise("frr").alias("appname"), strip(F.when(hit, g(4)).otherwise(F.col("line"))).alias("message"))
    hint = None
    for p, s in R.HINTS:
        hint = F.when(F.col("message").rlike(p), s) if hint is None else hint.when(F.col("message").rlike(p), s)
    return rows.select("seq", "timestamp", "hostname", "appname", hint.otherwise("info").alias("severity_raw"), "message")
