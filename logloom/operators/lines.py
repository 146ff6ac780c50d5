"""Physical log lines of many programs as logical entries.

Every line is collapsed to a signature of its character classes. Each distinct signature is resolved to an extraction rule
once; the resolved signatures go back to the lines (broadcast while their size is small, shuffled otherwise). A signature
keeps its first DEPTH symbols; where it begins like a frame that may end behind them, the rule is chosen by the signature of
the whole line. Lines that begin with a stamp in no known frame open an entry under a rule for stamped lines in general.
Lines whose signature opens no entry belong to the entry before them in their stream.

Streams are cut into blocks of sequence numbers. A block looks for its entries alone and hands on the one that is open at
its end, so a stream that holds a third of all lines is work for many tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.hosts import BLANKS, host
from logloom.functions.session import sized
from logloom.functions.stamps import MONTHS, rare

#: Symbols of a signature: the frame of a line stands at its head, free text behind it. HEADS below tell which may be longer.
DEPTH = 48
#: Sequence numbers in a block.
BLOCK = 65_536

#: Severities in order of urgency; names that programs print, in lower case, and the severity each means.
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
SPELLINGS = {
    "emerg": ("emergency", "emergencies", "panic"),
    "alert": ("alerts",),
    "crit": ("critical", "fatal", "f"),
    "err": ("error", "errors", "severe", "e"),
    "warning": ("warn", "warnings", "w"),
    "notice": ("notification", "notifications"),
    "info": ("informational", "information", "config", "i"),
    "debug": ("debugging", "trace", "fine", "finer", "finest", "verbose", "d"),
}

#: Shapes of stamps that open a line, as signature and as text.
STAMP_SHAPES = (r"0-0-0[a ]0:0:0", r"0/0/0[a ]0:0:0", r"a 0( 0)? 0:0:0", r"a,? (a 0|0 a 0) 0:0:0( a)? ?0?", r"0-a-0 0:0:0", r"0/a/0:0:0:0", r"0a0[a+-]")
STAMP_TEXT = r"\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?: ?(?:Z|[+-]\d\d:?\d\d))?|\d{1,2}/\d{1,2}/\d{4},? \d{1,2}:\d\d:\d\d(?:[.,]\d+)?(?: [AaPp][Mm])?|(?:[A-Z][a-z]{2},? )?[A-Z][a-z]{2} {1,2}\d{1,2}(?: \d{4})? \d\d:\d\d:\d\d(?:[.,]\d+)?(?: [A-Z]{2,5}(?= \d{4}))?(?: \d{4})?|(?:[A-Z][a-z]{2}, )?\d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d(?: [+-]\d{4})?|\d{1,2}-[A-Z][a-z]{2}-\d{4} \d\d:\d\d:\d\d(?:[.,]\d+)?|\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d(?: [+-]\d{4})?|\d{8}T\d{6}(?:[.,]\d+)?(?:Z|[+-]\d{4})"
WORDS = "|".join(sorted({w for name, spelt in SPELLINGS.items() for w in (name, *spelt) if len(w) > 1} | {"notice", "err", "debug", "info", "warning"}, key=lambda w: (-len(w), w)))

#: For each rule the pattern of a signature that opens an entry, and the pattern of the line itself.
RULES = (
    ("rfc5424", r"^<0>0 (-|0-0-0a)", r"^<(?<pri>\d{1,3})>\d{1,2} (?<ts>\S+) (?<host>\S+) (?<app>\S+) \S+ \S+ (?:-|(?:\[(?:[^\]\\]|\\.)*\])+) ?(?<msg>[\s\S]*)$"),
    ("rfc3164", r"^(<0>)?a 0 0:0:0(\.0)? [^ ]+ [^ :\[]+(\[[^\]]*\])?:", rf"^(?:<(?<pri>\d{{1,3}})>)?(?<ts>(?:{'|'.join(MONTHS[i : i + 3] for i in range(0, 36, 3))}) [ \d]?\d \d\d:\d\d:\d\d(?:\.\d+)?) (?<host>\S+) (?<app>[^\s:\[]+)(?:\[[^\]]*\])?: ?(?<msg>[\s\S]*)$"),
    ("terminal", r"^0:0:0(\.0)? ?§", r"^(?<ts>\d{1,2}:\d\d:\d\d(?:\.\d+)?) ?§ ?(?<msg>[\s\S]*)$"),
    ("routing", r"^0/0/0 0:0:0(\.0)? (a: )?a: ", r"^(?<ts>\d{4}/\d\d/\d\d \d\d:\d\d:\d\d(?:\.\d+)?) (?:(?<sev>[a-z]+): )?(?<app>\w+): (?:\[[\w-]+\] )?(?<msg>[\s\S]*)$"),
    ("python", r"^0-0-0 0:0:0,0 a [^ ]+: ", r"^(?<ts>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+) (?<sev>[A-Za-z]+) (?<app>\S+): (?<msg>[\s\S]*)$"),
    ("glog", r"^a0 0:0:0\.0 0 [^ ]+:0\]", r"^(?<sev>[IWEFD])(?<ts>\d{4} \d\d:\d\d:\d\d\.\d+) +\d+ (?<app>[^\s:]+):\d+\] ?(?<msg>[\s\S]*)$"),
    ("pairs", r'^(a=("[^"]*"|[^ "]*) )*a="?0-0-0[a ]0:0:0[^" ]*"?( a=|$)', r'^(?=[\s\S]*\bmsg=)(?:\w+=(?:"(?:[^"\\]|\\.)*"|[^\s"]*) )*?(?:time|ts)="?(?<ts>\d[^"\s]*(?: [\d:.,+-]+)?)"?(?= |$)(?<msg>[\s\S]*)$'),
    ("json", r'^\{ ?("a|$)', r"^(?<msg>\{[\s\S]*)$"),
    ("table", r"^0-0-0(a| )0:0:0[^|]*\| a \| [^ |]+ \| ", r"^(?<ts>\d{4}-\d\d-\d\d[T ][^|]*?) \| (?<sev>[A-Za-z]+) +\| (?<app>[^\s|]+) +\| ?(?<msg>[\s\S]*)$"),
    ("httpd", r"^\[a a 0 0:0:0(\.0)? 0\] \[a:a0?\]", r"^\[(?<ts>\w{3} \w{3} \d\d \d\d:\d\d:\d\d(?:\.\d+)? \d{4})\] \[(?<app>\w+):(?<sev>[a-z]+)\d?\] (?:\[pid [^\]]*\] )?(?<msg>[\s\S]*)$"),
    ("servlet", r"^0-a-0 0:0:0\.0 a \[[^\]]*\] [^ ]+ ", r"^(?<ts>\d\d-[A-Z][a-z]{2}-\d{4} \d\d:\d\d:\d\d\.\d+) (?<sev>[A-Z]+) \[[^\]]*\] (?<app>\S+) (?<msg>[\s\S]*)$"),
    ("access", r'^[^ ]+ [^ ]+ [^ ]+ \[0/a/0:0:0:0 [+-]0\] ', r"^(?<host>\S+) \S+ \S+ \[(?<ts>[^\]]+)\] (?<msg>[\s\S]*)$"),
    ("stamped", rf"^(<0>)?0? ?\[?({'|'.join(STAMP_SHAPES)})", rf"^(?:<(?<pri>\d{{1,3}})>)?(?:\d )?\[?(?<ts>{STAMP_TEXT})\]?[ ,:]*(?:\[?(?<sev>(?i:{WORDS}))\]?:? +)?(?:(?:\[[^\]]*\] )*(?:[\w.-]+ )?(?<app>[A-Za-z_][\w./$-]*)(?:\[[^\]]*\])?(?::| -) )?(?<msg>[\s\S]*)$"),
)
#: How signatures begin whose frame may be longer than DEPTH, besides those of stamped lines.
HEADS = r"^(a0 0:0:0|a=|[^ ]+ [^ ]+ [^ ]+ \[|[^ ]{16})"
#: The keys that hold severity and origin in key-value and JSON entries.
SEVERITY_KEYS, APP_KEYS = "level|lvl|severity", "app|logger|component"


def shape(line: Column) -> Column:
    """Letters as a, digits as 0, blanks as one blank; runs collapsed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, "[A-Za-z]+", "a"), r"\d+", "0"), r"\s+", " ")


def signature(line: Column) -> Column:
    """The first DEPTH symbols of a line's shape."""
    return F.substring(shape(line), 1, DEPTH)


def severity(word: Column) -> Column:
    """One of SEVERITIES from any spelling; null for an unknown word."""
    names = {w: name for name, spelt in SPELLINGS.items() for w in (name, *spelt)} | {n: n for n in SEVERITIES}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(word))


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _groups(pattern: str) -> dict[str, int]:
    names, n = {}, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((\?<(\w+)>|\?i?[:=!]|)", pattern):
        if m[0].startswith("(") and (m[2] or not m[1]):
            n += 1
            if m[2]:
                names[m[2]] = n
    return names


DEEP = "deep"


def _by_rule(line: Column, rule: Column, group: str, others: dict[str, Column]) -> Column:
    out = None
    for name, _, pattern in RULES:
        at = _groups(pattern).get(group)
        v = others.get(name) if name in others else (F.regexp_extract(line, pattern, at) if at else None)
        if v is not None:
            out = F.when(rule == name, v) if out is None else out.when(rule == name, v)
    return _some(out)


def _key(line: Column, keys: str) -> Column:
    return _some(F.regexp_extract(line, rf'"(?:{keys})"\s*:\s*"((?:[^"\\]|\\.)*)"', 1))


def _opens(line: Column, rule: Column) -> Column:
    out = None
    for name, _, pattern in RULES:
        out = F.when(rule == name, line.rlike(pattern)) if out is None else out.when(rule == name, line.rlike(pattern))
    return F.coalesce(out, F.lit(False))


def _resolve(sig: Column) -> Column:
    out = None
    for name, pattern, _ in RULES:
        out = F.when(sig.rlike(pattern), name) if out is None else out.when(sig.rlike(pattern), name)
    return out


def rules_of(lines: DataFrame) -> DataFrame:
    """(sig, rule) for each distinct signature of lines.line that opens an entry; rule DEEP where its rest has to tell."""
    sigs = lines.where("line is not null").select(signature(F.col("line")).alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    named = sigs.select("sig", rare(F.col("sig"), _resolve).alias("rule"))
    cut = (F.length("sig") == DEPTH) & ((F.col("rule") == "stamped") | (F.col("rule").isNull() & F.col("sig").rlike(HEADS)))
    return named.withColumn("rule", F.when(cut, DEEP).otherwise(F.col("rule"))).where("rule is not null")


def opened(lines: DataFrame) -> DataFrame:
    """lines(src_table, stream, seq, line), cleaned, with rule and opens: whether the line opens an entry."""
    clean = lines.select("src_table", F.coalesce("stream", F.lit("")).alias("stream"), "seq", F.regexp_replace(F.regexp_replace("line", r"^\ufeff", ""), r"\r+$", "").alias("line"))
    rules = sized(rules_of(clean), "line-rules")
    found = clean.withColumn("sig", signature(F.col("line"))).join(rules, "sig", "left")
    line, rule = F.col("line"), F.col("rule")
    found = found.withColumn("rule", F.when(rule == DEEP, rare(line, lambda x: _resolve(shape(x)))).otherwise(rule))
    return found.withColumn("opens", F.when(rule.isNull(), False).otherwise(rare(line, lambda x: _opens(x, rule))))


def marked(found: DataFrame) -> DataFrame:
    """opened() with blank and, for lines that open an entry, rule and head(ts, sev, app, msg)."""
    line, rule = F.col("line"), F.col("rule")

    def fields(x: Column) -> Column:
        pri = _by_rule(x, rule, "pri", {}).try_cast("int")
        tag = F.regexp_extract(x, r": %[A-Za-z]\w*-([0-7])-\w+: ", 1).try_cast("int")
        named = F.try_element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce(pri, F.when(rule == "rfc3164", tag)).bitwiseAND(7) + 1)
        word = _by_rule(x, rule, "sev", {"pairs": F.regexp_extract(x, rf'(?:^|\s)(?:{SEVERITY_KEYS})="?(\w+)', 1), "json": _key(x, SEVERITY_KEYS)})
        app = _by_rule(x, rule, "app", {"pairs": F.regexp_extract(x, rf'(?:^|\s)(?:{APP_KEYS})="?([^\s"]+)', 1), "json": _key(x, APP_KEYS), "terminal": F.lit("scrt-session")})
        return F.struct(
            F.when(rule == "json", _key(x, "ts|time|timestamp")).otherwise(_by_rule(x, rule, "ts", {})).alias("ts"),
            F.coalesce(named, severity(word)).alias("sev"),
            F.when(app != "-", app).alias("app"),
            F.when(rule == "pairs", F.regexp_extract(x, r'\bmsg="((?:[^"\\]|\\.)*)"', 1)).when(rule == "json", _key(x, "msg|message")).otherwise(_by_rule(x, rule, "msg", {})).alias("msg"),
        )

    def inner(x: Column) -> Column:
        return F.struct(_key(x, "ts|time|timestamp").alias("ts"), severity(_key(x, SEVERITY_KEYS)).alias("sev"), _key(x, APP_KEYS).alias("app"), _key(x, "msg|message").alias("msg"))

    # A line inside an entry may be a field of a JSON entry that spans lines; whether it is one shows when entries are whole.
    head = F.when(F.col("opens"), rare(line, fields)).when(line.rlike(r'^\s*"\w+"\s*:\s*"'), rare(line, inner))
    blank = F.coalesce(F.btrim(line, F.lit(BLANKS)) == "", F.lit(True))
    row = F.struct("src_table", "stream", "block", "seq", "line", blank.alias("blank"), F.when(F.col("opens"), rule).alias("rule"), head.alias("head"))
    return found.select(F.inline_outer(F.array(row)))


def entries(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per logical entry of lines(src_table, stream, seq, line):
    src_table, stream, first_seq, last_seq, timestamp, severity_raw, appname, message, rule, text.

    Null and blank lines end no entry and are not its last row; lines before the first entry of a stream belong to none;
    a null stream is the stream ''. Repeated sequence numbers keep the order in which their lines open entries last.
    severity_raw is info where the entry states none, appname null. text holds all lines of an entry and is as large as
    the entry is; message is the text behind the frame of its first line and the lines after it (of a JSON entry its
    message, and the lines behind its end). Both cost nothing where they aren't selected. Further columns are ignored."""
    found = opened(lines).withColumn("block", F.floor(F.col("seq") / block))
    rows = marked(found)
    here = Window.partitionBy("src_table", "stream", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    at_open = F.when(F.col("rule").isNotNull(), F.col("seq"))
    rows = rows.withColumn("first_seq", F.last(at_open, ignorenulls=True).over(here))
    at = lambda name: F.min(F.when(F.col(f"head.{name}").isNotNull(), F.struct("seq", F.col(f"head.{name}").alias("v")))).alias(name)
    own = F.first(F.when(F.col("rule").isNotNull(), F.struct("rule", "head")), ignorenulls=True).alias("own")
    text = F.collect_list(F.struct("seq", F.coalesce("line", F.lit("")).alias("line"))).alias("lines")
    parts = rows.groupBy("src_table", "stream", "block", "first_seq").agg(F.max(F.when(~F.col("blank"), F.col("seq"))).alias("last_seq"), own, *map(at, ("ts", "sev", "app", "msg")), text)
    over = Window.partitionBy("src_table", "stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # From the lines, not from the parts: a row per block leaves each task, and no field is read for it.
    ends = found.groupBy("src_table", "stream", "block").agg(F.max(F.when(F.col("opens"), F.col("seq"))).alias("open_end"))
    ends = ends.select("src_table", "stream", "block", F.last("open_end", ignorenulls=True).over(over).alias("carried"))
    parts = parts.join(ends, ["src_table", "stream", "block"]).withColumn("first_seq", F.coalesce("first_seq", "carried")).where("first_seq is not null")
    least = lambda name: F.min(name).alias(name)
    text = F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines")
    whole = parts.groupBy("src_table", "stream", "first_seq").agg(F.max("last_seq").alias("last_seq"), F.first("own", ignorenulls=True).alias("own"), *map(least, ("ts", "sev", "app", "msg")), text)
    json = F.col("own.rule") == "json"
    pick = lambda name: F.when(json, F.coalesce(F.col(f"own.head.{name}"), F.col(f"{name}.v"))).otherwise(F.col(f"own.head.{name}"))
    texts = F.transform(F.filter("lines", lambda r: r["seq"] <= F.col("last_seq")), lambda r: r["line"])
    after = F.slice(texts, 2, F.greatest(F.size(texts), F.lit(1)))
    # A JSON entry ends at the brace that stands alone at the begin of a line, or on its first line.
    end = F.when(F.element_at(texts, 1).rlike(r"\}\s*$"), 0).otherwise(F.array_position(F.transform(after, lambda x: x.rlike(r"^\}\s*$")), True))
    after = F.when(json & (end == 0) & ~F.element_at(texts, 1).rlike(r"\}\s*$"), F.array().cast("array<string>")).when(json, F.slice(after, end + 1, F.greatest(F.size(after), F.lit(1)))).otherwise(after)
    told = F.when(json, F.coalesce(F.col("msg.v"), F.col("own.head.msg"))).otherwise(F.col("own.head.msg"))
    return whole.select(
        "src_table", "stream", "first_seq", "last_seq", pick("ts").alias("timestamp"), F.coalesce(pick("sev"), F.lit("info")).alias("severity_raw"), pick("app").alias("appname"), F.array_join(F.concat(F.array(F.coalesce(told, F.lit(""))), after), "\n").alias("message"), F.col("own.rule").alias("rule"), F.array_join(texts, "\n").alias("text")
    )


def sources(raw_line: DataFrame, log_event: DataFrame) -> DataFrame:
    """The lines of raw_line, by stream, and of the unsplit rows of log_event, by host."""
    raw = raw_line.select(F.lit("raw_line").alias("src_table"), "stream", "seq", "line")
    unsplit = log_event.where("appname = 'syslog' and timestamp = ''").select(F.lit("log_event").alias("src_table"), F.coalesce(host("hostname"), F.lit("")).alias("stream"), "seq", F.col("message").alias("line"))
    return raw.unionByName(unsplit)
