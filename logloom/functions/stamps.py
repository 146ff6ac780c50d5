"""Printed timestamps as Column expressions, all inside the JVM.

A stamp is rewritten by the one pattern that fits to `layout|Y|M|D|time|zone|AM/PM`; absent parts stay empty. Dates and
times are checked by Spark's own parser of timestamps. What few rows need stands inside higher-order functions: generated
code stays below the size that the JVM still compiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US_DAY = 86_400_000_000
US_HOUR = 3_600_000_000

#: The layouts in which stamps are printed, each with the order of its groups.
LAYOUTS = (
    ("iso", r"^(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d:\d\d:\d\d)(?:[.,](\d+))? ?([Zz]|[+-]\d\d:?\d\d)?(?:\[[^\]]*\])?$", "$1|$2|$3|$4.$5|$6|"),
    ("minute", r"^(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d:\d\d) ?([Zz]|[+-]\d\d:?\d\d)?$", "$1|$2|$3|$4:00|$5|"),
    ("month", r"^[.*]?(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? )?([A-Z][a-z]{2}) {1,2}(\d{1,2})(?: (\d{4}))? (\d\d:\d\d:\d\d)(?:\.(\d+))?(?: ([A-Za-z]{1,5}|[+-]\d\d:?\d\d))?$", "$3|$1|$2|$4.$5|$6|"),
    ("ctime", r"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? )?([A-Z][a-z]{2}) {1,2}(\d{1,2}) (\d\d:\d\d:\d\d)(?:\.(\d+))?(?: ([A-Z]{2,5}))? (\d{4})$", "$6|$1|$2|$3.$4|$5|"),
    ("ymd", r"^(\d{4})/(\d\d)/(\d\d)[ T](\d\d:\d\d:\d\d)(?:[.,](\d+))?$", "$1|$2|$3|$4.$5||"),
    ("mdy", r"^(\d{1,2})/(\d{1,2})/(\d{4}),? (\d{1,2}:\d\d:\d\d)(?:\.(\d+))?(?: ([AaPp][Mm]))?$", "$3|$1|$2|$4.$5||$6"),
    ("dmy", r"^(\d{1,2})-([A-Z][a-z]{2})-(\d{4}) (\d\d:\d\d:\d\d)(?:\.(\d+))?$", "$3|$2|$1|$4.$5||"),
    ("mail", r"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d\d:\d\d:\d\d) ([+-]\d\d:?\d\d|[A-Z]{1,5})$", "$3|$2|$1|$4|$5|"),
    ("clf", r"^\[?(\d{1,2})/([A-Z][a-z]{2})/(\d{4}):(\d\d:\d\d:\d\d) ([+-]\d\d:?\d\d)\]?$", "$3|$2|$1|$4|$5|"),
    ("basic", r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(?:[.,](\d+))?([Zz]|[+-]\d\d:?\d\d)?$", "$1|$2|$3|$4:$5:$6.$7|$8|"),
    ("clock", r"^(\d{1,2}:\d\d:\d\d)(?:\.(\d+))?$", "|||$1.$2||"),
    ("epoch", r"^(\d{9,19})(?:\.(\d+))?$", "|||$1.$2||"),
)
EPOCH = dict((n, p) for n, p, _ in LAYOUTS)["epoch"]
PLAIN_UTC = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?Z$"
#: Month names, and zone names that mean the same everywhere.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
UNIVERSAL = ("Z", "z", "UTC", "GMT", "UT")


def rare(c: Column, f) -> Column:
    """f(c), evaluated outside the generated code."""
    return F.transform(F.array(c), f)[0]


def split_parts(t: Column) -> Column:
    """[layout, Y, M, D, time, zone, AM/PM] of t, or null for a text in none of LAYOUTS."""

    def tagged(x: Column, entry: tuple) -> Column:
        return F.concat(F.lit(entry[0] + "|"), F.regexp_replace(x, entry[1], entry[2]))

    def others(x: Column) -> Column:
        out = None
        for e in LAYOUTS[1:]:
            out = F.when(x.rlike(e[1]), tagged(x, e)) if out is None else out.when(x.rlike(e[1]), tagged(x, e))
        return out

    first = LAYOUTS[0]
    return F.split(F.when(t.rlike(first[1]), tagged(t, first)).otherwise(rare(t, others)), r"\|", -1)


def utc_us(y: Column, m: Column, d: Column, time: Column) -> Column:
    """Microseconds of a date and a time read as UTC; null where there's no such date or time. Finer digits are cut off."""
    month = F.when(F.length(m) < 3, m).otherwise(((F.position(m, F.lit(MONTHS)) + 2) / 3).cast("int").cast("string"))
    return F.unix_micros(F.concat(y, F.lit("-"), month, F.lit("-"), d, F.lit("T"), time, F.lit("Z")).try_cast("timestamp"))


def offset_at(us: Column, zone: Column) -> Column:
    """Microseconds that zone is ahead of UTC at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) - us


def fixed_offset_us(c: Column) -> Column:
    """Microseconds from +hh:mm, +hhmm or a universal name, else null."""
    digits = F.translate(c, ":", "")
    v = (F.substring(digits, 2, 2).try_cast("bigint") * 60 + F.substring(digits, 4, 2).try_cast("bigint")) * 60_000_000
    return F.when(c.isin(*UNIVERSAL), F.lit(0).cast("bigint")).when(c.startswith("+"), v).when(c.startswith("-"), -v)


def from_local(local_us: Column, zone: Column, seen_us: Column) -> Column:
    """The instant of a wall clock reading.

    A reading that occurs twice means the latest instant that isn't after seen_us, the first where both are; one that a
    clock change skips is read with the offset before the change."""
    a = local_us - offset_at(local_us - US_DAY, zone)
    b = local_us - offset_at(local_us + US_DAY, zone)
    fits_a, fits_b = a + offset_at(a, zone) == local_us, b + offset_at(b, zone) == local_us
    late, early = F.greatest(a, b), F.least(a, b)
    return F.when(a == b, a).otherwise(F.when(fits_a & fits_b, F.when(late <= seen_us, late).otherwise(early)).when(fits_b, b).otherwise(a))


def from_abbreviation(local_us: Column, offsets: Column, zone: Column, seen_us: Column) -> Column:
    """The instant of a wall clock reading with a zone abbreviation; offsets are those that it stands for in the zone."""
    xs = F.transform(offsets, lambda o: local_us - o * 1_000_000)
    fitting = F.filter(xs, lambda x: x + offset_at(x, zone) == local_us)
    best = F.when(F.size(fitting) > 0, fitting).otherwise(xs)
    return F.coalesce(F.array_max(F.filter(best, lambda x: x <= seen_us)), F.array_min(best))


def with_instant(df: DataFrame, out: str, parts: str = "parts", zone: str = "zone", abbr: str = "abbr", seen: str = "seen_us") -> DataFrame:
    """df with out: microseconds since 1970 of the parts of a stamp that isn't an epoch, or null.

    zone and abbr are those of the host. Without a date the latest day, without a year the latest year is meant that
    doesn't lead beyond seen. Steps are columns of their own: each is used several times by the next one, and an
    expression that held all of them would be evaluated again and again."""
    p, seen_us, z = F.col(parts), F.col(seen), F.col(zone)
    steps = [f"_{out}_{k}" for k in ("off", "shift", "local", "near", "far")]
    off, shift, local, near, far = map(F.col, steps)
    y, m, d, time, named, half = (p[i] for i in range(1, 7))

    def half_day(x: Column) -> Column:
        hour = F.substring_index(x, ":", 1).cast("int")
        pm = F.lower(half) == "pm"
        return F.when((hour >= 1) & (hour <= 12), F.when(pm & (hour < 12), 12).when(~pm & (hour == 12), -12).otherwise(0) * F.lit(US_HOUR))

    df = df.withColumns({steps[0]: fixed_offset_us(named), steps[1]: F.when(half != "", rare(time, half_day)).otherwise(F.lit(0).cast("bigint"))})
    df = df.withColumn(steps[2], F.when(y != "", utc_us(y, m, d, time) + shift))
    df = df.withColumn(steps[3], F.when((named == "") & local.isNotNull(), local - offset_at(local - US_DAY, z)))
    df = df.withColumn(steps[4], F.when(near.isNotNull(), local - offset_at(local + US_DAY, z)))

    def anywhere(x: Column) -> Column:
        return F.when(off.isNotNull(), x - off).when(named == "", from_local(x, z, seen_us)).otherwise(from_abbreviation(x, F.try_element_at(F.col(abbr), named), z, seen_us))

    def undated(t: Column) -> Column:
        today = F.date_from_unix_date(F.floor(seen_us / US_DAY).cast("int"))
        years = F.transform(F.when((d.try_cast("int") == 29), F.sequence(F.lit(1), F.lit(-9))).otherwise(F.sequence(F.lit(1), F.lit(-1))), lambda k: utc_us((F.year(today) + k).cast("string"), m, d, t))
        days = F.transform(F.sequence(F.lit(1), F.lit(-2)), lambda k: F.unix_micros(F.concat(F.date_from_unix_date((F.floor(seen_us / US_DAY) + k).cast("int")).cast("string"), F.lit("T"), t, F.lit("Z")).try_cast("timestamp")))
        many = F.when(d != "", years).otherwise(days)
        return F.array_max(F.filter(F.transform(F.filter(many, lambda x: x.isNotNull()), anywhere), lambda x: x <= seen_us))

    dated = F.when(off.isNotNull(), local - off).when(near == far, near).otherwise(rare(local, anywhere))
    unclear = F.when((y == "") & (p[0] != "epoch"), rare(time, undated))
    return df.withColumn(out, F.when(local.isNotNull(), dated).otherwise(unclear)).drop(*steps)
