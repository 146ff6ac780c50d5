"""Secrets, public addresses and names masked in texts, by rules that build on each other."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import config_rules as R
from logloom.functions.session import once

SALT = "logloom"
#: Names in configurations - rule, pattern and what replaces it; a name in group 2 becomes a token.
NAMES = (
    ("user-block", r"(?i)\b(user)\s+([a-z][\w.\-]{1,40})(\s*\{)", "token"),
    ("username", r"(?i)\b(username)\s+([a-z][\w.\-]{1,40})(\b)", "token"),
    ("key-comment", r"(<REDACTED-SSH-KEY>)[ \t]+[^\n\"';]*", "$1"),
    ("full-name", r"(?i)\b(full-name)\s+\"[^\"]+\"", '$1 "<REDACTED-NAME>"'),
)
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def token(c: Column, salt: str = SALT) -> Column:
    """Eight hexadecimal digits: the same text, the same token."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), c), 256), 1, 8)


def sanitize(texts: DataFrame, rules: tuple = R.SECRETS) -> DataFrame:
    """id, text, n, by_rule MAP of texts(id, text): every rule applied to what the one before left. A null text stays null."""
    out = texts.select("id", F.col("text").alias("t0"))
    for i, (_, pattern, replacement) in enumerate(rules):
        # Columns of their own: each text is both counted and rewritten.
        out = out.withColumns({f"n{i}": F.regexp_count(f"t{i}", F.lit(pattern)), f"t{i + 1}": F.regexp_replace(f"t{i}", pattern, re.sub(r"\\(\d)", r"$\1", replacement))})
    n = [F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in range(len(rules))]
    by_rule = F.map_filter(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r[0]), n[i])]), lambda _, v: v > 0)
    total = n[0]
    for x in n[1:]:
        total = total + x
    return out.select("id", F.col(f"t{len(rules)}").alias("text"), total.cast("bigint").alias("n"), by_rule.alias("by_rule"))


def mask_names(texts: DataFrame) -> DataFrame:
    """id, text, n, by_rule MAP of texts(id, text): users as tokens equal for equal names whatever the case, comments of keys
    and full names removed. Meant for what sanitize() left; a null text stays null."""
    out = texts.select("id", F.col("text").alias("t0"))
    for i, (_, pattern, replacement) in enumerate(NAMES):
        n = F.coalesce(F.regexp_count(f"t{i}", F.lit(pattern)), F.lit(0))
        if replacement == "token":
            groups = [F.regexp_extract_all(f"t{i}", F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
            put = F.transform(F.arrays_zip(*groups).cast("array<struct<a: string, b: string, c: string>>"), lambda x: F.concat(x["a"], F.lit(" user-"), token(F.lower(x["b"]), "username"), x["c"]))
            pieces = F.zip_with(F.split(f"t{i}", pattern, -1), F.array_append(put, F.lit("")), lambda p, a: F.concat(p, F.coalesce(a, F.lit(""))))
            new = F.when(F.col(f"n{i}") > 0, F.array_join(pieces, "")).otherwise(F.col(f"t{i}"))
        else:
            new = F.regexp_replace(f"t{i}", pattern, replacement)
        out = once(once(out, **{f"n{i}": n}), **{f"t{i + 1}": new})
    counts = [F.col(f"n{i}") for i in range(len(NAMES))]
    by_rule = F.map_filter(F.create_map(*[x for i, r in enumerate(NAMES) for x in (F.lit(r[0]), counts[i])]), lambda _, v: v > 0)
    return out.select("id", F.col(f"t{len(NAMES)}").alias("text"), (counts[0] + counts[1] + counts[2] + counts[3]).cast("bigint").alias("n"), by_rule.alias("by_rule"))


def sanitize_all(texts: DataFrame, mask_pii: bool = False) -> DataFrame:
    """id, text, n of texts(id, text): secrets out, and with mask_pii names and public addresses too."""
    first = sanitize(texts).select("id", "text", "n")
    if not mask_pii:
        return first
    # The counts of the steps before travel with the id.
    counted = mask_public(mask_names(first.withColumn("id", F.struct("id", "n"))).select(F.struct(F.col("id.id").alias("id"), (F.col("id.n") + F.col("n")).alias("n")).alias("id"), "text"))
    return counted.select(F.col("id.id").alias("id"), "text", (F.col("id.n") + F.col("n")).alias("n"))


def ip_number(c: Column) -> Column:
    """An IPv4 address as a number; null for octets over 255 or with leading zeros."""
    o = F.split(c, r"\.")
    ok = c.rlike(r"^(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})$")
    n = [F.get(o, F.lit(i)).try_cast("bigint") for i in range(4)]
    valid = ok & (F.greatest(*n) <= 255)
    return F.when(valid, ((n[0] * 256 + n[1]) * 256 + n[2]) * 256 + n[3])


def number_of(ip: str) -> int:
    out = 0
    for o in ip.split("."):
        out = out * 256 + int(o)
    return out


def is_public(n: Column) -> Column:
    out = n.isNotNull()
    for a, b in R.NOT_PUBLIC:
        out = out & ~n.between(number_of(a), number_of(b))
    return out


def mask_public(texts: DataFrame, salt: str = SALT) -> DataFrame:
    """id, text, n of texts(id, text): public IPv4 addresses replaced by tokens that are equal for equal addresses."""
    found = F.regexp_extract_all("text", F.lit(IPV4), F.lit(0))
    masked = F.transform("found", lambda a: F.when(is_public(ip_number(a)), F.concat(F.lit("PUB-"), token(a, salt))).otherwise(a))
    rows = texts.select("id", "text", found.alias("found")).withColumn("masked", masked)
    pieces = F.zip_with(F.split("text", IPV4, -1), F.array_append("masked", F.lit("")), lambda p, a: F.concat(p, F.coalesce(a, F.lit(""))))
    n = F.size(F.filter(F.zip_with("found", "masked", lambda a, b: a != b), lambda x: x))
    return rows.select("id", F.when(F.size("found") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))
