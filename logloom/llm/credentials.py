"""Credentials in configurations and scripts: found in every file, and taken out without touching the rest.

1. Every file is scanned with a grammar of places that hold credentials; each hit is a literal with its span.
2. An index over the whole corpus counts the owners (hosts) of each literal. Literals of very many owners are
   placeholders and are suppressed, unless they have a form that no placeholder has (hashes, keys, long random texts).
3. Rare literals with the structure of a secret are confirmed, those of several lines too. A confirmed literal is looked up in
   an index of the runs of letters and digits of all files, by the one of its runs that stands in the fewest; each file that
   shares it is scanned again, whole, with an automaton of the confirmed literals that it may hold. So no node needs all
   secrets, a secret in a comment or under an unknown key is found as well, and no file that the automaton would accept is
   left out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.hosts import host
from logloom.functions.session import sized, stored

#: Owners from which, with SHARE of all owners, a literal counts as a placeholder.
OWNERS, SHARE = 12, 0.02
#: Least length of a literal that is searched for outside the places of the grammar.
LEAST = 6
#: What such a literal looks like - letters with digits, signs or changing case, or many digits - and what no
#: placeholder looks like, however many owners share it: hashed and encrypted values, key blocks, tokens, long random texts.
STRUCTURED = r"[A-Za-z].*[0-9!-/:-@\[-`{-~]|[0-9!-/:-@\[-`{-~].*[A-Za-z]|[0-9]{8}|[a-z][A-Z]|[A-Z]{2}[a-z]"
UNMISTAKABLE = r"^\$\w{1,2}\$.{6}|^-----BEGIN|^eyJ[\w-]+\.|^[0-9a-fA-F]{16,}$|^(?=[^\s]{14,}$)(?=.*[0-9].*[0-9])(?=.*[a-z].*[a-z])(?=.*[A-Z].*[A-Z])"
REDACTED = "<REDACTED>"

#: A value, quoted or bare, and the places that hold one. Group 1, 2, ... of a place are values.
V = r"""("[^"\n]*"|'[^'\n]*'|[^\s"';,][^\s;,]*)"""
BARE = r"""("[^"\n]*"|'[^'\n]*'|[^\s"';]+)"""
HASH = r"(?:(?:\d{1,2}|sha512|sha256|md5|clear|text|plain|encrypted|cipher) )?"
PLACES = (
    rf"\bsnmp-server community {BARE}",
    rf"\bsnmp-server host \S+ (?:traps |informs )?version (?:1|2c) {BARE}",
    rf"\bsnmp-server user \S.*? auth \S+ {BARE}(?: priv (?:aes|des|3des)(?: ?\d{{3}})? {BARE})?",
    rf"^\s*set snmp community {BARE}",
    rf"^\s*community {BARE} \{{",
    rf"\bcommunity-entry \S+ community {BARE}",
    rf"\benable (?:secret|password) (?:level \d+ )?{HASH}{BARE}",
    rf"\busername \S+ (?:.*? )?(?:secret|password) {HASH}{BARE}",
    rf"^\s*password {HASH}{BARE}\s*$",
    rf"\b(?:neighbor|peer|peer-group) \S+ password {HASH}{BARE}",
    rf"\b(?:radius|tacacs)-server (?:.*? )?key {HASH}{BARE}",
    rf"\bmessage-digest-key \d+ md5 {HASH}{BARE}",
    rf"\bntp authentication-key \d+ \S+ {HASH}{BARE}",
    rf"\b(?<!ntp )authentication-key (?!\d+ (?:md5|sha))(?:[0-9] )?{BARE}",
    rf"\bkey-string {HASH}{BARE}",
    r"^\s*key [0-9a-fA-F]{4,64} (?:7|8|9) (\S+)",
    rf"\b(?:area|domain)-password {HASH}{BARE}",
    rf"\bisis password {HASH}{BARE}",
    rf"\b(?:auth-password|secret-key|simple-password|encrypted-password|shared-secret) {HASH}{BARE}",
    rf"\bauthentication (?:user \S+|admin-user) password {BARE}",
    rf"\bpre-shared-key (?:ascii-text |hexadecimal |local |remote )?{BARE}",
    rf"\bmd5 \d+ key {BARE}",
    rf"""(?:\d|server|host \S+) secret ("[^"\n]+"|'[^'\n]+'|[0-9] \S+)""",
    rf"""(?i)(?<![\w$])["']?[\w.-]*(?:passw(?:or)?d|passphrase|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth[_-]?key|encryption[_-]?key|credentials?|(?:^|[_-])pw|(?:^|[_-])pwd|(?:^|[_-])pass|(?<![\w])pass)["']?\s*(?::=|=>|[:=])\s*(?:(?:basic|bearer|token)\s+)?{V}""",
    r"(?i)\bauth\w*[\"']?\s*[:=]\s*[\"']?(?:basic|bearer|token|apikey)\s+([^\s\"']{6,})",
    r"\b[a-z][a-z0-9+.-]*://[^\s:/@'\"]*:([^\s@/'\"]+)@",
    r"(?i)[?&](?:api_?key|apikey|access_?key|access_token|auth_token|token|sig|signature|secret|key|password|passwd|pwd)=([^\s&'\"]+)",
    rf"\bsshpass -p ?{BARE}",
    rf"\bsnmp\w+ .*?-A {BARE}(?:.*? -X {BARE})?",
    r"\bcurl .*?(?:-u|--user) [\"']?[^\s:\"']+:([^\s\"']+)",
    rf"--(?:password|passwd|token|secret|api-key)[ =]{BARE}",
    rf"(?i)^\s*(?:[!#;]|//|--).*\b(?:password|passphrase|passwd|pw|pwd|psk|secret|community|token|api key)(?: (?:was|is|now))?:? {BARE}\s*$",
    rf"(?i)^\s*(?:[!#;]|//|--).*\b(?:login|credentials?)\b.*[: ]\S+ / {BARE}\s*$",
)
#: For each place in order, texts of which a line must hold one; in lower case where the place doesn't mind the case.
NEEDS = (
    ("snmp-server community",), ("snmp-server host",), ("snmp-server user",), ("snmp community",), ("community",), ("community-entry",), ("enable ",), ("username",), ("password",), (" password",), ("-server ",), ("message-digest-key",), ("ntp authentication-key",), ("authentication-key",), ("key-string",), ("key ",),
    ("-password",), ("isis password",), ("auth-password", "secret-key", "simple-password", "encrypted-password", "shared-secret"), ("authentication ",), ("pre-shared-key",), ("md5 ",), (" secret ",), ("pass", "secret", "token", "key", "credential", "pw"), ("auth",), ("://",), ("?", "&"), ("sshpass",), ("snmp",), ("curl",), ("--",),
    ("pass", "pw", "psk", "secret", "community", "token", "api key"), ("login", "credential"),
)
#: Every place holds one of these; lines without any aren't searched for places.
SIGN = r"(?i)pass|secret|token|key|communit|auth|snmp|curl|login|credential|pw|psk|://|[?&]sig"
BLOCK_KEY = r"""(?i)^(\s*)["']?[\w.-]*(?:passw(?:or)?d|passphrase|secret|token|api[_-]?key|private[_-]?key)["']?:\s*[|>][+-]?\s*$"""
BEGIN = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
END = r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
#: What stands for a credential without being one - masks, references, calls, settings.
NOTHING = r"""(?ix)^(?:
    | <[^>]*> | \*+ | x{3,} | \.{3,} | _+ | -+ | n/a | none | null | nil | true | false | yes | no | todo | tbd
    | change[-_]?me\S* | redacted | removed | hidden | masked | example\S* | placeholder\S* | your[-_]\S* | dummy
    | \{\{.*  | .*\}\} | \$\{.* | \$\(.* | \$[a-z_][a-z0-9_]*(?:/.*)? | %[({].* | %[a-z_]+%? | @\w+@
    | \w+(?:\.\w+)*[(\[].* | (?:vault|env|ssm|secretsmanager|file|keyring|kms|op)(?::|//|/).* | os\.\S* | process\.env\S* | /\S*
    | \{ | \} | \[.* | minimum-\w+ | required | chain | lives | length | format | encryption | authentication | [><|&]\S*
)$"""
#: Letters and digits from which on a run of a literal is looked up by itself.
RUN = 6
#: Runs of letters and digits; neighbouring shorter runs with what stands between. Where the automaton accepts a literal, each of
#: its runs is a whole run of the text, as a letter or digit beside the literal's own would be refused.
RUNS = r"([A-Za-z0-9]+)"
PAIRS = rf"(?<![A-Za-z0-9])(?=([A-Za-z0-9]{{1,{RUN - 1}}}[^A-Za-z0-9\n]+[A-Za-z0-9]{{1,{RUN - 1}}})(?![A-Za-z0-9]))"


#: What stands before and after quoted words that are a prompt, a message or a part of an expression.
TALK = re.compile(r"(?i)prompt|getpass|input\s*\(|\bread\s+-|\bprint|\becho\b|\blog\w*\.|\bexpect\b|\b(?:raise|die|warn|error)\w*\W")
JOINED = re.compile(r"\s*(?:[+%&]|\.\w)")
COMMENT = r"(?i)^\s*(?:[!#;]|//|--)"


def phrase(line: str, a: int, b: int) -> bool:
    """Whether the quoted words line[a:b] are a value: not what stands between two strings, not joined on, not said to anyone."""
    mark = line[a - 1]
    opened = (line.count(mark, 0, a - 1) - line.count("\\" + mark, 0, a - 1)) % 2 == 0
    return opened and not JOINED.match(line, b + 1) and not TALK.search(line, 0, a - 1) and not line[a:b].rstrip().endswith((":", "?", ">"))


def scan(text: str, places: list[tuple[re.Pattern, tuple[str, ...], bool]], nothing: re.Pattern, begin: re.Pattern, end: re.Pattern, block: re.Pattern) -> list[tuple[int, int, int, int, str]]:
    """(first line, last line, start, end, literal) of every place of a credential in a text; lines count from 1."""
    found, at, lines, sign = [], 0, text.split("\n"), re.compile(SIGN).search
    starts, keys = [], "-----BEGIN " in text
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    n = 0
    while n < len(lines):
        line = lines[n].rstrip("\r")
        if keys and (m := begin.search(line)):
            last = n
            if not end.search(line, m.end()):
                k = n + 1
                while k < len(lines) and not end.search(lines[k]) and not lines[k].lstrip().startswith("-----") and re.fullmatch(r"[\sA-Za-z0-9+/=:,.-]*", lines[k]):
                    k += 1
                last = k
                if k == len(lines) or not end.search(lines[k]):
                    last = k - 1
                    while last > n and not lines[last].strip():
                        last -= 1
            stop = starts[last] + len(lines[last].rstrip("\r"))
            found.append((n + 1, last + 1, starts[n] + m.start(), stop, text[starts[n] + m.start() : stop]))
            n = last + 1
            continue
        if line.rstrip()[-1:] in (">", "|", "+", "-") and (m := block.match(line)):
            depth, k = len(m[1].expandtabs()), n + 1
            while k < len(lines) and lines[k].strip() and len(lines[k].expandtabs()) - len(lines[k].expandtabs().lstrip()) > depth:
                k += 1
            if k > n + 1:
                a = starts[n + 1] + len(lines[n + 1]) - len(lines[n + 1].lstrip())
                b = starts[k - 1] + len(lines[k - 1].rstrip())
                if begin.search(text, a, b) is None:
                    if not nothing.match(text[a:b]):
                        found.append((n + 2, k, a, b, text[a:b]))
                    n = k
                    continue
        low = line.lower()
        for p, words, any_case in places if sign(line) else ():
            if not any(w in (low if any_case else line) for w in words):
                continue
            for m in p.finditer(line):
                for g in range(1, p.groups + 1):
                    v = m[g]
                    if v is None:
                        continue
                    a, b = m.span(g)
                    if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
                        v, a, b = v[1:-1], a + 1, b - 1
                        quoted = True
                    else:
                        quoted = False
                        cut = v.rstrip("\"');,")
                        v, b = cut, b - (len(v) - len(cut))
                    if v and not nothing.match(v) and not (quoted and " " in v.strip() and not v.startswith("$") and (p.pattern.startswith(COMMENT) or not phrase(line, a, b))):
                        found.append((n + 1, n + 1, starts[n] + a, starts[n] + b, v))
        n += 1
    return found


def _patterns() -> tuple:
    return [(re.compile(p), words, p.startswith("(?i)")) for p, words in zip(PLACES, NEEDS, strict=True)], re.compile(NOTHING), re.compile(BEGIN), re.compile(END), re.compile(BLOCK_KEY)


def _scan_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    patterns = _patterns()
    for batch in batches:
        rows = [(i, o, *hit) for i, o, t in zip(batch["id"], batch["owner"], batch["text"], strict=True) if t for hit in scan(t, *patterns)]
        yield pd.DataFrame(rows, columns=["id", "owner", "first_line", "last_line", "start", "stop", "literal"])


HIT = "first_line bigint, last_line bigint, start bigint, stop bigint, literal string"


def _rescan_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import ahocorasick

    for batch in batches:
        rows = []
        for i, text, literals in zip(batch["id"], batch["text"], batch["literals"], strict=True):
            automaton = ahocorasick.Automaton()
            for x in set(literals):
                automaton.add_word(x, x)
            automaton.make_automaton()
            for last, x in automaton.iter(text):
                a, b = last - len(x) + 1, last + 1
                if (a and text[a - 1].isalnum() and x[0].isalnum()) or (b < len(text) and text[b].isalnum() and x[-1].isalnum()):
                    continue
                rows.append((i, text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 1, a, b, x))
        yield pd.DataFrame(rows, columns=["id", "first_line", "last_line", "start", "stop", "literal"])


def find(files: DataFrame, owners: int = OWNERS, share: float = SHARE) -> DataFrame:
    """id, first_line, last_line, start, stop, literal of every credential in files(id, owner, text).

    A null or empty text has none, a null owner counts as one owner, repeated files have the same findings each. Spans are
    character positions and may overlap where two places of the grammar agree. An empty table gives no rows."""
    kind = files.schema["id"].dataType.simpleString()
    files = files.select("id", F.coalesce("owner", F.lit("")).alias("owner"), "text")
    hits = stored(files.mapInPandas(_scan_files, f"id {kind}, owner string, {HIT}"), "credential-hits")
    total = F.broadcast(files.agg(F.count_distinct("owner").alias("all_owners")))  # one row
    index = hits.groupBy("literal").agg(F.count_distinct("owner").alias("n_owners"))
    common = (F.col("n_owners") > owners) & (F.col("n_owners") > share * F.col("all_owners"))
    index = index.crossJoin(total).select("literal", (common & ~F.col("literal").rlike(UNMISTAKABLE)).alias("placeholder"))
    kept = hits.join(index.where("not placeholder"), "literal").select("id", "first_line", "last_line", "start", "stop", "literal")

    confirmed = index.where("not placeholder").where((F.length("literal") >= LEAST) & F.col("literal").rlike(STRUCTURED)).select("literal")
    runs, pairs = (lambda c, p=p: F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (RUNS, PAIRS))
    some = lambda c: F.concat(F.filter(runs(c), lambda p: F.length(p) >= RUN), pairs(c))
    literal, text = F.col("literal"), F.col("text")
    bare = F.size(some(literal)) == 0  # nothing but one short run: all short runs are needed then
    confirmed = stored(confirmed.select("literal", F.explode(F.array_distinct(F.when(bare, runs(literal)).otherwise(some(literal)))).alias("key"), bare.alias("bare")), "confirmed")
    texts = lambda keys: files.select("id", F.explode(F.array_distinct(keys)).alias("key"))
    wanted_keys = lambda hit, label: sized(confirmed.where(hit).select("key").distinct(), label)
    held = texts(some(text)).join(wanted_keys(~F.col("bare"), "secret-keys"), "key", "left_semi")
    if not confirmed.where("bare").isEmpty():
        short = texts(F.filter(runs(text), lambda p: F.length(p) < RUN)).join(wanted_keys(F.col("bare"), "secret-short-keys"), "key", "left_semi")
        held = held.unionByName(short)
    held = stored(held, "held")
    rarity = held.groupBy("key").agg(F.count("*").alias("n"))
    rarest = confirmed.join(rarity, "key").groupBy("literal").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    wanted = held.join(rarest, "key").groupBy("id").agg(F.collect_set("literal").alias("literals"))
    again = files.select("id", "text").dropDuplicates(["id"]).join(wanted, "id").mapInPandas(_rescan_files, f"id {kind}, {HIT}")
    return kept.unionByName(again).distinct()


def line_cases(found: DataFrame) -> DataFrame:
    """One row per (id, first_line, last_line)."""
    return found.select("id", "first_line", "last_line").distinct()


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            if text is not None and spans is not None:
                merged: list[list[int]] = []
                for a, b in sorted((int(s["start"]), int(s["stop"])) for s in spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                for a, b in reversed(merged):
                    gone = text[a:b]
                    # Lines stay lines, so that positions in the rest of the file hold.
                    text = text[:a] + "\n".join("\r" if x == "\r" else REDACTED + "\r" * x.endswith("\r") if x.strip() else x for x in gone.split("\n")) + text[b:]
            out.append(text)
        yield batch[["id"]].assign(text=out, n_redacted=[0 if s is None else len(s) for s in batch["spans"]])


def redact(files: DataFrame, found: DataFrame) -> DataFrame:
    """id, text, n_redacted: every file of files(id, ..., text), its credentials replaced by a mark, line by line."""
    kind = files.schema["id"].dataType.simpleString()
    spans = found.groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return files.select("id", "text").join(spans, "id", "left").mapInPandas(_redact, f"id {kind}, text string, n_redacted int")


def files_of(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.col("profile_id").alias("id"), host("hostname").alias("owner"), F.col("config_text").alias("text"))
