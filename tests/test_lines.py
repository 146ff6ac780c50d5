"""Logical entries: every rule, continuations, blocks and edge cases."""

import random

from logloom.operators import lines

TEXT = [
    ("<167>Oct 10 03:00:04 h1 snmpd[666]: neighbour lost", "rfc3164", "debug", "snmpd"),
    ("Oct  9 19:01:57 h1 rpd: %PEER-4-NOTE: handshake", "rfc3164", "warning", "rpd"),
    ("﻿Oct  9 19:01:57 h1 rpd: plain\r", "rfc3164", "info", "rpd"),
    ('<84>1 2025-10-10T16:52:01.002+05:30 h1 zebra 18 ID94 [origin software="zebra"] x', "rfc5424", "warning", "zebra"),
    ("2026-11-26T10:00:00Z h1 other[2]: second program", "stamped", "info", "other"),
    ("2026-11-26 10:00:01 INFO x - msg", "stamped", "info", "x"),
    ("[2026-11-26 10:00:01.5] ERROR app: m", "stamped", "err", "app"),
    ("Thu Nov 26 10:00:01 2026 only text", "stamped", "info", None),
    ('10.1.2.3 - - [26/Nov/2026:10:00:01 +0000] "GET / HTTP/1.1" 500 3', "access", "info", None),
    ('level=warn ts=2026-11-26T10:00:01Z component=a.b msg="m m"', "pairs", "warning", "a.b"),
    ("26-Nov-2026 10:00:00.123 SEVERE [http-nio-8080-exec-1-long-name-here-a-b-c-d] org.apache.catalina.core.StandardWrapperValve.invoke Servlet failed", "servlet", "err", "org.apache.catalina.core.StandardWrapperValve.invoke"),
    ("Oct  9 19:01:57 2001:db8:1:2:3:4:5:6-long-host-name.example.net a-b.c-d.e-f.g-h[17]: text", "rfc3164", "info", "a-b.c-d.e-f.g-h"),
    ("W1010 08:00:21.200259   10879 a/b/c-d/e.f/g/h-i/j/k.l/m-n/o/p.q/r/lease.go:475] x", "glog", "warning", "a/b/c-d/e.f/g/h-i/j/k.l/m-n/o/p.q/r/lease.go"),
    ("2:12:34.14 §queue depth", "terminal", "info", "scrt-session"),
    ("2025/10/15 09:54:05 errors: ZEBRA: [6R522-37TRF] clock", "routing", "err", "ZEBRA"),
    ("2025/10/15 09:54:05.123 BGP: clock", "routing", "info", "BGP"),
    ("2025-10-10 14:58:35,785 FATAL collector.main: x", "python", "crit", "collector.main"),
    ("W1010 08:00:21.200259   10879 lease.go:475] x", "glog", "warning", "lease.go"),
    ('time="2025-10-10T06:36:23.980Z" level=trace component=netpoll.snmp msg="level=err: y" peer=1', "pairs", "debug", "netpoll.snmp"),
    ('time="2025-10-10T06:36:23Z" component=a.b level=error msg="y"', "pairs", "err", "a.b"),
    ('{"ts": "1760105267", "severity": "emerg", "app": "netpoll.worker", "message": "q \\"level\\": \\"x\\""}', "json", "emerg", "netpoll.worker"),
    ("2025-10-10 17:38:49.118 | NOTICE   | trap-relay | z", "table", "notice", "trap-relay"),
    ("[Fri Oct 10 06:48:01.674760 2025] [authz:error] [pid 1853] poll", "httpd", "err", "authz"),
    ("11-Oct-2025 12:12:43.738 SEVERE [exec-38] com.example.Writer cannot", "servlet", "err", "com.example.Writer"),
]
MORE = ["Traceback (most recent call last):", '  File "/x.py", line 3, in run', "\tat a.b.C(C.java:1)", "    Oct 10 08:00:21 cannot write", "    2025-10-10 08:00:21,000 ERROR a.b: c", "00000000  ae 15", "10.1.2.3  Idle  09:26:45  6383", "[edit interfaces ae1]", "+    mtu 9000;", " | more", "ValueError: x"]
SCHEMA = "src_table string, stream string, seq bigint, line string"


def run(spark, rows, **kw):
    return {(r["stream"], r["first_seq"]): r for r in lines.entries(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_every_rule(spark):
    rows = [("t", "a", i, x[0]) for i, x in enumerate(TEXT)]
    got = run(spark, rows)
    assert [(got["a", i]["rule"], got["a", i]["severity_raw"], got["a", i]["appname"]) for i in range(len(TEXT))] == [x[1:] for x in TEXT]
    told = {x[0]: got["a", i] for i, x in enumerate(TEXT)}
    first, stamped, pairs = told[TEXT[0][0]], told[TEXT[4][0]], next(r for t, r in told.items() if "netpoll.snmp" in t)
    assert first["timestamp"] == "Oct 10 03:00:04" and first["message"] == "neighbour lost"
    assert stamped["timestamp"] == "2026-11-26T10:00:00Z" and stamped["message"] == "second program" and pairs["message"] == "level=err: y"
    assert told["level=warn ts=2026-11-26T10:00:01Z component=a.b msg=\"m m\""]["timestamp"] == "2026-11-26T10:00:01Z"


def test_messages_are_whole(spark):
    rows = [("t", "a", 1, TEXT[0][0]), ("t", "a", 2, "\tat a.b.C"), ("t", "a", 3, ""), ("t", "a", 4, "  end "), ("t", "a", 5, " "), ("t", "a", 6, '{"level": "warn", "msg": "m"}'), ("t", "a", 7, "x"), ("t", "a", 8, "{"), ("t", "a", 9, '  "msg": "n"'), ("t", "a", 10, "}"), ("t", "a", 11, "y")]
    for block in (2, 100):
        got = run(spark, rows, block=block)
        assert [got["a", i]["message"] for i in (1, 6, 8)] == ["neighbour lost\n\tat a.b.C\n\n  end ", "m\nx", "n\ny"] and got["a", 1]["text"].endswith("  end ")


def test_fields_cost_nothing_unselected(spark):
    plan = lines.entries(spark.createDataFrame([], SCHEMA)).select("first_seq", "last_seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_continuations_of_mixed_streams_in_blocks(spark):
    rng, rows, want, seq = random.Random(1), [], {}, 0
    at = {}
    for _ in range(600):
        stream = rng.choice("aaab")
        kind = rng.random()
        if kind < 0.25:
            line = rng.choice(TEXT)[0]
            at[stream] = seq
            want[stream, seq] = seq
        elif kind < 0.4:
            line = rng.choice(["", "   ", "\r", None])
        else:
            line = rng.choice(MORE)
            if stream in at:
                want[stream, at[stream]] = seq
        rows.append(("t", stream, seq, line))
        seq += rng.randint(1, 3)
    rng.shuffle(rows)
    for block in (7, 100, 1 << 16):
        assert {k: r["last_seq"] for k, r in run(spark, rows, block=block).items()} == want


def test_json_over_lines(spark):
    text = ["{", '  "ts": "2025-10-10T23:53:49.975Z",', '  "lvl": "warn",', '  "logger": "a.b",', "", '  "msg": "m"', "}", "stray"]
    rows = [("t", "a", i, x) for i, x in enumerate(text)] + [("t", "b", 1, "\n".join(text[:7]))]
    got = run(spark, rows, block=2)
    a, b = got["a", 0], got["b", 1]
    assert (a["last_seq"], a["severity_raw"], a["appname"], a["message"], a["timestamp"]) == (7, "warning", "a.b", "m\nstray", "2025-10-10T23:53:49.975Z")
    assert a["text"].startswith("{\n") and a["text"].endswith("stray")
    assert (b["severity_raw"], b["appname"], b["message"]) == ("warning", "a.b", "m")


def test_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [("t", "a", 1, "  x"), ("t", None, 2, None)]) == {}
    long = TEXT[0][0] + " w" * 200_000
    got = run(spark, [("t", None, 5, long), ("t", None, 6, " more")])
    assert got["", 5]["last_seq"] == 6 and len(got["", 5]["message"]) > 400_000
    wide = spark.createDataFrame([("t", "a", 1, TEXT[0][0], "x", 9)], SCHEMA + ", rule string, block int")
    assert lines.entries(wide).count() == 1


def test_unsplit_rows_only(spark):
    raw = spark.createDataFrame([(1, "s", None, "h", TEXT[0][0])], "seq bigint, stream string, format string, default_host string, line string")
    log = spark.createDataFrame([(1, "", "H.x", "syslog", "info", TEXT[7][0]), (2, "", "h", "bgpd", "info", TEXT[7][0]), (3, None, "h", "syslog", "info", TEXT[7][0])], "seq bigint, timestamp string, hostname string, appname string, severity_raw string, message string")
    got = lines.entries(lines.sources(raw, log)).collect()
    assert sorted((r["src_table"], r["stream"], r["first_seq"]) for r in got) == [("log_event", "h", 1), ("raw_line", "s", 1)]
