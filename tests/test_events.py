"""Classification, action items and the other log aggregates on small inputs."""

import pytest

from logloom.functions import rules
from logloom.operators import events

SCHEMA = "seq bigint, timestamp string, hostname string, appname string, severity_raw string, message string"


def classified(spark, rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    return events.classify(spark.createDataFrame(full, SCHEMA))


@pytest.mark.parametrize(
    ("app", "raw", "message", "severity", "category"),
    [
        ("kernel", "info", "kernel panic now", "critical", "system"),
        ("bgpd", "err", "BGP peer 10.0.0.1 down", "high", "routing"),
        ("x", "info", "\x1b[0;32mlink down\x1b[0m on ge-0/0/1", "high", "interface"),
        ("x", "info", "link up", "medium", "interface"),
        ("sshd", "info", "Accepted publickey for a", "low", "auth"),
        ("x", "crit", "nothing that is known", "high", "other"),
        ("x", "info", "nothing that is known", "info", "other"),
        (None, None, None, "info", "other"),
    ],
)
def test_classes(spark, app, raw, message, severity, category):
    r = classified(spark, [("t", "h.dom", app, raw, message)]).collect()[0]
    assert (r["severity"], r["category"], r["hostname"]) == (severity, category, "h") and "\x1b" not in r["message"]


def test_unknown_events_are_described_by_what_they_have(spark):
    rows = classified(spark, [("", "", "app", "", "  "), ("", None, "", "", ""), ("", "h", "a", "", " " + "x" * 300)]).orderBy("seq").collect()
    assert [r["description"] for r in rows] == ["app", "General log message", "x" * 119] and len(rows[2]["sample_message"]) == 200


def test_unreachable_rules_are_known(spark):
    """A rule that never comes first on its own words is shadowed; the list may not grow."""
    import re

    compiled = [re.compile(p) for p, *_ in rules.CLASSIFICATION]
    shadowed = [i for i, text in ((10, "%bgp-3-notification"), (40, "jddosd"),) if next(k for k, p in enumerate(compiled) if p.search(text)) != i]
    assert shadowed == [10, 40]


def test_counts_and_score(spark):
    c = classified(spark, [("t", "a", "x", "info", "kernel panic")] * 9 + [("t", "a", "x", "info", "link down")] * 3)
    assert {r["severity"]: r["n"] for r in events.severity_counts(c).collect()} == {"critical": 9, "high": 3, "medium": 0, "low": 0, "info": 0}
    assert tuple(events.health(c).collect()[0]) == (54, "D", "Degraded")
    assert tuple(events.health(c, external_alerts=9).collect()[0]) == (39, "F", "Critical")


def test_items_rank_devices_and_samples(spark):
    rows = [(f"2025-01-0{d}", f"h{d}.x", "x", "info", f"link down {d}") for d in (3, 1, 2, 4)] + [("2025-01-09", "", "x", "info", "kernel panic"), ("2025-01-09", "z", "x", "info", "link up")]
    items = events.action_items(classified(spark, rows)).orderBy("rank").collect()
    assert [(r["severity"], r["count"], r["devices"]) for r in items] == [("critical", 1, []), ("high", 4, ["h1", "h2", "h3", "h4"])]
    assert items[1]["sample_messages"] == ["link down 4", "link down 3", "link down 2"]


def test_ties_go_to_the_newer_group(spark):
    items = events.action_items(classified(spark, [("1", "a", "x", "info", "link down"), ("2", "a", "x", "info", "bfd session down")])).orderBy("rank").collect()
    assert [r["description"] for r in items] == ["BFD session down", "Interface link down"]


def test_tops_and_search(spark):
    c = classified(spark, [("1", "a", "x", "info", "link down"), ("2", "b", "x", "info", "kernel panic"), ("3", "b", "x", "info", "q (1)"), ("4", "", "x", "info", "Link Down 2")])
    assert [r["hostname"] for r in events.top_devices(c).collect()] == ["b", "a"]
    assert [tuple(r) for r in events.top_offenders(c).collect()] == [("b", 2), ("a", 1), ("unknown", 1)]
    assert events.search(c, "link down").count() == 2 and events.search(c, r"q \(\d\)").count() == 1
    assert [r["seq"] for r in events.newest_by_severity(c, 2).collect()] == [1, 3]


def test_empty(spark):
    c = classified(spark, [])
    assert events.action_items(c).collect() == [] and tuple(events.health(c).collect()[0]) == (100, "A", "Healthy")
    assert [r["ord"] for r in events.summary(c).orderBy("ord").collect()] == [1, 2, 4]
    wide = spark.createDataFrame([(1, "t", "h", "a", "info", "link down", "x", 1)], SCHEMA + ", rule string, severity int")
    assert events.classify(wide).collect()[0]["severity"] == "high"


def test_patterns_need_their_words():
    import re

    from logloom.functions.guards import needed

    assert needed(r"kernel\s*panic|core\s*dump") == ["core", "kernel"] or needed(r"kernel\s*panic|core\s*dump") == ["dump", "kernel"]
    assert needed(r"(?:major|minor)\s+alarm") == ["alarm"] and needed(r"\d+|x") == [] and needed(r"(?i)abc") == [] and needed(r"ab?c*def(?:gh)+") == ["def"]
    texts = ["kernel panic", "fpc3 offline", "major alarm", "bgp peer down", "re0 switchover", "if_down", "l2ald", "commit", "last  message repeated", "err-disabled", "out of memory", "lag member added", "pause frame", "eos agent"]
    for p, *_ in rules.CLASSIFICATION:
        assert needed(p), p
        for t in texts:
            assert not re.search(p, t) or any(w in t for w in needed(p))


def test_needed_texts():
    """Every text that a pattern matches holds one of its needed texts."""
    import re

    from logloom.functions.guards import needed

    assert needed("abc.*(?:def|gh+i)") == ["abc"] and needed("(?:ab|cd)e?x") == ["ab", "cd"] and needed(r"a?b\.cd{2}") == ["b.cd"] and needed("(?i)abc") == [] and needed("[ab]+|cd") == [] and needed(r"x(?=yz)") == []
    samples = ["bgp peer down", "lacp timeout", "vrrp master change", "%bgp-3-notification x", "link state changed to down", "swap exhausted", "commit confirmed", "ospf neighbor down", "kernel panic", "rpd_isis x", "craft interface", "config x change"]
    for pattern, *_ in rules.CLASSIFICATION:
        words = needed(pattern)
        assert not words or all(any(w in s for w in words) for s in samples if re.search(pattern, s))


def test_patterns_that_are_none(spark):
    with pytest.raises(events.PatternError):
        events.search(classified(spark, []), "a(")


def test_context_of_items(spark):
    rows = [("t", f"h{i % 5}", "kernel", "info", "kernel panic now") for i in range(12)] + [("t", "", "bgpd", "err", "BGP peer 10.0.0.1 down")]
    got = {r["severity"]: (r["devices_text"], r["urgency"]) for r in events.item_context(events.action_items(classified(spark, rows))).collect()}
    assert got["critical"][0].startswith("5 devices affected (h0, h1, h2, h3, h4…)") and "(12)" in got["critical"][1] and got["high"] == ("No specific devices captured.", "Low event rate (1) — may be transient.")
    assert tuple(events.alert_class(classified(spark, rows)).first()) == (13, "crit") and tuple(events.alert_class(classified(spark, [])).first()) == (0, "ok")


def test_analysis_as_one_value(spark):
    import json

    from logloom.sinks import reports

    rows = [("t", "h1", "kernel", "info", "kernel panic now"), ("u", "h2", "app", "info", "hello")]
    got = json.loads(reports.analysis_json(classified(spark, rows)))
    assert (got["score"], got["severity_counts"]["critical"], got["action_items"][0]["rank"], len(got["events"]), got["events"][0]["severity"]) == (95, 1, 1, 2, "critical")
    assert json.loads(reports.analysis_json(classified(spark, [])))["action_items"] == []
