"""Facts, links, rules, masks and diffs of configurations."""

from datetime import datetime

import pytest

from logloom.operators import cascade, compliance, diff, facts, sanitize, segments, topology
from logloom.sinks import reports

SCHEMA = "host string, site_id string, platform string, function string, text string"
EOS = """hostname s-sw-01
interface Ethernet1
   description to s-sw-02 port 1
   ip address 10.0.0.1/31
   speed 10000
!
interface Vlan10
   ip address 10.1.10.1/24
!
vlan 10
   name MGMT
router bgp 65001
   router-id 10.9.9.9
   neighbor 10.0.0.0 remote-as 65002
   neighbor 10.0.0.0 remote-as 65003
   address-family evpn
   neighbor 999.1.1.1 remote-as 1
mlag configuration
   peer-address 10.5.5.2
ntp server 10.2.2.2;
ntp server 10.2.2.2
ntp server <x>
logging host 10.3.3.3
vxlan vlan 10 vni 10010
vxlan vni 50001 vrf T1
"""
OTHER = "interface Ethernet2\n   ip address 10.0.0.0/31\ninterface Ethernet3\n   ip address 10.5.5.2/30\nrouter bgp 65002\n"
FW = 'version 21.4R3;\ninterfaces {\n    ge-0/0/1 {\n        description "Cogent uplink";\n        unit 0 { family inet { address 8.8.8.8/30; } }\n    }\n    address 9.9.9.9/32;\n}\nchassis cluster x;\n'


def configs(spark):
    return spark.createDataFrame([("s-sw-01", "s", "eos", "sw", EOS), ("s-sw-02", "s", "eos", "sw", OTHER), ("s-fw-01", "s", "junos", "fw", FW), ("s-fw-02", "s", "junos", "fw", ""), ("x-rt-9", "x", "", "", "é" * 10)], SCHEMA)


def test_addresses_peers_interfaces(spark):
    c = configs(spark)
    assert sorted((r["host"], r["cidr"]) for r in facts.addresses(c).collect()) == [("s-fw-01", "8.8.8.8/30"), ("s-fw-01", "9.9.9.9/32"), ("s-sw-01", "10.0.0.1/31"), ("s-sw-01", "10.1.10.1/24"), ("s-sw-02", "10.0.0.0/31"), ("s-sw-02", "10.5.5.2/30")]
    assert [tuple(r) for r in facts.bgp_peers(c).select("host", "ip", "asn").collect()] == [("s-sw-01", "10.0.0.0", 65003)]
    got = {(r["host"], r["name"]): (r["ip"], r["description"], r["speed"]) for r in facts.interfaces(c).collect()}
    assert got["s-sw-01", "Ethernet1"] == ("10.0.0.1/31", "to s-sw-02 port 1", "10G") and got["s-sw-01", "Vlan10"] == ("10.1.10.1/24", "", "")


def test_interfaces_of_set_lines_and_braced_blocks(spark):
    lines = 'set interfaces et-0/0/1 unit 0 family inet address 10.7.0.1/31\nset interfaces et-0/0/1 unit 1 family inet address 10.7.0.3/31\nset interfaces et-0/0/1 description "to s-sw-01"\nset interfaces et-0/0/1 unit 0 description later\nset interfaces et-0/0/1 gigether-options speed 100g\nset interfaces xe-0/0/2 description spare\n'
    srl = 'interface ethernet-1/1 {\n    description "to spine"\n    port-speed 25G\n    ip ospf area 0.0.0.1\n    ip ospf hello-interval 5\n    ip ospf dead-interval 20\n    ip ospf cost 77\n    ip ospf network point-to-point\n    subinterface 0 {\n        ipv4 {\n            address 10.8.0.1/31 {\n            }\n        }\n    }\n}\ninterface system0 {\n    subinterface 0 {\n        ipv4 { address 10.8.9.9/32 { } }\n    }\n}\n'
    c = spark.createDataFrame([("j", "s", "junos-ex", "", lines), ("o", "s", "eos", "", lines), ("n", "s", "srl", "", srl)], SCHEMA)
    got = {(r["host"], r["name"]): tuple(r)[3:] for r in facts.interfaces(c).collect()}
    assert got == {
        ("j", "et-0/0/1"): ("10.7.0.1/31", "to s-sw-01", "100G", None, None, None, None, None), ("j", "xe-0/0/2"): ("", "spare", "10G", None, None, None, None, None),
        ("n", "ethernet-1/1"): ("10.8.0.1/31", "to spine", "25G", "0.0.0.1", 5, 20, 77, "point-to-point"), ("n", "system0"): ("10.8.9.9/32", "", "", None, None, None, None, None),
    }
    assert {(r["host"], r["cidr"]) for r in facts.addresses(c).collect() if r["host"] == "n"} == {("n", "10.8.0.1/31"), ("n", "10.8.9.9/32")}


def test_wide_and_named(spark):
    c = configs(spark)
    w = {r["host"]: r for r in facts.wide(c).collect()}
    assert (w["s-sw-01"]["local_asn"], w["s-fw-01"]["version"], w["s-fw-01"]["cluster"]) == ("65001", "21.4R3", True)
    assert {r["host"]: r["families"] for r in facts.families(c).collect()}["s-sw-01"] == ["l2vpn-evpn"]
    assert sorted((r["kind"], r["value"]) for r in facts.named_values(c).collect()) == [("l2_vni", "10010"), ("l3_vni", "50001"), ("vrf", "T1")]
    assert {(r["service"], tuple(r["endpoints"])) for r in facts.endpoints(c).collect()} == {("ntp", ("10.2.2.2",)), ("syslog", ("10.3.3.3",))}
    assert {r["host"]: r["ends"] for r in facts.lifecycle(facts.wide(c)).collect()}["s-fw-01"] == "2028"


def test_links(spark):
    c = configs(spark)
    nodes = facts.nodes(c)
    found = topology.candidates(nodes)
    best = {(r["source"], r["target"]): (r["rule"], r["n_rules"]) for r in topology.best(found).collect()}
    assert best == {("s-sw-01", "s-sw-02"): ("mlag-peer", 4), ("s-fw-01", "s-fw-02"): ("ha-pair-naming", 1)}
    assert "s_sw_01 ---|mlag-peer| s_sw_02" in reports.mermaid(topology.best(found)) and '"s-sw-01" -- "s-sw-02"' in reports.graphviz(topology.best(found))
    apart = topology.candidates(facts.nodes(c.withColumn("site_id", c["host"])))
    assert apart.collect() == []


A = """router bgp 65001
   neighbor 10.0.0.0 remote-as 65002
   address-family evpn
router ospf 1
   router-id 10.9.9.1
interface Ethernet1
   description to b
   ip address 10.0.0.1/31
   speed 10000
interface Ethernet2
   ip address 10.0.0.1/29
interface Loopback1
   ip address 10.8.0.1/32
vxlan source-interface loopback1
vxlan vlan 1 vni 10010
"""
B = """interface ethernet-1/1 {
    port-speed 1G
    ip ospf area 0.0.0.7
    ip ospf cost 9
    subinterface 0 {
        ipv4 {
            address 10.0.0.0/31 {
            }
        }
    }
}
interface system0 {
    ipv4 {
        address 10.8.0.2/32
    }
}
protocols ospf
autonomous-system 65002
afi-safi evpn
vxlan vni 50001
"""


def test_what_links_carry(spark):
    """Both directions of one pair: the end with the lesser name is the source."""
    sites = spark.createDataFrame([("s", " 40G "), ("t", None)], "site_id string, default_link_speed string")
    for one, two in ((A, B), (B, A)):
        c = spark.createDataFrame([("a", "s", "eos" if one == A else "srl", "", one), ("b", "s", "srl" if two == B else "eos", "", two)], SCHEMA)
        nodes = facts.nodes(c)
        edges = topology.best(topology.candidates(nodes))
        (e,) = [r for r in topology.detail(edges, nodes, sites).collect()]
        assert (e["source"], e["target"], e["subnet"], e["bgp_type"], e["speed"], e["layers"], list(e["families"])) == ("a", "b", "10.0.0.0/31", "ebgp", "1G", ["physical", "bgp", "ospf", "vxlan"], ["l2vpn-evpn"])
        ends = {"eos": ("Ethernet1", "10.0.0.1/31", "10G", 65001, "10.9.9.1", "10.8.0.1"), "srl": ("ethernet-1/1", "10.0.0.0/31", "1G", 65002, "10.8.0.2", "10.8.0.2")}
        for name, platform in (("src", "eos" if one == A else "srl"), ("dst", "srl" if one == A else "eos")):
            assert tuple(e[f"{name}_{k}"] for k in ("iface", "ip", "speed", "asn", "router_id", "vtep")) == ends[platform]
        assert (list(e["l2_vnis"]), list(e["l3_vnis"]), e["ospf_area"], e["ospf_cost"]) == ([10010], [50001], "" if one == A else "0.0.0.7", None if one == A else 9)
        assert (e["src_bgp_ip"], e["dst_bgp_ip"]) == (("10.0.0.0", "") if one == A else ("", "10.0.0.0"))
        assert {r["layer"]: r["n_edges"] for r in topology.layer_counts(topology.detail(edges, nodes, sites)).collect()} == dict.fromkeys(topology.LAYERS, 1)
    bare = spark.createDataFrame([("x-fw-01a", "s", "junos", "", "chassis cluster"), ("x-fw-01b", "s", "junos", "", "")], SCHEMA)
    (e,) = topology.detail(topology.best(topology.candidates(facts.nodes(bare))), facts.nodes(bare), sites).collect()
    assert (e["kind"], e["speed"], e["src_speed"], e["subnet"], e["layers"]) == ("ha", "40G", "40G", "", ["physical"])
    assert topology.detail(topology.best(topology.candidates(facts.nodes(bare.limit(0)))), facts.nodes(bare.limit(0)), sites).collect() == []


def test_speeds(spark):
    df = spark.createDataFrame([("100G", "10G"), ("", "1G"), ("100M", ""), ("", ""), ("x", "1G")], "a string, b string")
    assert [r[0] for r in df.select(topology.link_speed(df["a"], df["b"])).collect()] == ["10G", "1G", "100M", "", "x"]


def test_flags_and_findings_of_nodes(spark):
    c = spark.createDataFrame([("east-1-fw-02", "s", "eos", "", "router bgp 1\nneighbor 1.1.1.1\n description \"Telia attached\";\n"), ("b", "s", "", "", "EVPN and vni 7")], SCHEMA)
    inventory = spark.createDataFrame([("EAST-1-FW-02.x", None, "FW", "P1", "R1", 77), ("b", "Spine", "sw", None, None, 88)], "hostname string, role string, function_code string, pop string, rack string, asn bigint")
    got = {r["host"]: r for r in topology.described_nodes(facts.nodes(c), inventory).collect()}
    a, b = got["east-1-fw-02"], got["b"]
    assert (a["role"], a["has_bgp"], a["has_ospf"], a["isp_uplink"], a["tier"], a["pop"], a["asn"]) == ("firewall", True, False, True, "fw", "p1", 1)
    assert (b["role"], b["has_evpn"], b["has_vxlan"], b["isp_uplink"], b["tier"], b["rack"], b["asn"]) == ("unknown", True, True, False, "spine", "", 88)
    findings = spark.createDataFrame([("low", ["B", "x"]), (" HIGH", ["b.y"]), ("critical", None), ("odd", ["east-1-fw-02"]), (None, ["b"])], "severity string, devices array<string>")
    assert {r["host"]: r["severity"] for r in topology.overlay(c, findings).collect()} == {"east-1-fw-02": "", "b": "high"}


def test_numbers_of_overlays(spark):
    frr = "interface vxlan10\n vni 10\ninterface x\n vni 11\nvrf T\n vni 49000\nexit-vrf\nvxlan vni 60000\nvxlan vni 60000\n"
    c = spark.createDataFrame([("f", "s", "frr", "", frr), ("e", "s", "eos", "", frr)], SCHEMA)
    got = {r["host"]: (list(r["l2_vnis"]), list(r["l3_vnis"])) for r in facts.with_vnis(c).collect()}
    assert got == {"f": ([10], [60000, 49000]), "e": ([], [60000])}
    assert c.select(facts.platform_guess(c["text"])).first()[0] == "unknown"


def test_short_names(spark):
    hosts = spark.createDataFrame([("east-sw-03", "s"), ("east-sw-04", "s")], "host string, site_id string")
    d = spark.createDataFrame([("east-sw-04", "s", "link SW-03 x"), ("east-sw-03", "s", "to EAST-SW-04")], "host string, site_id string, description string")
    assert sorted(r["rule"] for r in topology.by_description(d, hosts).collect()) == ["description-hostname", "description-shortform"]


def test_rules_and_search(spark):
    checks = {(r["device"], r["rule_id"]): (r["passed"], r["reason"]) for r in compliance.check(configs(spark)).collect()}
    assert checks["s-sw-01", "syslog-min-1-remote"] == (True, "ok") and not checks["s-sw-02", "ntp-min-2-servers"][0]
    assert ("s-sw-02", "bgp-md5-auth") not in checks and ("x-rt-9", "no-telnet") not in checks
    (hit,) = compliance.search_fleet(configs(spark), "NTP server").collect()
    assert tuple(hit)[:3] == ("s-sw-01", "eos", 3)
    at = EOS.index("ntp server")
    assert hit["snippets"][0] == EOS[at - 40 : at + 50].replace("\n", " ⏎ ") and len(hit["snippets"]) == 3
    edge = spark.createDataFrame([("h", "s", "eos", "", "é1x2x3x4x5x6x"), ("k", "s", "eos", "", "X")], SCHEMA)
    assert {r["device"]: (r["match_count"], list(r["snippets"])) for r in compliance.search_fleet(edge, "[0-9]x", around=1).collect()} == {"h": (6, ["é1x2", "x2x3", "x3x4", "x4x5", "x5x6"])}
    assert compliance.search_fleet(edge, "x", case_insensitive=False).count() == 1
    for bad in ("(", "a*"):
        with pytest.raises(compliance.PatternError):
            compliance.search_fleet(edge, bad)
    failing = {r["rule_id"]: [f["device"] for f in r["failing"]] for r in compliance.rollup(compliance.check(configs(spark))).collect()}
    assert failing["ntp-min-2-servers"] == ["s-fw-01", "s-fw-02", "s-sw-02"]
    found = spark.createDataFrame([(1, "see 'no lldp run' there"), (2, "x\n ntp server 1"), (3, "at 10.0.0.1 now"), (4, "port ge-0/0/1"), (5, None)], "id int, evidence string")
    assert [r["fingerprint"] for r in compliance.fingerprint(found).orderBy("id").collect()] == ["no lldp run", "ntp server 1", "10.0.0.1", "ge-0/0/1", None]
    t = compliance.totals(compliance.check(configs(spark).where("host = 'none'"))).collect()[0]
    assert tuple(t) == (0, 0, 0, 0)


def test_masks(spark):
    text = 'secret "$9$abc"\nsnmp-server community foo ro\nneighbor 1.2.3.4 password 7 zz\n-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----\ncommunity A members 1:2;\n'
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = {r["id"]: r for r in sanitize.sanitize(df).collect()}
    assert "abc" not in rows[1]["text"] and "foo" not in rows[1]["text"] and "zz" not in rows[1]["text"] and "community A members" in rows[1]["text"] and rows[1]["n"] >= 4
    assert (rows[2]["text"], rows[2]["n"], rows[3]["text"]) == (None, 0, "")
    again = sanitize.sanitize(spark.createDataFrame([(1, rows[1]["text"])], "id int, text string")).collect()[0]
    assert again["text"] == rows[1]["text"]
    ips = spark.createDataFrame([(1, "8.8.8.8 and 10.0.0.1, 8.8.8.8 300.1.1.1 08.1.1.1 100.64.0.1"), (2, None)], "id int, text string")
    got = {r["id"]: r for r in sanitize.mask_public(ips).collect()}
    words = got[1]["text"].split()
    assert words[0] == words[3] and words[0].startswith("PUB-") and words[2] == "10.0.0.1," and words[4:6] == ["300.1.1.1", "08.1.1.1"] and got[1]["n"] == 3 and got[2]["text"] is None


def test_segments(spark):
    v = {r["vlan_id"]: r for r in segments.vlans(configs(spark)).collect()}
    assert v[10]["name"] == "MGMT" and v[10]["subnets"] == ["10.1.10.1/24"]
    assert segments.merged_vlans(segments.vlans(configs(spark))).collect()[0]["kind"] == "Management"
    nested = segments.scoped_addresses(configs(spark).where("platform = 'junos'"))
    assert [tuple(r) for r in nested.collect()] == [("s-fw-01", "ge-0/0/1", "8.8.8.8/30", "Cogent uplink")]
    wan = segments.wan_addresses(nested)
    assert [r["carrier"] for r in wan.collect()] == ["Cogent"] and tuple(segments.carriers(wan, configs(spark)).collect()[0]) == ("Cogent", 1, 1, "", False)
    text = FW + 'description "Cogent peer"; x; peer-as 174;\ndeactivate interfaces ge-0/0/1\nst0.3 {\n description "hub"; address 10.3.3.3/30; }\n'
    more = spark.createDataFrame([("s-fw-01", "s", "junos", "fw", text)], SCHEMA)
    assert tuple(segments.carriers(wan, more).collect()[0]) == ("Cogent", 1, 1, "174", True)
    assert [tuple(r) for r in segments.tunnels(more).collect()] == [("s-fw-01", 0, "st0.3", "10.3.3.3/30", "hub")]


def test_kinds_of_vlans(spark):
    rows = [("a", 5, "x", ["10.9.0.1/24", "10.245.207.1/24"]), ("a", 6, "STOR-1", ["192.168.1.1/24"]), ("a", 63, "y", []), ("b", 4001, "", []), ("b", 7, "z", [])]
    df = spark.createDataFrame(rows, "host string, vlan_id int, name string, subnets array<string>")
    assert {r["vlan_id"]: r["kind"] for r in segments.merged_vlans(df).collect()} == {5: "IPMI/BMC", 6: "Storage", 63: "Production/Access", 4001: "Infrastructure", 7: "Other"}


def test_roles_in_order(spark):
    rows = [("s-fw-02", "s", "", "", "chassis cluster"), ("s-fw-01", "s", "", "", ""), ("s-fw-03", "s", "", "", ""), ("t-fw-09", "t", "", "", ""), ("s-rt-01", "s", "", "", ""), ("s-sw-01", "s", "", "", "neighbor 1.1.1.1 remote-as 2\n"), ("s-sw-02", "s", "", "", "vni 7"), ("s-sw-03", "s", "", "", "neighbor 1.1.1.1 { peer-as 2; }\ndescription google;\n"), ("x", "s", "", "", "")]
    got = {r["host"]: r["description"] for r in facts.role_descriptions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"s-fw-01": "Primary Firewall", "s-fw-02": "Secondary Firewall (HA chassis-cluster)", "s-fw-03": "Firewall #3", "t-fw-09": "Primary Firewall", "s-rt-01": "Primary Edge Router", "s-sw-01": "Core switch", "s-sw-02": "EVPN-VXLAN fabric leaf", "s-sw-03": "ISP-edge / Core switch", "x": "Unclassified network device"}


def test_names_are_masked(spark):
    text = 'user jane.doe { uid 1; }\nusername Jane.Doe privilege 15\nkey <REDACTED-SSH-KEY> jane@x\nset login full-name "Jane Doe"\n'
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = {r["id"]: r for r in sanitize.mask_names(df).collect()}
    lines = rows[1]["text"].split("\n")
    token = lines[0].split()[1]
    assert token.startswith("user-") and lines[1].split()[1] == token and lines[2] == "key <REDACTED-SSH-KEY>" and lines[3].endswith('full-name "<REDACTED-NAME>"') and rows[1]["n"] == 4
    assert (rows[2]["text"], rows[2]["n"], rows[3]["text"]) == (None, 0, "")
    whole = {r["id"]: r for r in sanitize.sanitize_all(spark.createDataFrame([(1, text + 'secret "$9$abc" at 8.8.8.8\n')], "id int, text string"), mask_pii=True).collect()}
    assert whole[1]["n"] >= 6 and "8.8.8.8" not in whole[1]["text"] and "jane" not in whole[1]["text"].lower() and "abc" not in whole[1]["text"]
    plain = sanitize.sanitize_all(spark.createDataFrame([(1, text)], "id int, text string")).first()
    assert "jane.doe" in plain["text"]


def test_addresses_of_set_lines_and_of_the_block_around(spark):
    lines = 'set interfaces ge-0/0/0 unit 7 family inet address 8.8.4.4/30\nset interfaces ge-0/0/0 unit 7 description "Telia uplink"\nset interfaces ge-0/0/0 description later\nset interfaces ge-0/0/1 unit 0 family inet address 10.1.1.1/30\nset interfaces ge-0/0/2 unit 0 family inet address 8.8.4.4/30\n'
    block = "ae0 {\n  description GTT;\n  unit 0 { family inet { address 9.9.9.1/30; address 9.9.9.5/30; } }\n  xe-0/0/1 {\n    description Colt;\n    address 9.9.9.9/30;\n  }\n  address 9.9.9.13/30;\n}\naddress 9.9.9.17/30;\n"
    c = spark.createDataFrame([("j", "s", "junos", "", lines), ("k", "s", "junos", "", block)], SCHEMA)
    got = sorted((r["host"], r["name"], r["ip"], r["carrier"]) for r in segments.wan_addresses(segments.junos_addresses(c)).collect())
    assert got == [("j", "ge-0/0/0.7", "8.8.4.4/30", "Telia"), ("k", "ae0", "9.9.9.1/30", "GTT"), ("k", "ae0", "9.9.9.13/30", ""), ("k", "ae0", "9.9.9.5/30", "GTT"), ("k", "xe-0/0/1", "9.9.9.9/30", "Colt")]


def test_captures_and_diffs(spark):
    t = lambda d: datetime(2025, 1, d)
    rows = [(1, "s", "A.x", "EOS", "f", t(1), "a\nntp 1\n"), (2, "s", " a", None, "f", t(2), "a\r\nntp 2\r\nb\r\n"), (2, "s", " a", None, "f", t(2), "a\r\nntp 2\r\nb\r\n"), (3, "s", "b", "x", "f", t(1), None), (4, "s", None, "x", "f", t(1), "z")]
    p = spark.createDataFrame(rows, "profile_id bigint, site_id string, hostname string, platform string, function string, captured_at timestamp, config_text string")
    assert sorted((r["host"], r["text"]) for r in facts.latest_configs(p).collect()) == [("a", "a\nntp 2\nb\n"), ("b", "")]
    pairs = diff.pairs(p)
    assert sorted(tuple(r) for r in diff.sections(pairs).collect()) == [("a", 2, "ntp", 1, 1), ("a", 2, "other", 1, 0)]
    assert "+ntp 2" in diff.unified(pairs).collect()[0]["diff"]


def test_lines(spark):
    lines = ["﻿<13>1 2025-01-01T00:00:00Z h app 1 - - msg", "<11>Jan  1 00:00:00 h app[1]: m", "Jan  1 00:00:00 h ev$nt: %X-1-Y: m", "1:02:03.04 § out", "1:02:03.04 §  ", "", None, "free text"]
    df = spark.createDataFrame([(i, x, "d") for i, x in enumerate(lines)], "seq bigint, line string, default_host string")
    got = [(r["fmt"], r["hostname"], r["appname"], r["severity_raw"], r["message"]) for r in cascade.parse(df).orderBy("seq").collect()]
    assert got == [("rfc5424", "h", "app", "notice", "msg"), ("rfc3164", "h", "app", "err", "m"), ("junos", "h", "ev$nt", "info", "m"), ("terminal", "d", "scrt-session", "info", "out"), ("free", "d", "syslog", "info", "free text")]
    frr = spark.createDataFrame([(1, "2026/05/03 23:21:06 WATCHFRR: [QDG3Y-BY5TN] zebra state -> down : x", "h"), (2, "note", None)], df.schema)
    assert [(r["timestamp"], r["appname"], r["severity_raw"]) for r in cascade.parse_routing(frr).orderBy("seq").collect()] == [("2026-05-03T23:21:06", "watchfrr", "err"), ("", "frr", "info")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("high", "a|b\nc", "<t>", ["x", "y"], None, "r")], "severity string, category string, title string, affected_devices array<string>, evidence string, rationale string")
    assert "a\\|b c" in reports.markdown("T", [("F", df)]) and "&lt;t&gt;" in reports.page("T", [("F", df)])
    links = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", 1.0)], "source string, target string, rule string, confidence double")
    nodes = spark.createDataFrame([("a", "firewall", True, "high"), ("d", "", False, "")], "host string, role string, has_bgp boolean, severity string")
    text = reports.mermaid(links, nodes)
    assert 'a[("a<br/>BGP")]' in text and 'd["d"]' in text and "style a fill:#ff7b72" in text and "only the first" not in text
    assert "only the first 1" in reports.mermaid(links, limit=1) and "only the first 1" in reports.graphviz(links, nodes, limit=1) and "octagon" in reports.graphviz(links, nodes)
    reports.findings_csv(df, str(tmp_path / "f"))
    assert "high,a|b c,<t>,\"x, y\"" in "".join(f.read_text() for f in (tmp_path / "f").glob("*.csv"))


def test_small_values(spark):
    from logloom.functions import values

    df = spark.createDataFrame([(" TRUE ", "Fra-1_x", "a" * 20 + "b" * 20), ("false", "a/../b", "short"), (None, "", None)], "f string, i string, t string")
    got = df.select(values.flag(df["f"]), values.flag(df["f"], True), values.safe_id(df["i"]), values.head_and_tail(df["t"], 10)).collect()
    assert [tuple(r)[:3] for r in got] == [(True, True, "fra-1_x"), (False, False, None), (False, True, None)]
    assert got[0][3] == "a" * 7 + "\n\n... [middle truncated, original size 40 chars] ...\n\nbbb" and got[1][3] == "short" and got[2][3] is None
