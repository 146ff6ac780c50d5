"""The questions of config_queries and stream_queries about configurations as SQL for a second engine."""

from __future__ import annotations

import re

from logloom.functions import config_rules as R
from logloom.operators import compliance, sanitize, segments, topology
from logloom.plans.fleet import SQL as DEV

SEARCHES = ("ntp server", r"ip ospf cost \d{2,3}")
TUNNEL_ADDRESS = rf"address\s+({R.IP}/\d{{1,2}})"
BRACED = R.BRACED_BLOCK.replace("(?msd)", "(?ms)")


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _all(p: str, g: int = 1) -> str:
    return f"regexp_extract_all(txt, {_q(p)}, {g})"


def _ip_num(c: str) -> str:
    return f"((split_part({c}, '.', 1)::BIGINT * 256 + split_part({c}, '.', 2)::BIGINT) * 256 + split_part({c}, '.', 3)::BIGINT) * 256 + split_part({c}, '.', 4)::BIGINT"


def _valid(c: str) -> str:
    o = " AND ".join(f"try_cast(split_part({c}, '.', {i}) AS INT) <= 255" for i in range(1, 5))
    return f"regexp_full_match({c}, '(?:(?:0|[1-9]\\d{{0,2}})\\.){{3}}(?:0|[1-9]\\d{{0,2}})') AND {o}"


def _first(*patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(txt, {_q(p)}, 1), '')" for p in patterns) + ", '')"


def _listed(p: str, *names: str, where: str = "true", source: str = "dev") -> str:
    """host, names, p of every match of a pattern in txt, one row each."""
    return f"SELECT host, {', '.join(f'unnest({_all(p, i + 1)}) AS {n}' for i, n in enumerate(names))}, unnest(range(len({_all(p)}))) AS p FROM {source} WHERE {where}"


def _words(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {_q(w)})" for w in words) + ")"


def _by_word(column: str, words: tuple, other: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), {_q(w)}) THEN {_q(v)}" for w, v in words) + f" ELSE {_q(other)} END"


def _public(n: str) -> str:
    return f"{n} IS NOT NULL AND NOT (" + " OR ".join(f"{n} BETWEEN {sanitize.number_of(a)} AND {sanitize.number_of(b)}" for a, b in R.NOT_PUBLIC) + ")"


def _addresses() -> str:
    return f""", br AS ({_listed(BRACED, "name", "body")}),
sb AS (SELECT host, name, arg_min(ip, p) AS ip, min(p) AS p FROM (SELECT host, name, p, regexp_extract(body, {_q(R.BRACED_ADDRESS)}, 1) AS ip FROM br) WHERE ip <> '' GROUP BY ALL),
al AS (SELECT host, CASE WHEN platform LIKE 'junos%' THEN list_concat({_all(R.JUNOS_ADDRESS)}, {_all(R.JUNOS_BLOCK_ADDRESS)}) WHEN platform IN ('eos', 'arista', 'frr', 'ios') THEN {_all(R.LINE_ADDRESS)} ELSE list_concat({_all(R.JUNOS_ADDRESS)}, {_all(R.LINE_ADDRESS)}) END AS l FROM dev),
a0 AS (SELECT host, unnest(l) AS cidr, unnest(range(len(l))) AS p FROM al UNION ALL SELECT host, ip, 1000000 + p FROM sb),
a1 AS (SELECT host, cidr, min(p) AS p FROM a0 WHERE {_valid("split_part(cidr, '/', 1)")} AND split_part(cidr, '/', 2)::INT <= 32 GROUP BY ALL),
a2 AS (SELECT host, cidr, p AS pos, {_ip_num("split_part(cidr, '/', 1)")} AS ip_num, split_part(cidr, '/', 2)::BIGINT AS length FROM a1),
addr AS (SELECT a2.host, coalesce(site_id, '') AS site_id, pos, cidr, ip_num, ip_num - ip_num % (1::BIGINT << (32 - length)) AS net_num, length FROM a2 JOIN dev USING (host))"""


def _peers() -> str:
    return f""", pe AS (SELECT DISTINCT host, ip FROM ({_listed(R.BGP_PEER, "ip")}) WHERE {_valid("ip")}),
pn AS (SELECT host, ip, arg_max(asn, p)::BIGINT AS asn, min(p) AS p FROM ({_listed(R.BGP_PEER_AS, "ip", "asn")}) WHERE {_valid("ip")} GROUP BY host, ip),
peers AS (SELECT pe.host, pe.ip, pn.asn FROM pe LEFT JOIN pn USING (host, ip))"""


def _wide() -> str:
    cols = [f"{_first(*R.LOCAL_AS)} AS local_asn", f"{_first(*R.ROUTER_ID)} AS ospf_router_id", f"{_first(*R.VERSION)} AS version", f"{_first(R.MODEL)} AS model"]
    cols += [f"regexp_matches(txt, {_q(p)}) AS {n}" for n, p in R.FLAGS] + [f"len({_all(p, 0)}) AS n_{n}" for n, p in R.COUNTS]
    return f', wide AS (SELECT host, site_id, platform, "function", length(txt) AS size, {", ".join(cols)} FROM dev)'


def _edges() -> str:
    stem = "'^(.+?-(?:fw|rt|sw)-)(\\d+)([ab]?)$'"
    return f""", hs AS (SELECT host, coalesce(site_id, '') AS site_id FROM dev),
ds AS (SELECT host, site_id, regexp_replace(d, '^\\s+|\\s+$', '', 'g') AS description FROM ({_listed(R.DESCRIPTION, "d")}) JOIN hs USING (host)),
dl AS (SELECT *, host || ' description: ''' || substr(description, 1, 50) || '''' AS evidence FROM ds),
ml AS (SELECT DISTINCT host, ip, site_id FROM ({_listed(R.MLAG_PEER, "ip")}) JOIN hs USING (host) WHERE {_valid("ip")}),
nm AS (SELECT DISTINCT s.host, s.description, s.evidence, o.host AS other FROM dl s JOIN hs o ON s.site_id = o.site_id AND contains(lower(s.description), lower(o.host)) AND s.host <> o.host),
sh AS (SELECT DISTINCT s.host, s.description, s.evidence, o.host AS other FROM dl s JOIN hs o ON s.site_id = o.site_id AND s.host <> o.host AND contains(o.host, '-') AND list_contains(regexp_split_to_array(lower(s.description), '\\s+'), lower(substr(o.host, instr(o.host, '-') + 1)))
 WHERE NOT contains(lower(s.description), lower(o.host))),
st AS (SELECT host, coalesce(site_id, '') AS site_id, cluster, regexp_extract(host, {stem}, 1) AS stem, try_cast(regexp_extract(host, {stem}, 2) AS BIGINT) AS n, regexp_extract(host, {stem}, 2) AS t, regexp_extract(host, {stem}, 3) AS side FROM wide WHERE regexp_extract(host, {stem}, 1) <> ''),
cand AS (SELECT DISTINCT least(a, b) AS source, greatest(a, b) AS target, rule, confidence, rnk, evidence FROM (
 SELECT host AS a, other AS b, 'description-hostname' AS rule, 0.95::DOUBLE AS confidence, 0 AS rnk, evidence FROM nm
 UNION ALL SELECT host, other, 'description-shortform', 0.7, 1, evidence FROM sh
 UNION ALL SELECT m.host, x.host, 'mlag-peer', 1.0, 2, m.host || ' -> ' || m.ip || ' of ' || x.host FROM ml m JOIN addr x ON m.site_id = x.site_id AND m.ip = split_part(x.cidr, '/', 1)
 UNION ALL SELECT p.host, x.host, 'bgp-neighbor', 0.95, 3, p.host || ' -> ' || p.ip || ' of ' || x.host FROM peers p JOIN hs USING (host) JOIN addr x ON hs.site_id = x.site_id AND p.ip = split_part(x.cidr, '/', 1)
 UNION ALL SELECT x.host, y.host, 'subnet-co-membership', 0.85, 4, 'both on /' || x.length FROM addr x JOIN addr y ON x.site_id = y.site_id AND x.net_num = y.net_num AND x.length = y.length AND x.length BETWEEN 28 AND 31
 UNION ALL SELECT x.host, y.host, 'ha-pair-naming', 0.9, 5, 'names and cluster flag' FROM st x JOIN st y ON x.site_id = y.site_id AND x.stem = y.stem AND (x.cluster OR y.cluster) AND ((x.side = 'a' AND y.side = 'b' AND x.t = y.t) OR (x.side = '' AND y.side = '' AND y.n = x.n + 1))) WHERE a <> b),
best AS (SELECT source, target, arg_max(rule, (confidence, -rnk)) AS rule, max(confidence) AS confidence, arg_min(evidence, (-confidence, rnk, evidence)) AS evidence, count(DISTINCT rule) AS n_rules FROM cand GROUP BY 1, 2)"""


def _interfaces() -> str:
    """ifs: interfaces of every form, keyed by the order in which they stand; needs br."""
    junos = "platform LIKE 'junos%'"
    by_name = " ".join(f"WHEN starts_with(lower(name), {_q(a)}) THEN {_q(b)}" for a, b in R.SPEED_BY_NAME)
    speed = f"regexp_extract(body, {_q(R.SPEED)}, 1), regexp_extract(body, {_q(R.SPEED)}, 2)"
    ospf = ", ".join(f"CAST(arg_max(regexp_extract(body, {_q(p)}, 1), k) FILTER (regexp_extract(body, {_q(p)}, 1) <> '') AS {'BIGINT' if t == 'bigint' else 'VARCHAR'}) AS ospf_{n}" for n, p, t in R.OSPF)
    return f""", i0 AS (SELECT host, p AS k, name, v AS ip, '' AS d, '' AS sn, '' AS su, '' AS body FROM ({_listed(R.SET_ADDRESS, "name", "v", where=junos)})
 UNION ALL SELECT host, 1000000 + p, name, '', v, '', '', '' FROM ({_listed(R.SET_DESCRIPTION, "name", "v", where=junos)})
 UNION ALL SELECT host, 2000000 + p, name, '', '', v, u, '' FROM ({_listed(R.SET_SPEED, "name", "v", "u", where=junos)})
 UNION ALL SELECT host, 3000000 + p, name, regexp_extract(body, {_q(R.LINE_ADDRESS)}, 1), regexp_extract(body, {_q(R.BLOCK_DESCRIPTION)}, 1), {speed}, '' FROM ({_listed(R.INTERFACE_BLOCK, "name", "body")})
 UNION ALL SELECT host, 4000000 + p, name, regexp_extract(body, {_q(R.BRACED_ADDRESS)}, 1), regexp_extract(body, {_q(R.BRACED_DESCRIPTION)}, 1), {speed}, body FROM br),
i1 AS (SELECT *, regexp_replace(d, '^\\s+|\\s+$', '', 'g') AS description, CASE WHEN sn = '' THEN '' WHEN upper(su) = 'G' THEN sn::BIGINT || 'G' WHEN sn::BIGINT >= 1000 AND sn::BIGINT % 1000 = 0 THEN (sn::BIGINT // 1000) || 'G' ELSE sn::BIGINT || 'M' END AS sp FROM i0),
i2 AS (SELECT host, name, min(k) AS k, coalesce(arg_min(ip, k) FILTER (ip <> ''), '') AS ip, coalesce(arg_min(description, k) FILTER (description <> ''), '') AS description, coalesce(arg_min(sp, k) FILTER (sp <> ''), '') AS sp, {ospf} FROM i1 GROUP BY host, name),
ifs AS (SELECT * EXCLUDE (sp), CASE WHEN sp <> '' THEN sp ELSE CASE {by_name} ELSE '' END END AS speed, CASE WHEN {_valid("split_part(ip, '/', 1)")} THEN {_ip_num("split_part(ip, '/', 1)")} END AS ip_num FROM i2)"""


def _families() -> str:
    names = " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in R.FAMILY_NAMES)
    return f""", f0 AS (SELECT host, regexp_replace(lower(a), '\\s+', '-', 'g') AS a, p AS pos FROM ({_listed(R.ADDRESS_FAMILY, "a")})),
f1 AS (SELECT host, CASE a {names} ELSE a END AS a, min(pos) AS pos FROM f0 GROUP BY ALL),
f2 AS (SELECT host, a, pos FROM f1 UNION ALL SELECT d.host, 'l2vpn-evpn', 1000000 FROM dev d WHERE (regexp_matches(txt, {_q(R.EVPN_SIGNALLED)}) OR EXISTS (SELECT 1 FROM f1 WHERE f1.host = d.host AND contains(a, 'evpn'))) AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.host = d.host AND a = 'l2vpn-evpn'))"""


def _vnis() -> str:
    body = lambda p, where: f"SELECT host, unnest(regexp_extract_all(body, {_q(R.BODY_VNI)}, 1)) AS v FROM ({_listed(p, 'name', 'body', where=_q('frr') + ' = platform')}) WHERE {where}"
    return f""", vn AS (SELECT DISTINCT host, v::BIGINT AS v FROM (SELECT host, unnest(list_concat({_all(R.VNI[0])}, {_all(R.VNI[1])})) AS v FROM dev UNION ALL {body(R.INTERFACE_BLOCK, "lower(name) LIKE 'vxlan%'")})),
vb AS (SELECT DISTINCT host, v::BIGINT AS v FROM ({body(R.VRF_BLOCK, "true")})),
l2 AS (SELECT host, v FROM vn WHERE v < 50000), l3 AS (SELECT host, v FROM vn WHERE v >= 50000 UNION SELECT host, v FROM vb WHERE NOT EXISTS (SELECT 1 FROM vn WHERE vn.host = vb.host AND vn.v = vb.v))"""


def _nodes() -> str:
    """nd: facts with one value per device; needs addr and ifs."""
    flags = ", ".join(f"{_words('txt', w)} AS has_{n}" for n, w in R.NODE_WORDS)
    loops = " ".join(f"WHEN {_q(c)} THEN {i}" for i, c in enumerate(R.VTEP_LOOPBACKS))
    return f""", nd0 AS (SELECT host, site_id, platform, nullif({_first(*R.LOCAL_AS)}, '')::BIGINT AS local_asn, {_first(*R.ROUTER_ID)} AS ospf_id, {_first(*R.VTEP_SOURCE)} AS src, regexp_matches(txt, {_q(R.ADVERTISED)}) AS advertised, {flags} FROM dev),
a32 AS (SELECT host, split_part(arg_min(cidr, pos), '/', 1) AS alone FROM addr WHERE length = 32 GROUP BY 1),
dr AS (SELECT d.host, nullif(split_part(arg_min(i.ip, i.k), '/', 1), '') AS direct FROM nd0 d JOIN ifs i ON i.host = d.host AND lower(i.name) = lower(d.src) WHERE d.src <> '' GROUP BY 1),
lb AS (SELECT host, lower(name) AS c, arg_min(name, k) AS name, arg_min(ip, k) AS ip FROM ifs WHERE lower(name) IN ({", ".join(map(_q, R.VTEP_LOOPBACKS))}) GROUP BY 1, 2),
li AS (SELECT host, arg_min(name, CASE c {loops} END) AS name, arg_min(ip, CASE c {loops} END) AS ip FROM lb WHERE ip <> '' GROUP BY 1),
nd AS (SELECT n.*, coalesce(nullif(ospf_id, ''), alone, '') AS router_id, CASE WHEN direct IS NULL AND advertised THEN coalesce(nullif(src, ''), li.name, '') ELSE src END AS vtep_source, coalesce(direct, CASE WHEN advertised THEN nullif(split_part(li.ip, '/', 1), '') END, '') AS vtep_ip
 FROM nd0 n LEFT JOIN a32 USING (host) LEFT JOIN dr USING (host) LEFT JOIN li USING (host))"""


def _detail() -> str:
    """dt: links with all that they carry."""
    kinds = " ".join(f"WHEN {_q(r)} THEN {_q(k)}" for r, k in topology.KINDS)
    mbps = lambda c: f"CASE upper(right({c}, 1)) WHEN 'G' THEN 1000 * try_cast(left({c}, length({c}) - 1) AS BIGINT) WHEN 'M' THEN try_cast(left({c}, length({c}) - 1) AS BIGINT) ELSE 0 END"
    on_net = "i.ip_num BETWEEN s.net AND s.net + (1::BIGINT << (32 - s.len)::INT) - 1"
    side = lambda n: f"SELECT s.source, s.target, arg_min(i, i.k) AS i FROM sn s JOIN ifs i ON i.host = s.{n} AND {on_net} GROUP BY s.source, s.target"
    octets = " || '.' || ".join(f"((net >> {k}) & 255)" for k in (24, 16, 8, 0))
    union = lambda t: f"SELECT source, target, string_agg(v::VARCHAR, ',' ORDER BY v) AS vs FROM (SELECT DISTINCT e.source, e.target, v FROM best e JOIN {t} t ON t.host IN (e.source, e.target)) GROUP BY 1, 2"
    owns = lambda a, b: f"EXISTS (SELECT 1 FROM pe JOIN addr x ON x.host = {a} AND split_part(x.cidr, '/', 1) = pe.ip WHERE pe.host = {b})"
    return f""", sn0 AS (SELECT e.source, e.target, arg_min(struct_pack(net := y.net_num, len := y.length), y.pos) AS n FROM best e JOIN addr x ON x.host = e.source AND x.length BETWEEN 28 AND 31 JOIN addr y ON y.host = e.target AND y.net_num = x.net_num AND y.length = x.length GROUP BY 1, 2),
sn AS (SELECT source, target, n.net AS net, n.len AS len FROM sn0), si AS ({side("source")}), sj AS ({side("target")}),
oa AS (SELECT e.source, e.target, arg_min(i, (CASE WHEN {on_net} THEN 0 ELSE 1 END, i.k)) AS o FROM best e LEFT JOIN sn s USING (source, target) JOIN ifs i ON i.host = e.source AND i.ospf_area IS NOT NULL GROUP BY e.source, e.target),
pr AS (SELECT e.source, e.target, {owns("e.source", "e.target")} OR {owns("e.target", "e.source")} OR EXISTS (SELECT 1 FROM pn WHERE pn.host = e.source AND pn.asn = b.local_asn) OR EXISTS (SELECT 1 FROM pn WHERE pn.host = e.target AND pn.asn = a.local_asn) AS peering FROM best e JOIN nd a ON a.host = e.source JOIN nd b ON b.host = e.target),
pa AS (SELECT e.source, e.target, arg_min(pn.ip, pn.p) AS ip FROM best e JOIN nd b ON b.host = e.target JOIN pn ON pn.host = e.source AND pn.asn = b.local_asn GROUP BY 1, 2),
pb AS (SELECT e.source, e.target, arg_min(pn.ip, pn.p) AS ip FROM best e JOIN nd a ON a.host = e.source JOIN pn ON pn.host = e.target AND pn.asn = a.local_asn GROUP BY 1, 2),
fa AS (SELECT source, target, string_agg(a, ',' ORDER BY k) AS families FROM (SELECT e.source, e.target, a, min(CASE WHEN f2.host = e.source THEN 0 ELSE 10000000 END + pos) AS k FROM best e JOIN f2 ON f2.host IN (e.source, e.target) GROUP BY 1, 2, 3) GROUP BY 1, 2),
u2 AS ({union("l2")}), u3 AS ({union("l3")}),
d1 AS (SELECT e.*, CASE rule {kinds} ELSE 'physical' END AS kind, sn.net, sn.len, si.i AS i, sj.i AS j, oa.o AS o, CASE WHEN peering THEN a.local_asn END AS src_asn, CASE WHEN peering THEN b.local_asn END AS dst_asn, coalesce(pa.ip, '') AS src_bgp_ip, coalesce(pb.ip, '') AS dst_bgp_ip, coalesce(fa.families, '') AS families, coalesce(u2.vs, '') AS v2, coalesce(u3.vs, '') AS v3,
 a.has_ospf AND b.has_ospf AS both_ospf, (a.has_vxlan OR a.has_evpn) AND (b.has_vxlan OR b.has_evpn) AS overlay, (a.has_vxlan AND b.has_vxlan) OR (a.has_evpn AND b.has_evpn) AS tunnels, a.router_id AS ra, b.router_id AS rb, coalesce(nullif(a.vtep_ip, ''), a.router_id) AS va, coalesce(nullif(b.vtep_ip, ''), b.router_id) AS vb,
 coalesce(si.i.speed, '') AS s, coalesce(sj.i.speed, '') AS d, coalesce(trim(m.default_link_speed), '') AS dspeed
 FROM best e JOIN nd a ON a.host = e.source JOIN nd b ON b.host = e.target JOIN pr USING (source, target) LEFT JOIN sn USING (source, target) LEFT JOIN si USING (source, target) LEFT JOIN sj USING (source, target) LEFT JOIN oa USING (source, target) LEFT JOIN pa USING (source, target) LEFT JOIN pb USING (source, target) LEFT JOIN fa USING (source, target)
 LEFT JOIN u2 USING (source, target) LEFT JOIN u3 USING (source, target) LEFT JOIN site_manifest m ON m.site_id = a.site_id),
d2 AS (SELECT *, CASE WHEN s = '' THEN d WHEN d = '' THEN s WHEN {mbps("d")} < {mbps("s")} THEN d ELSE s END AS fs FROM d1),
dt AS (SELECT source, target, kind, rule, confidence, CASE WHEN net IS NULL THEN '' ELSE {octets} || '/' || len END AS subnet, coalesce(i.name, '') AS src_iface, coalesce(i.ip, '') AS src_ip, coalesce(j.name, '') AS dst_iface, coalesce(j.ip, '') AS dst_ip,
 coalesce(nullif(i.description, ''), nullif(j.description, ''), CASE WHEN contains(evidence, 'description:') THEN substr(trim(trim(split_part(evidence, 'description:', -1)), '''"'), 1, 80) END, '') AS description, CASE WHEN fs = '' AND s = '' THEN dspeed ELSE s END AS src_speed, CASE WHEN fs = '' AND d = '' THEN dspeed ELSE d END AS dst_speed, CASE WHEN fs = '' THEN dspeed ELSE fs END AS speed,
 src_asn, dst_asn, CASE WHEN src_asn <> dst_asn THEN 'ebgp' WHEN src_asn = dst_asn THEN 'ibgp' ELSE '' END AS bgp_type, src_bgp_ip, dst_bgp_ip, families, CASE WHEN both_ospf THEN ra ELSE '' END AS src_router_id, CASE WHEN both_ospf THEN rb ELSE '' END AS dst_router_id, CASE WHEN both_ospf THEN coalesce(o.ospf_area, '') ELSE '' END AS ospf_area,
 CASE WHEN both_ospf THEN o.ospf_hello END AS ospf_hello, CASE WHEN both_ospf THEN o.ospf_dead END AS ospf_dead, CASE WHEN both_ospf THEN o.ospf_cost END AS ospf_cost, CASE WHEN both_ospf THEN coalesce(o.ospf_network_type, '') ELSE '' END AS ospf_network_type, CASE WHEN overlay THEN va ELSE '' END AS src_vtep, CASE WHEN overlay THEN vb ELSE '' END AS dst_vtep,
 CASE WHEN overlay THEN v2 ELSE '' END AS l2_vnis, CASE WHEN overlay THEN v3 ELSE '' END AS l3_vnis, 'physical' || CASE WHEN kind = 'bgp' OR (src_asn IS NOT NULL AND dst_asn IS NOT NULL) THEN ',bgp' ELSE '' END || CASE WHEN both_ospf THEN ',ospf' ELSE '' END || CASE WHEN tunnels THEN ',vxlan' ELSE '' END AS layers FROM d2)"""


def _network() -> str:
    return DEV + _wide() + _addresses() + _peers() + _interfaces() + _families() + _vnis() + _nodes()


def _vlans() -> str:
    """vl: host, vlan_id, name, subnets LIST."""
    jun = "platform LIKE 'jun%'"
    pair = lambda p, where, k: f"SELECT host, a, b, p + {k} AS p FROM ({_listed(p, 'a', 'b', where=where)})"
    swap = lambda p, where, k: f"SELECT host, b AS a, a AS b, p + {k} AS p FROM ({_listed(p, 'a', 'b', where=where)})"
    return f""", vname AS ({swap(segments.VLAN_BLOCK, jun, 0)} UNION ALL {swap(segments.VLAN_SET, jun, 1000000)} UNION ALL {pair(segments.VLAN_LINE, "NOT " + jun, 0)}),
vnet AS ({pair(segments.SUBNET_BLOCK, jun, 0)} UNION ALL {pair(segments.SUBNET_LINE, "NOT " + jun, 0)}),
vnet1 AS (SELECT host, a, b, min(p) AS p FROM vnet GROUP BY ALL),
vl AS (SELECT host, a::INT AS vlan_id, coalesce(max(nm), '') AS name, coalesce(first(ns) FILTER (ns IS NOT NULL), []) AS subnets FROM (
 SELECT host, a, coalesce(arg_min(b, p) FILTER (b <> ''), '') AS nm, NULL::VARCHAR[] AS ns FROM vname GROUP BY ALL UNION ALL SELECT host, a, NULL, list(b ORDER BY p) FROM vnet1 GROUP BY ALL) GROUP BY 1, 2)"""


def _vlan_kinds() -> str:
    octet = lambda i: f"try_cast(split_part(split_part(net, '/', 1), '.', {i}) AS INT)"
    nets = " ".join(f"WHEN {octet(1)} = 10 AND {octet(2)} = {a} AND {octet(3)} BETWEEN {lo} AND {hi} THEN {_q(k)}" for a, lo, hi, k in segments.SUBNET_KINDS)
    numbers = " ".join(f"WHEN vlan_id IN ({', '.join(map(str, ns))}) THEN {_q(k)}" for ns, k in segments.NUMBER_KINDS)
    return f""", vn1 AS (SELECT host, vlan_id, unnest(subnets) AS net, unnest(range(len(subnets))) AS p FROM vl),
vn2 AS (SELECT vlan_id, count(DISTINCT net) AS n_subnets, arg_min(k, (host, p)) FILTER (k IS NOT NULL) AS k FROM (SELECT *, CASE {nets} END AS k FROM vn1) GROUP BY 1),
vm AS (SELECT vlan_id, coalesce(arg_min(name, host) FILTER (name <> ''), '') AS name, count(*) AS n_hosts FROM vl GROUP BY 1),
vk AS (SELECT vlan_id, name, n_hosts, coalesce(n_subnets, 0) AS n_subnets, coalesce(k, nullif({_by_word("name", segments.VLAN_KINDS, "")}, ''), CASE {numbers} WHEN vlan_id >= {segments.LAST_NUMBERS} THEN {_q(segments.LAST_KIND)} ELSE 'Other' END) AS kind FROM vm LEFT JOIN vn2 USING (vlan_id))"""


NESTED = """, nl AS (SELECT host, unnest(string_split(txt, chr(10))) AS l, unnest(range(len(string_split(txt, chr(10))))) AS pos FROM dev WHERE platform LIKE 'jun%'),
 no AS (SELECT *, nullif(regexp_extract(l, '^\\s*((?:ge|xe|et|ae|eth|reth|fe|me|fxp|st|lo)\\S*)\\s*\\{', 1), '') AS opened, nullif(regexp_extract(l, '^\\s*description\\s+"?([^";\\n]+)"?\\s*;', 1), '') AS d, nullif(regexp_extract(l, 'address\\s+(\\d{1,3}(?:\\.\\d{1,3}){3}(?:/\\d{1,2})?)\\s*;', 1), '') AS ip FROM nl),
 ns AS (SELECT *, count(opened) OVER w AS blk, sum(len(l) - len(replace(l, '{', '')) - len(l) + len(replace(l, '}', ''))) OVER w AS depth, len(l) - len(replace(l, '{', '')) - len(l) + len(replace(l, '}', '')) AS net FROM no WINDOW w AS (PARTITION BY host ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 nt AS (SELECT *, min(depth) OVER (PARTITION BY host, blk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low, first_value(depth - net) OVER (PARTITION BY host, blk ORDER BY pos) AS opened_at, first_value(opened) OVER (PARTITION BY host, blk ORDER BY pos) AS name FROM ns WHERE blk > 0),
 nest AS (SELECT x.host, x.pos, x.name, x.ip, coalesce((SELECT arg_max(regexp_replace(d, '^\\s+|\\s+$', '', 'g'), pos) FROM nt y WHERE y.host = x.host AND y.blk = x.blk AND y.pos <= x.pos AND d IS NOT NULL), '') AS description FROM nt x WHERE x.ip IS NOT NULL AND (x.low IS NULL OR x.low > x.opened_at))"""


def _wan() -> str:
    """wan: public addresses of interfaces with their carriers; needs ifs of _interfaces()."""
    jun = "platform LIKE 'jun%'"
    return NESTED + f""", sa AS ({_listed(segments.SET_ADDRESS, "name", "unit", "ip", where=jun)}), sd AS (SELECT host, name, arg_min(regexp_replace(d, '^\\s+|\\s+$', '', 'g'), p) AS description FROM ({_listed(segments.SET_DESCRIPTION, "name", "d", where=jun)}) GROUP BY 1, 2),
 jw AS (SELECT host, ip, arg_min(struct_pack(name := name, description := description), (form, pos)) AS x FROM (SELECT host, name, ip, description, 0 AS form, pos FROM nest UNION ALL SELECT host, name || '.' || unit, ip, coalesce(description, ''), 1, p FROM sa LEFT JOIN sd USING (host, name)) GROUP BY 1, 2),
 bi AS (SELECT host, name, coalesce(arg_min(ip, k) FILTER (ip <> ''), '') AS ip, coalesce(arg_min(description, k) FILTER (description <> ''), '') AS description FROM i1 WHERE k BETWEEN 3000000 AND 3999999 GROUP BY 1, 2),
 w0 AS (SELECT host, x.name AS name, ip, x.description AS description FROM jw UNION ALL SELECT host, name, ip, description FROM bi JOIN (SELECT host, platform FROM dev) USING (host) WHERE NOT {jun}),
 w1 AS (SELECT *, CASE WHEN {_valid("split_part(ip, '/', 1)")} THEN {_ip_num("split_part(ip, '/', 1)")} END AS n FROM w0),
 wan AS (SELECT host, name, ip, description, {_by_word("description", segments.CARRIERS, "")} AS carrier FROM w1 WHERE {_public("n")})"""


def _carriers() -> str:
    case: dict[str, str] = {}
    for word, name in segments.CARRIERS:
        case.setdefault(name, f"WHEN {_q(name)} THEN regexp_extract(txt, {_q(rf'(?i)description[^;]*{word}[^;]*[\s\S]{{0,500}}?peer-as\s+(\d+)')}, 1)")
    off = r"'(?i)(?:deactivate\s+interfaces\s+\Q' || name || '\E|interfaces\s+\Q' || name || '\E[\s\S]{0,200}disable)'"
    return f""", cw AS (SELECT w.*, nullif(CASE carrier {" ".join(case.values())} ELSE '' END, '') AS asn, regexp_matches(lower(description), 'disabled|shutdown|decommis') OR regexp_matches(txt, {off}) AS down FROM wan w JOIN dev USING (host) WHERE carrier <> '')"""


def _checks() -> str:
    parts = []
    for rule_id, _, severity, platforms, required, forbidden, condition, least in R.COMPLIANCE:
        m = lambda p: f"regexp_matches(txt, {_q('(?im)' + p)})"
        case = [f"WHEN {m(p)} THEN {_q('Forbidden pattern matched: ' + p[:60])}" for p in forbidden]
        if least:
            n = f"len(regexp_extract_all(txt, {_q('(?im)' + least[0])}))"
            case.append(f"WHEN {n} < {least[1]} THEN 'Only ' || {n} || {_q(f" match(es) of '{least[0][:40]}'; need ≥{least[1]}")}")
        if required:
            case.append(f"WHEN NOT ({' OR '.join(map(m, required))}) THEN 'None of the required patterns matched'")
        where = f"platform IN ({', '.join(map(_q, platforms))})" + (f" AND ({' OR '.join(map(m, condition))})" if condition else "")
        parts.append(f"SELECT {_q(rule_id)} AS rule_id, {_q(severity)} AS severity, host AS device, CASE {' '.join(case)} ELSE 'ok' END AS reason FROM dev WHERE {where}")
    return ", ck AS (SELECT *, reason = 'ok' AS passed FROM (" + " UNION ALL ".join(parts) + "))"


def _sanitize(source: str = "SELECT profile_id AS id, regexp_replace(config_text, '\\r', '', 'g') AS t FROM device_profile") -> str:
    steps = [f"s0 AS ({source})"]
    for i, (_, p, r) in enumerate(R.SECRETS):
        carried = "".join(f", n{k}" for k in range(i))
        steps.append(f"s{i + 1} AS (SELECT id, regexp_replace(t, {_q(p)}, {_q(r)}, 'g') AS t{carried}, len(regexp_extract_all(t, {_q(p)})) AS n{i} FROM s{i})")
    return "WITH " + ", ".join(steps)


def _mask_names(source: str) -> str:
    """named(id, n, t) from source(id, n, t); nc0, nc1, ... count what each rule finds."""
    out, at = "", source
    for i, (_, p, r) in enumerate(sanitize.NAMES):
        out += f", nc{i} AS (SELECT id, n, t, len(regexp_extract_all(t, {_q(p)})) AS c, regexp_split_to_array(t, {_q(p)}) AS ps, regexp_extract_all(t, {_q(p)}, 1) AS g1" + (f", regexp_extract_all(t, {_q(p)}, 2) AS g2, regexp_extract_all(t, {_q(p)}, 3) AS g3" if r == "token" else "") + f" FROM {at})"
        if r == "token":
            new = "array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce(g1[i] || ' user-' || substr(sha256('username:' || lower(g2[i])), 1, 8) || g3[i], '')), '')"
        else:
            new = f"regexp_replace(t, {_q(p)}, {_q(r.replace('$', chr(92)))}, 'g')"
        at = f"nm{i}"
        out += f", {at} AS (SELECT id, n + c AS n, {new} AS t FROM nc{i})"
    return out + f", named AS (SELECT * FROM {at})"


def _mask_public(source: str) -> str:
    """masked(id, n, t) from source(id, n, t)."""
    return f""", mu AS (SELECT id, n, unnest(regexp_split_to_array(t, {_q(sanitize.IPV4)})) AS piece, unnest(list_append(regexp_extract_all(t, {_q(sanitize.IPV4)}), '')) AS x, unnest(range(len(regexp_split_to_array(t, {_q(sanitize.IPV4)})))) AS pos FROM {source}),
 mn AS (SELECT *, CASE WHEN {_valid("x")} THEN {_ip_num("x")} END AS num FROM mu), mp AS (SELECT id, n, piece, pos, {_public("num")} AS pub, x FROM mn),
 masked AS (SELECT id, any_value(n) + count(*) FILTER (pub) AS n, string_agg(piece || CASE WHEN pub THEN 'PUB-' || substr(sha256({_q(sanitize.SALT + ":")} || x), 1, 8) ELSE x END, '' ORDER BY pos) AS t FROM mp GROUP BY id)"""


def _lines() -> str:
    case = " ".join(f"WHEN regexp_matches(l, {_q(p)}) THEN {_q(n)}" for n, p, _ in R.LINE_FORMATS)

    def part(k: int, free: str) -> str:
        return "CASE fmt " + " ".join(f"WHEN {_q(n)} THEN " + (f"regexp_extract(l, {_q(p)}, {g[k]})" if g[k] else "''") for n, p, g in R.LINE_FORMATS) + f" ELSE {free} END"

    sev = "[" + ", ".join(map(_q, R.RAW_SEVERITIES)) + "]"
    return f"""WITH l0 AS (SELECT seq, coalesce(default_host, '') AS dh, regexp_replace(regexp_replace(line, '^﻿+', ''), '^\\s+|\\s+$', '', 'g') AS l FROM raw_line),
l1 AS (SELECT *, CASE {case} ELSE 'free' END AS fmt FROM l0 WHERE l <> ''),
l2 AS (SELECT seq, fmt, dh, {part(0, "''")} AS pri, {part(1, "''")} AS "timestamp", {part(2, "''")} AS h, {part(3, "'syslog'")} AS app, regexp_replace({part(4, "l")}, '^\\s+|\\s+$', '', 'g') AS message FROM l1),
ln AS (SELECT seq, fmt, "timestamp", CASE WHEN h <> '' THEN h ELSE dh END AS hostname, CASE WHEN fmt = 'terminal' THEN 'scrt-session' ELSE app END AS appname, CASE WHEN pri <> '' THEN {sev}[(pri::INT & 7) + 1] ELSE 'info' END AS severity_raw, message FROM l2 WHERE fmt <> 'terminal' OR message <> '')"""


def queries() -> dict[str, str]:
    life = ", ".join(f"({e}, {_q(r[0])}, {_q(r[1])}, {_q(r[2])}, {_q(r[3])})" for e, rows in (("true", R.EOS_LIFECYCLE), ("false", R.JUNOS_LIFECYCLE)) for r in rows)
    ends = " UNION ALL ".join(f"SELECT host, {_q(n)} AS service, unnest({_all(p)}) AS v, unnest(range(len({_all(p)}))) AS pos FROM dev" for n, p in R.ENDPOINTS)
    endpoint = f""", e0 AS (SELECT host, service, regexp_replace(v, '^[ ;,\\t\\r\\n]+|[ ;,\\t\\r\\n]+$', '', 'g') AS v, pos FROM ({ends})),
e1 AS (SELECT host, service, v, min(pos) AS pos FROM e0 WHERE regexp_full_match(v, '[A-Za-z0-9._:-]+') GROUP BY ALL),
ep AS (SELECT host, service, string_agg(v, ',' ORDER BY pos) AS endpoints FROM (SELECT *, row_number() OVER (PARTITION BY host, service ORDER BY pos) AS k FROM e1) WHERE k <= 8 GROUP BY ALL)"""
    own = lambda p: _q("(?im)" + (p if re.search(r"[\\.*+?]", p) else re.escape(p)))
    search = " UNION ALL ".join(f"SELECT {_q(p)} AS pattern, host AS device, txt, regexp_extract_all(txt, {own(p)}) AS m, regexp_split_to_array(txt, {own(p)}) AS p FROM dev" for p in SEARCHES)
    section = " ".join(f"WHEN regexp_matches(lower(line), {_q(p)}) THEN {_q(n)}" for n, p in R.SECTIONS)
    hints = " ".join(f"WHEN regexp_matches(message, {_q(p)}) THEN {_q(s)}" for p, s in R.HINTS)
    rl = _q(R.ROUTING_LINE)
    return {
        "parse_lines": _lines() + ' SELECT seq, fmt, "timestamp", hostname, appname, severity_raw, message FROM ln',
        "parse_format_counts": _lines() + " SELECT fmt, severity_raw, count(*) AS n FROM ln GROUP BY ALL",
        "routing_lines": f"""WITH r0 AS (SELECT seq, coalesce(default_host, '') AS hostname, regexp_replace(line, '\\s+$', '') AS l FROM raw_line),
 r1 AS (SELECT seq, hostname, regexp_matches(l, {rl}) AS hit, l FROM r0 WHERE l <> ''),
 r2 AS (SELECT seq, hostname, CASE WHEN hit THEN replace(regexp_replace(regexp_extract(l, {rl}, 1), '\\s+', 'T', 'g'), '/', '-') ELSE '' END AS "timestamp", CASE WHEN hit THEN lower(regexp_extract(l, {rl}, 2)) ELSE 'frr' END AS appname,
 regexp_replace(CASE WHEN hit THEN regexp_extract(l, {rl}, 4) ELSE l END, '^\\s+|\\s+$', '', 'g') AS message FROM r1)
 SELECT seq, hostname, "timestamp", appname, CASE {hints} ELSE 'info' END AS severity_raw, message FROM r2""",
        "sanitize_text": _sanitize() + f" SELECT id, {' + '.join(f'coalesce(n{i}, 0)' for i in range(len(R.SECRETS)))} AS n, sha256(t) AS digest FROM s{len(R.SECRETS)}",
        "sanitize_report": _sanitize() + " " + " UNION ALL ".join(f"SELECT {_q(r[0])} AS rule, sum(n{i})::BIGINT AS n FROM s{len(R.SECRETS)} HAVING sum(n{i}) > 0" for i, r in enumerate(R.SECRETS)),
        "mask_public_ipv4": "WITH t AS (SELECT doc_id AS id, 0 AS n, text AS t FROM documents)" + _mask_public("t") + " SELECT id, n, sha256(t) AS digest FROM masked",
        "device_ips": DEV + _addresses() + " SELECT host, cidr, ip_num, net_num, length FROM addr",
        "bgp_peers": DEV + _peers() + " SELECT host, ip, asn FROM peers",
        "mlag_peers": DEV + f" SELECT DISTINCT host, ip FROM (SELECT host, unnest({_all(R.MLAG_PEER)}) AS ip FROM dev) WHERE {_valid('ip')}",
        "descriptions": DEV + f" SELECT host, pos, regexp_replace(d, '^\\s+|\\s+$', '', 'g') AS description FROM (SELECT host, unnest({_all(R.DESCRIPTION)}) AS d, unnest(range(len({_all(R.DESCRIPTION)}))) AS pos FROM dev)",
        "interfaces": DEV + _addresses() + _interfaces() + " SELECT host, name, ip, description, speed FROM ifs",
        "address_families": DEV + _families() + " SELECT d.host, coalesce(string_agg(a, ',' ORDER BY pos), '') AS families FROM dev d LEFT JOIN f2 USING (host) GROUP BY 1",
        "device_profiles": DEV + _wide() + " SELECT * FROM wide",
        "named_values": DEV + _vnis() + f""", vw AS (SELECT host, regexp_replace(unnest(list_concat(list_concat({_all(R.VRF[0])}, {_all(R.VRF[1])}), {_all(R.VRF[2])})), '[{{\\s]+$', '') AS value FROM dev)
 SELECT host, 'l2_vni' AS kind, v::VARCHAR AS value FROM l2 UNION SELECT host, 'l3_vni', v::VARCHAR FROM l3 UNION SELECT host, 'vrf', value FROM vw WHERE value <> '' AND lower(value) NOT IN ({", ".join(map(_q, R.VRF_SKIP))}) UNION SELECT host, 'area', unnest({_all(R.OSPF_AREA)}) FROM dev
 UNION SELECT host, 'zone', unnest({_all(R.ZONE)}) FROM dev UNION SELECT host, 'loopback', unnest(CASE WHEN platform LIKE 'jun%' THEN {_all(R.LOOPBACK_JUNOS)} WHEN platform IN ('eos', 'frr', 'ios') THEN {_all(R.LOOPBACK_LINE)} ELSE [] END) FROM dev""",
        "service_endpoints": DEV + endpoint + " SELECT host, service, endpoints FROM ep",
        "lifecycle": DEV + _wide() + f""", l AS (SELECT * FROM (VALUES {life}) t(eos, prefix, released, ends, status)),
 j AS (SELECT w.host, w.platform, w.version, arg_max(l, length(l.prefix)) AS l FROM wide w LEFT JOIN l ON l.eos = (w.platform IN ('eos', 'arista')) AND starts_with(w.version, l.prefix) AND w.version <> '' GROUP BY ALL)
 SELECT host, platform, version, coalesce(l.released, '') AS released, coalesce(l.ends, '') AS ends, CASE WHEN version = '' THEN {_q(R.NO_VERSION)} ELSE coalesce(l.status, {_q(R.NOT_LISTED)}) END AS status FROM j""",
        "edge_candidates": DEV + _wide() + _addresses() + _peers() + _edges() + " SELECT DISTINCT source, target, rule, confidence FROM cand",
        "edges_best": DEV + _wide() + _addresses() + _peers() + _edges() + " SELECT source, target, rule, confidence, evidence, n_rules FROM best",
        "compliance_checks": DEV + _checks() + " SELECT rule_id, severity, device, passed, reason FROM ck",
        "compliance_rollup": DEV + _checks() + " SELECT rule_id, count(*) FILTER (passed) AS n_pass, count(*) FILTER (NOT passed) AS n_fail, floor(100 * count(*) FILTER (passed) / count(*) + 0.5)::BIGINT AS percent, coalesce(string_agg(device || ': ' || reason, '|' ORDER BY device, reason) FILTER (NOT passed), '') AS failing FROM ck GROUP BY 1",
        "compliance_totals": DEV + _checks() + " SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, CASE WHEN count(*) > 0 THEN (1000 * count(*) FILTER (passed)) // count(*) ELSE 0 END AS per_mille FROM ck",
        "fleet_search": DEV + f""", se AS ({search}), sm AS (SELECT *, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS b FROM (SELECT *, unnest(range(1, least(len(m), 5) + 1)) AS i FROM se WHERE len(m) > 0)),
 sn AS (SELECT pattern, device, string_agg(replace(substr(txt, greatest(b - 40, 0) + 1, least(b + length(m[i]) + 40, length(txt)) - greatest(b - 40, 0)), chr(10), ' ⏎ '), '|' ORDER BY i) AS snippets FROM sm GROUP BY 1, 2)
 SELECT pattern, device, len(m) AS match_count, snippets FROM se JOIN sn USING (pattern, device)""",
        "fleet_search_totals": DEV + f" SELECT pattern, count(*) AS devices, sum(len(m))::BIGINT AS matches, (SELECT count(*) FROM dev) AS checked FROM ({search}) WHERE len(m) > 0 GROUP BY 1",
        "role_counts": DEV + " SELECT split_part(host, '-', 2) AS role, count(*) AS n FROM dev GROUP BY 1",
        "version_counts": DEV + _wide() + " SELECT version, count(*) AS n FROM wide WHERE version <> '' GROUP BY 1",
        "composition": DEV + _wide() + """ SELECT coalesce(nullif("function", ''), 'unknown') AS role, count(*) AS n, coalesce(string_agg(DISTINCT nullif(version, ''), ',' ORDER BY nullif(version, '')), '') AS versions, coalesce(string_agg(DISTINCT nullif(model, ''), ',' ORDER BY nullif(model, '')), '') AS models, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM wide GROUP BY 1""",
        "bgp_split": DEV + _wide() + _peers() + """ SELECT d.site_id, count(*) AS sessions, count(*) FILTER (i.asn IS NOT NULL) AS ibgp, count(*) FILTER (i.asn IS NULL) AS ebgp FROM peers p JOIN dev d USING (host) LEFT JOIN (SELECT DISTINCT local_asn::BIGINT AS asn FROM wide WHERE local_asn <> '') i ON i.asn = p.asn WHERE p.asn IS NOT NULL GROUP BY 1""",
        "asn_holders": DEV + _wide() + " SELECT local_asn, count(*) AS n, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM wide WHERE local_asn <> '' GROUP BY 1",
        "remote_as_top": DEV + _wide() + _addresses() + _peers() + _interfaces() + _wan() + _carriers() + """, ra AS (SELECT asn, count(*) AS n FROM peers WHERE asn IS NOT NULL GROUP BY 1 ORDER BY n DESC, asn LIMIT 15), cn AS (SELECT asn::BIGINT AS asn, min(carrier) AS carrier FROM (SELECT carrier, arg_min(asn, host) FILTER (asn IS NOT NULL) AS asn FROM cw GROUP BY 1) WHERE asn IS NOT NULL GROUP BY 1)
 SELECT ra.asn, n, coalesce(carrier, CASE WHEN ra.asn IN (SELECT local_asn::BIGINT FROM wide WHERE local_asn <> '') THEN 'internal/iBGP' END, 'external (unknown)') AS identity FROM ra LEFT JOIN cn USING (asn)""",
        "missing_services": DEV + _wide() + endpoint + f""", ms AS (SELECT w.host, w.site_id, snmp_v2c, {", ".join(f"EXISTS (SELECT 1 FROM ep WHERE ep.host = w.host AND service IN ({names})) AS has_{n}" for n, names in (("ntp", "'ntp'"), ("syslog", "'syslog'"), ("aaa", "'radius', 'tacacs'")))} FROM wide w)
 SELECT site_id, count(*) AS devices, {", ".join(f"coalesce(string_agg(host, ',' ORDER BY host) FILTER ({c}), '') AS {n}" for n, c in (("no_ntp", "NOT has_ntp"), ("no_syslog", "NOT has_syslog"), ("no_aaa", "NOT has_aaa"), ("snmp_v2c", "snmp_v2c")))} FROM ms GROUP BY 1""",
        "facilities": "SELECT site_id, coalesce(f.city, 'Unknown city') AS city FROM site_manifest LEFT JOIN (VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b, _ in R.FACILITIES) + ") f(code, city) ON f.code = lower(left(site_id, 3))",
        "site_inventory": "SELECT s.site_id, s.vendor, coalesce(d.n, 0) AS devices, coalesce(c.n, 0) AS captures, coalesce(c.b, 0) AS bytes FROM site_manifest s LEFT JOIN (SELECT site_id, count(*) AS n FROM device_inventory GROUP BY 1) d USING (site_id) LEFT JOIN (SELECT site_id, count(*) AS n, sum(config_size_bytes)::BIGINT AS b FROM device_profile GROUP BY 1) c USING (site_id)",
        "diff_sections": """WITH d AS (SELECT DISTINCT profile_id, nullif(lower(split_part(trim(hostname), '.', 1)), '') AS host, captured_at, regexp_replace(coalesce(config_text, ''), '\\r', '', 'g') AS txt FROM device_profile),
 p AS (SELECT host, profile_id AS after_id, txt AS aft, lag(txt) OVER o AS bef, lag(profile_id) OVER o AS before_id FROM d WHERE host IS NOT NULL WINDOW o AS (PARTITION BY host ORDER BY captured_at, profile_id)),
 l AS (SELECT host, after_id, unnest(string_split(aft, chr(10))) AS line, 1 AS n FROM p WHERE before_id IS NOT NULL UNION ALL SELECT host, after_id, unnest(string_split(bef, chr(10))), -1 FROM p WHERE before_id IS NOT NULL),
 m AS (SELECT host, after_id, line, sum(n) AS n FROM l GROUP BY ALL HAVING sum(n) <> 0)
 SELECT host, after_id, CASE """ + section + """ ELSE 'other' END AS section, sum(greatest(n, 0))::BIGINT AS added, sum(greatest(-n, 0))::BIGINT AS removed FROM m GROUP BY ALL""",
        "mask_pii": DEV + ", " + _sanitize("SELECT host AS id, txt AS t FROM dev").removeprefix("WITH ") + f", q AS (SELECT id, {' + '.join(f'n{i}' for i in range(len(R.SECRETS)))} AS n, t FROM s{len(R.SECRETS)})" + _mask_names("q") + _mask_public("named") + " SELECT id, n, sha256(t) AS digest FROM masked",
        "mask_report": DEV + ", q AS (SELECT host AS id, 0 AS n, txt AS t FROM dev)" + _mask_names("q") + " " + " UNION ALL ".join(f"SELECT {_q(r[0])} AS rule, sum(c)::BIGINT AS n FROM nc{i} HAVING sum(c) > 0" for i, r in enumerate(sanitize.NAMES)),
        "interface_ospf": DEV + _addresses() + _interfaces() + " SELECT host, name, " + ", ".join(f"ospf_{n}" for n, _, _ in R.OSPF) + " FROM ifs WHERE coalesce(" + ", ".join(f"ospf_{n}::VARCHAR" for n, _, _ in R.OSPF) + ") IS NOT NULL",
        "peer_blocks": DEV + f", pk AS (SELECT host, ip, remote_as, p FROM ({_listed(R.BGP_PEER_BLOCK, 'ip', 'remote_as')}) UNION ALL SELECT host, ip, remote_as, 1000000 + p FROM ({_listed(R.BGP_PEER_LINE, 'ip', 'remote_as')})) SELECT host, ip, arg_min(remote_as, p) AS remote_as FROM pk GROUP BY 1, 2",
        "node_facts": _network() + """ SELECT nd.host, local_asn, router_id, vtep_source, vtep_ip, coalesce(a.vs, '') AS l2_vnis, coalesce(b.vs, '') AS l3_vnis, coalesce(f.fs, '') AS families, coalesce(i.n, 0) AS interfaces FROM nd LEFT JOIN (SELECT host, string_agg(v::VARCHAR, ',' ORDER BY v) AS vs FROM l2 GROUP BY 1) a USING (host)
 LEFT JOIN (SELECT host, string_agg(v::VARCHAR, ',' ORDER BY v) AS vs FROM l3 GROUP BY 1) b USING (host) LEFT JOIN (SELECT host, string_agg(a, ',' ORDER BY pos) AS fs FROM f2 GROUP BY 1) f USING (host) LEFT JOIN (SELECT host, count(*) AS n FROM ifs GROUP BY 1) i USING (host)""",
        "node_flags": _network() + f""", up AS (SELECT host, bool_or({_words("d", R.UPLINK_WORDS)}) AS u FROM ({_listed(R.UPLINK_DESCRIPTION, "d")}) GROUP BY 1),
 mf AS (SELECT host, min(struct_pack(tier := coalesce(nullif(lower(trim(coalesce(role, ''))), ''), lower(trim(coalesce(function_code, '')))), pop := lower(trim(coalesce(pop, ''))), rack := lower(trim(coalesce(rack, ''))), asn := nullif(asn, 0))) AS m FROM (SELECT *, lower(split_part(trim(hostname), '.', 1)) AS host FROM device_inventory) GROUP BY 1)
 SELECT nd.host, CASE regexp_extract(nd.host, {_q(R.HOST_ROLE)}, 1) {" ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in R.ROLES)} ELSE 'unknown' END AS role, platform, {", ".join(f"has_{n}" for n, _ in R.NODE_WORDS)}, coalesce(u, false) AS isp_uplink, coalesce(m.tier, '') AS tier, coalesce(m.pop, '') AS pop, coalesce(m.rack, '') AS rack, coalesce(local_asn, m.asn) AS asn FROM nd LEFT JOIN up USING (host) LEFT JOIN mf USING (host)""",
        "node_overlay": DEV + f""", fi AS (SELECT lower(split_part(trim(unnest(devices)), '.', 1)) AS host, CASE lower(trim(severity)) {" ".join(f"WHEN {_q(x)} THEN {i}" for i, x in enumerate(topology.SEVERITIES))} END AS r FROM action_item),
 fw AS (SELECT host, min(r) AS r FROM fi GROUP BY 1) SELECT dev.host, coalesce([{", ".join(map(_q, topology.SEVERITIES))}][r + 1], '') AS severity FROM dev LEFT JOIN fw USING (host)""",
        "platform_guesses": DEV + " SELECT host, CASE " + " ".join(f"WHEN {_words('left(txt, 5000)', w)} THEN {_q(n)}" for n, w in R.GUESSES) + " ELSE 'unknown' END AS platform FROM dev",
        "subnet_owners": DEV + _addresses() + " SELECT site_id, net_num, length, string_agg(DISTINCT host, ',' ORDER BY host) AS owners FROM (SELECT a.* EXCLUDE (site_id), dev.site_id FROM addr a JOIN dev USING (host)) WHERE length BETWEEN 28 AND 31 GROUP BY 1, 2, 3",
        "edge_detail": _network() + _edges() + _detail() + " SELECT * FROM dt",
        "edge_layers": _network() + _edges() + _detail() + f" SELECT layer, count(source) AS n_edges FROM (VALUES {', '.join(f'({_q(x)})' for x in topology.LAYERS)}) l(layer) LEFT JOIN dt ON list_contains(string_split(layers, ','), layer) GROUP BY 1",
        "fingerprints": f"""WITH e AS (SELECT item_id AS id, trim(concat_ws(chr(10), description, sample_messages[1]), ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11) || chr(65279)) AS t FROM action_item),
 l AS (SELECT *, list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11) || chr(65279))) AS ls FROM e)
 SELECT id, coalesce(list_filter(regexp_extract_all(t, {_q(compliance.QUOTED)}, 1), lambda x: regexp_matches(x, {_q(compliance.TOKEN)}))[1], substr(list_filter(ls, lambda x: regexp_matches(x, {_q(compliance.CONFIG_LINE)}))[1], 1, 120), regexp_extract_all(t, {_q(compliance.ADDRESS)})[1], regexp_extract_all(t, {_q(compliance.INTERFACE)})[1]) AS fingerprint FROM l""",
        "role_descriptions": DEV + f""", r0 AS (SELECT host, site_id, CASE split_part(host, '-', 2) {" ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in R.ROLES)} ELSE 'unknown' END AS role, len(list_filter({_all(R.DESCRIPTION)}, lambda d: {_words("d", R.UPLINK_WORDS + R.MORE_UPLINK_WORDS)})) > 0 AS told, regexp_matches(txt, {_q(R.BGP_PEER_BLOCK)}) OR regexp_matches(txt, {_q(R.BGP_PEER_LINE)}) AS peers,
 regexp_matches(txt, {_q(dict(R.FLAGS)["cluster"])}) AS cluster, regexp_matches(txt, {_q(dict(R.FLAGS)["evpn"])}) OR regexp_matches(txt, {_q(dict(R.COUNTS)["vnis"])}) AS fabric FROM dev),
 r1 AS (SELECT *, row_number() OVER (PARTITION BY site_id, role ORDER BY host) AS n FROM r0)
 SELECT host, site_id, role, CASE role WHEN 'firewall' THEN CASE n WHEN 1 THEN 'Primary Firewall' WHEN 2 THEN 'Secondary Firewall' ELSE 'Firewall #' || n END || CASE WHEN cluster THEN ' (HA chassis-cluster)' ELSE '' END WHEN 'router' THEN CASE n WHEN 1 THEN 'Primary Edge Router' WHEN 2 THEN 'Secondary Edge Router' ELSE 'Standby Router #' || n END
 WHEN 'switch' THEN CASE WHEN peers AND told THEN 'ISP-edge / Core switch' WHEN fabric THEN 'EVPN-VXLAN fabric leaf' WHEN peers THEN 'Core switch' ELSE 'Access / distribution switch' END WHEN 'storage' THEN 'Storage / ACS device' WHEN 'edr' THEN 'EDR / telemetry cluster' ELSE 'Unclassified network device' END AS description FROM r1""",
        "site_facts": _network() + _wan() + f""", lf AS (SELECT * FROM (VALUES {life}) t(eos, prefix, released, ends, status)), rk AS (SELECT w.host, contains(arg_max(status, length(prefix)), '🔴') OR contains(arg_max(status, length(prefix)), '🟠') AS risky FROM wide w JOIN lf ON lf.eos = (w.platform IN ('eos', 'arista')) AND starts_with(w.version, prefix) AND w.version <> '' GROUP BY 1),
 gw AS (SELECT host, lower("function") IN ({", ".join(map(_q, R.GATEWAY_FUNCTIONS))}) OR list_has_any(regexp_split_to_array(host, '[-_.]'), [{", ".join(map(_q, R.GATEWAY_PARTS))}]) AS g FROM dev), wc AS (SELECT site_id, count(DISTINCT ip) AS n FROM wan JOIN (SELECT host, site_id FROM dev) USING (host) GROUP BY 1)
 SELECT w.site_id, count(*) AS devices, {", ".join(f"bool_or(has_{n}) AS has_{n}" for n, _ in R.NODE_WORDS)}, bool_or(isis) AS isis, bool_or(bfd) AS bfd, sum(coalesce(p.n, 0))::BIGINT AS n_peers, sum(coalesce(i.n, 0))::BIGINT AS n_ifs, sum(n_static_routes)::BIGINT AS n_static_routes, sum(n_descriptions)::BIGINT AS n_descriptions, count(*) FILTER (g) AS gateways, count(*) FILTER (coalesce(risky, false)) AS risky, coalesce(any_value(wc.n), 0) AS wan_ips
 FROM wide w JOIN nd USING (host) JOIN gw USING (host) LEFT JOIN rk USING (host) LEFT JOIN (SELECT host, count(*) AS n FROM pe GROUP BY 1) p USING (host) LEFT JOIN (SELECT host, count(*) AS n FROM ifs GROUP BY 1) i USING (host) LEFT JOIN wc ON wc.site_id = w.site_id GROUP BY w.site_id""",
    }


def segment_queries() -> dict[str, str]:
    """Those of stream_queries about configurations."""
    return {
        "vlans": DEV + _vlans() + " SELECT host, vlan_id, name, array_to_string(subnets, ',') AS subnets FROM vl",
        "vlan_kinds": DEV + _vlans() + _vlan_kinds() + " SELECT * FROM vk",
        "vlan_kind_counts": DEV + _vlans() + _vlan_kinds() + " SELECT kind, count(*) AS n FROM vk GROUP BY 1",
        "nested_addresses": DEV + NESTED + " SELECT host, name, ip, description FROM nest",
        "wan_addresses": DEV + _addresses() + _interfaces() + _wan() + " SELECT host, name, ip, description, carrier FROM wan",
        "carriers": DEV + _addresses() + _interfaces() + _wan() + _carriers() + " SELECT carrier, count(DISTINCT ip) AS n_addresses, count(DISTINCT (host, name)) AS n_interfaces, coalesce(arg_min(asn, host) FILTER (asn IS NOT NULL), '') AS asn, bool_or(down) AS shutdown FROM cw GROUP BY 1",
        "tunnels": DEV + f" SELECT host, interface, regexp_extract(body, {_q(TUNNEL_ADDRESS)}, 1) AS address, trim(regexp_extract(body, 'description\\s+([^;\\n]+)', 1), ' \"') AS description FROM ({_listed(R.TUNNEL, 'interface', 'body', where=_q('jun') + ' = left(platform, 3)')})",
    }
