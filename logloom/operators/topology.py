"""Links between devices of a site, inferred from their facts by equi-joins, and what they carry.

Joins are keyed by the site too: networks and names that sites reuse don't meet, and no key grows beyond a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.hosts import host
from logloom.operators import facts

#: Rules in order of evaluation with their confidence.
RULES = (("description-hostname", 0.95), ("description-shortform", 0.7), ("mlag-peer", 1.0), ("bgp-neighbor", 0.95), ("subnet-co-membership", 0.85), ("ha-pair-naming", 0.9))


def _edge(df: DataFrame, a: str, b: str, rule: str, evidence) -> DataFrame:
    rank = [r for r, _ in RULES].index(rule)
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("source"), F.greatest(a, b).alias("target"), F.lit(rule).alias("rule"), F.lit(dict(RULES)[rule]).alias("confidence"), F.lit(rank).alias("rank"), evidence.alias("evidence"))


def by_description(descriptions: DataFrame, hosts: DataFrame) -> DataFrame:
    """A description (host, site_id, description) that holds the name of another device of hosts(host, site_id), or its part
    behind the first dash as a word.

    Every stretch of a description that has the length of some name is looked up: a join by equality, not of all pairs."""
    lengths = hosts.agg(F.array_sort(F.collect_set(F.length("host"))).alias("lengths"))  # one row; names have few lengths
    d = descriptions.select("host", "site_id", "description", F.lower("description").alias("low"))
    at = d.crossJoin(F.broadcast(lengths)).select("host", "site_id", "description", "low", F.explode("lengths").alias("n")).where("length(low) >= n")
    at = at.select("host", "site_id", "description", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - F.col("n") + 1), lambda i: F.substring(F.col("low"), i, F.col("n"))))).alias("name"))
    named = at.join(hosts.select("site_id", F.col("host").alias("other"), F.lower("host").alias("name")), ["site_id", "name"]).where("host != other")
    words = d.select("host", "site_id", "description", F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("short")).where("short != ''")
    short = words.join(hosts.where(F.contains("host", F.lit("-"))).select("site_id", F.col("host").alias("other"), F.lower(F.expr("substring(host, locate('-', host) + 1)")).alias("short")), ["site_id", "short"])
    short = short.join(named.select("host", "description", "other").distinct(), ["host", "description", "other"], "left_anti")
    text = F.concat(F.col("host"), F.lit(" description: '"), F.substring("description", 1, 50), F.lit("'"))
    return _edge(named, "host", "other", "description-hostname", text).unionByName(_edge(short, "host", "other", "description-shortform", text))


def by_address(peers: DataFrame, addresses: DataFrame, rule: str) -> DataFrame:
    """A configured peer address (host, site_id, ip) that is an interface address of another device of the site."""
    owned = addresses.select("site_id", F.col("host").alias("other"), F.substring_index("cidr", "/", 1).alias("ip")).distinct()
    hit = peers.select("host", "site_id", "ip").distinct().join(owned, ["site_id", "ip"])
    return _edge(hit, "host", "other", rule, F.concat(F.col("host"), F.lit(" -> "), F.col("ip"), F.lit(" of "), F.col("other")))


def subnet_owners(addresses: DataFrame) -> DataFrame:
    """site_id, net_num, length, owners ARRAY of networks of 2 to 16 addresses."""
    return addresses.where("length between 28 and 31").groupBy("site_id", "net_num", "length").agg(F.array_sort(F.collect_set("host")).alias("owners"))


def by_subnet(addresses: DataFrame) -> DataFrame:
    """Two devices of a site in one network of 2 to 16 addresses."""
    own = addresses.where("length between 28 and 31").select("site_id", "net_num", "length", "host").distinct()
    other = own.withColumnRenamed("host", "other")
    hit = own.join(other, ["site_id", "net_num", "length"]).where("host < other")
    return _edge(hit, "host", "other", "subnet-co-membership", F.concat(F.lit("both on /"), F.col("length").cast("string")))


def ha_pairs(profile: DataFrame) -> DataFrame:
    """Names that differ by a and b, or by 1 in their number, where one of the two says that it is clustered."""
    stem = r"^(.+?-(?:fw|rt|sw)-)(\d+)([ab]?)$"
    named = profile.select("host", "site_id", "cluster", F.regexp_extract("host", stem, 1).alias("stem"), F.regexp_extract("host", stem, 2).alias("n"), F.regexp_extract("host", stem, 3).alias("side")).where("stem != ''")
    other = named.select(*[F.col(c).alias(f"o_{c}") for c in named.columns])
    letters = named.where("side = 'a'").join(other.where("o_side = 'b'"), (F.col("site_id") == F.col("o_site_id")) & (F.col("stem") == F.col("o_stem")) & (F.col("n") == F.col("o_n")))
    plain = named.where("side = ''").withColumn("next", F.col("n").cast("bigint") + 1)
    numbers = plain.join(other.where("o_side = ''"), (F.col("site_id") == F.col("o_site_id")) & (F.col("stem") == F.col("o_stem")) & (F.col("next") == F.col("o_n").cast("bigint")))
    both = letters.select("host", "o_host", "cluster", "o_cluster").unionByName(numbers.select("host", "o_host", "cluster", "o_cluster")).where("cluster or o_cluster")
    return _edge(both, "host", "o_host", "ha-pair-naming", F.lit("names and cluster flag"))


def candidates(nodes: DataFrame) -> DataFrame:
    """What every rule finds between the devices of facts.nodes(); a null site is the site ''."""
    own = nodes.withColumn("site_id", F.coalesce("site_id", F.lit("")))
    at = facts.addresses(own)
    mlag = own.select("host", "site_id", F.explode("mlag").alias("ip"))
    out = by_description(facts.descriptions(own), own.select("host", "site_id"))
    for more in (by_address(mlag, at, "mlag-peer"), by_address(facts.bgp_peers(own), at, "bgp-neighbor"), by_subnet(at), ha_pairs(own)):
        out = out.unionByName(more)
    return out


def best(candidates: DataFrame) -> DataFrame:
    """source, target, rule, confidence, evidence, n_rules: the surest rule of each pair, the earlier one of equally sure rules."""
    first = F.min_by(F.struct("rule", "confidence", "evidence"), F.struct(-F.col("confidence"), "rank", "evidence"))
    return candidates.groupBy("source", "target").agg(first.alias("b"), F.count_distinct("rule").alias("n_rules")).select("source", "target", "b.*", "n_rules")


#: Kinds of links by rule, layers in order, severities from the worst.
KINDS = (("bgp-neighbor", "bgp"), ("mlag-peer", "mlag"), ("ha-pair-naming", "ha"), ("subnet-co-membership", "subnet"))
LAYERS = ("physical", "bgp", "ospf", "vxlan")
SEVERITIES = ("critical", "high", "medium", "low")


def megabits(speed: Column) -> Column:
    n = F.substring(speed, 1, F.length(speed) - 1).try_cast("bigint")
    unit = F.upper(F.substring(speed, -1, 1))
    return F.coalesce(F.when(unit == "G", n * 1000).when(unit == "M", n), F.lit(0).cast("bigint"))


def link_speed(a: Column, b: Column) -> Column:
    """The lower one of two speeds, the known one where only one is."""
    return F.when(a == "", b).when(b == "", a).when(megabits(b) < megabits(a), b).otherwise(a)


def ip_text(n: Column) -> Column:
    octet = lambda k: F.shiftright(n, k).bitwiseAND(255).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def _first(xs: Column, test) -> Column:
    return F.try_element_at(F.filter(xs, test), F.lit(1))


def detail(edges: DataFrame, nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """What the links of best() carry: two joins with facts.nodes(), the rest within a row.

    source, target, kind, rule, confidence, subnet, interfaces with address and speed at either end, description, speed,
    systems and type of the session, neighbour addresses, address families, OSPF ids and timers, tunnel ends and network ids,
    layers. A subnet is the first of the target's networks of 2 to 16 addresses that the source is in too; interfaces are the
    first ones on it. sites(site_id, default_link_speed) gives the speed of links without one."""
    end = lambda name, key: nodes.select(F.col("host").alias(key), F.struct("site_id", "nets", "peers", "peer_asns", "families", "local_asn", "router_id", "vtep_ip", "l2_vnis", "l3_vnis", "has_ospf", "has_evpn", "has_vxlan", "ifs").alias(name))
    e = edges.join(end("a", "source"), "source").join(end("b", "target"), "target")
    speeds = sites.where("site_id is not null").groupBy("site_id").agg(F.max(F.btrim("default_link_speed")).alias("default_speed"))
    e = e.withColumn("site_id", F.col("a.site_id")).join(speeds, "site_id", "left")
    nets = lambda c: F.transform(F.filter(F.col(f"{c}.nets"), lambda n: n["length"].between(28, 31)), lambda n: F.struct(n["net_num"].alias("net"), n["length"].alias("length")))
    e = e.withColumns({"a_nets": nets("a"), "b_nets": nets("b")})
    e = e.withColumn("net", _first(F.col("b_nets"), lambda n: F.array_contains("a_nets", n)))
    low, size = F.col("net.net"), F.pow(F.lit(2), 32 - F.col("net.length")).cast("bigint")
    on_net = lambda i: F.coalesce(i["ip_num"].between(low, low + size - 1), F.lit(False))
    e = e.withColumns({"i": _first(F.col("a.ifs"), on_net), "j": _first(F.col("b.ifs"), on_net)})
    own_ips = lambda c: F.transform(F.col(f"{c}.nets"), lambda n: F.substring_index(n["cidr"], "/", 1))
    named = lambda c, asn: F.coalesce(F.exists(F.col(f"{c}.peer_asns"), lambda p: p["asn"] == asn), F.lit(False))
    peering = F.arrays_overlap(F.col("b.peers"), own_ips("a")) | F.arrays_overlap(F.col("a.peers"), own_ips("b")) | named("a", F.col("b.local_asn")) | named("b", F.col("a.local_asn"))
    both_ospf = F.col("a.has_ospf") & F.col("b.has_ospf")
    overlay = (F.col("a.has_vxlan") | F.col("a.has_evpn")) & (F.col("b.has_vxlan") | F.col("b.has_evpn"))
    area = lambda i: i["ospf_area"].isNotNull()
    e = e.withColumns({
        "src_asn": F.when(peering, F.col("a.local_asn")), "dst_asn": F.when(peering, F.col("b.local_asn")), "both_ospf": both_ospf, "overlay": overlay, "kind": F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS for x in p]), F.col("rule")), F.lit("physical")),
        "o": F.when(both_ospf, F.coalesce(_first(F.col("a.ifs"), lambda i: on_net(i) & area(i)), _first(F.col("a.ifs"), area))),
        "told": F.when(F.contains("evidence", F.lit("description:")), F.substring(F.btrim(F.btrim(F.substring_index("evidence", "description:", -1)), F.lit("'\"")), 1, 80)),
    })
    text = lambda c: F.coalesce(c, F.lit(""))
    some = lambda c: F.nullif(c, F.lit(""))
    s, d = text(F.col("i.speed")), text(F.col("j.speed"))
    e = e.withColumns({"found_speed": link_speed(s, d), "s": s, "d": d, "default_speed": text(F.col("default_speed"))})
    filled = lambda c: F.when((F.col("found_speed") == "") & (c == ""), F.col("default_speed")).otherwise(c)
    vtep = lambda c: F.when(F.col("overlay"), F.coalesce(some(F.col(f"{c}.vtep_ip")), F.col(f"{c}.router_id"))).otherwise("")
    numbers = lambda n: F.when(F.col("overlay"), F.array_sort(F.array_distinct(F.concat(F.col(f"a.{n}"), F.col(f"b.{n}"))))).otherwise(F.array().cast("array<bigint>"))
    peer = lambda c, o: text(_first(F.col(f"{c}.peer_asns"), lambda p: p["asn"] == F.col(f"{o}.local_asn"))["ip"])
    sessions = (F.col("kind") == "bgp") | (F.col("src_asn").isNotNull() & F.col("dst_asn").isNotNull())
    tunnels = (F.col("a.has_vxlan") & F.col("b.has_vxlan")) | (F.col("a.has_evpn") & F.col("b.has_evpn"))
    return e.select(
        "source", "target", "kind", "rule", "confidence", F.when(F.col("net").isNotNull(), F.concat(ip_text(low), F.lit("/"), F.col("net.length").cast("string"))).otherwise("").alias("subnet"), text(F.col("i.name")).alias("src_iface"), text(F.col("i.ip")).alias("src_ip"), text(F.col("j.name")).alias("dst_iface"), text(F.col("j.ip")).alias("dst_ip"),
        F.coalesce(some(F.col("i.description")), some(F.col("j.description")), F.col("told"), F.lit("")).alias("description"), filled(F.col("s")).alias("src_speed"), filled(F.col("d")).alias("dst_speed"), filled(F.col("found_speed")).alias("speed"), "src_asn", "dst_asn",
        F.when(F.col("src_asn").isNotNull() & F.col("dst_asn").isNotNull(), F.when(F.col("src_asn") != F.col("dst_asn"), "ebgp").otherwise("ibgp")).otherwise("").alias("bgp_type"), peer("a", "b").alias("src_bgp_ip"), peer("b", "a").alias("dst_bgp_ip"), F.array_distinct(F.concat(F.col("a.families"), F.col("b.families"))).alias("families"),
        F.when(F.col("both_ospf"), F.col("a.router_id")).otherwise("").alias("src_router_id"), F.when(F.col("both_ospf"), F.col("b.router_id")).otherwise("").alias("dst_router_id"), text(F.col("o.ospf_area")).alias("ospf_area"), *[F.col(f"o.ospf_{c}").alias(f"ospf_{c}") for c in ("hello", "dead", "cost")], text(F.col("o.ospf_network_type")).alias("ospf_network_type"),
        vtep("a").alias("src_vtep"), vtep("b").alias("dst_vtep"), numbers("l2_vnis").alias("l2_vnis"), numbers("l3_vnis").alias("l3_vnis"), F.array_compact(F.array(F.lit("physical"), F.when(sessions, "bgp"), F.when(F.col("both_ospf"), "ospf"), F.when(tunnels, "vxlan"))).alias("layers"),
    )


def layer_counts(details: DataFrame) -> DataFrame:
    """layer, n_edges of every layer, 0 where it has none."""
    held = details.select(F.explode("layers").alias("layer")).groupBy("layer").agg(F.count("*").alias("n"))
    every = details.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    return every.join(held, "layer", "left").select("layer", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_edges"))


def described_nodes(nodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """host, role, platform, the flags of nodes(), tier, pop, rack and asn: what the manifest says of a host, by its least row.

    The tier is the role there, else the function code; the manifest's system counts where the configuration has none."""
    low = lambda c: F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    rows = inventory.select(host("hostname").alias("host"), F.struct(F.coalesce(F.nullif(low("role"), F.lit("")), low("function_code")).alias("tier"), low("pop").alias("pop"), low("rack").alias("rack"), F.nullif("asn", F.lit(0)).alias("asn")).alias("m"))
    told = rows.where("host is not null").groupBy("host").agg(F.min("m").alias("m"))
    text = lambda c: F.coalesce(c, F.lit(""))
    flags = [c for c in nodes.columns if c.startswith("has_")]
    return nodes.join(told, "host", "left").select("host", facts.role_of(F.col("host")).alias("role"), "platform", *flags, "isp_uplink", text(F.col("m.tier")).alias("tier"), text(F.col("m.pop")).alias("pop"), text(F.col("m.rack")).alias("rack"), F.coalesce("local_asn", "m.asn").alias("asn"))


def overlay(hosts: DataFrame, findings: DataFrame) -> DataFrame:
    """host, severity of hosts(host): the worst severity of the findings(severity, devices) that name it, '' for none."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(F.btrim(F.coalesce("severity", F.lit("")))))
    named = findings.select(rank.alias("rank"), F.explode("devices").alias("d")).where("rank > 0").select("rank", host("d").alias("host")).groupBy("host").agg(F.min("rank").alias("rank"))
    return hosts.select("host").join(named, "host", "left").select("host", F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), (F.col("rank") - 1).cast("int")), F.lit("")).alias("severity"))
