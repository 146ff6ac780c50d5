"""Facts of device configurations: one wide projection or exploded rows per kind of fact, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import config_rules as R
from logloom.functions.hosts import host
from logloom.functions.session import once
from logloom.operators.events import strip
from logloom.operators.sanitize import ip_number


def latest_configs(profiles: DataFrame) -> DataFrame:
    """host, site_id, platform, function, text of the latest capture of each host; carriage returns are dropped.

    Ids are aggregated, not texts; equal times count the larger profile_id as later; a null text is ''."""
    own = profiles.withColumn("host", host("hostname")).where("host is not null")
    newest = own.groupBy("host").agg(F.max_by("profile_id", F.struct("captured_at", "profile_id")).alias("profile_id"))
    rows = own.join(newest, ["host", "profile_id"]).dropDuplicates(["host"])
    return rows.select("host", "site_id", F.lower(F.coalesce("platform", F.lit(""))).alias("platform"), F.coalesce("function", F.lit("")).alias("function"), F.regexp_replace(F.coalesce("config_text", F.lit("")), "\r", "").alias("text"))


def all_of(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(group))


def first_of(*patterns: str) -> Column:
    """Group 1 of the first pattern that is found, else ''."""
    out = F.lit("")
    for p in reversed(patterns):
        v = F.regexp_extract("text", p, 1)
        out = F.when(v != "", v).otherwise(out)
    return out


def valid_ip(c: Column) -> Column:
    plain = F.substring_index(c, "/", 1)
    length = F.when(F.contains(c, F.lit("/")), F.substring_index(c, "/", -1).try_cast("int")).otherwise(32)
    return ip_number(plain).isNotNull() & (length <= 32)


def distinct_valid(xs: Column) -> Column:
    return F.array_distinct(F.filter(xs, valid_ip))


def cidrs() -> Column:
    """Every distinct valid interface address of the text, as written; of braced blocks the first of each interface."""
    junos = F.concat(all_of(R.JUNOS_ADDRESS), all_of(R.JUNOS_BLOCK_ADDRESS))
    lines = all_of(R.LINE_ADDRESS)
    xs = F.when(F.col("platform").startswith("junos"), junos).when(F.col("platform").isin("eos", "arista", "frr", "ios"), lines).otherwise(F.concat(all_of(R.JUNOS_ADDRESS), lines))
    held = F.filter(F.transform(braced_blocks(), lambda x: F.struct(x["name"].alias("name"), F.regexp_extract(x["body"], R.BRACED_ADDRESS, 1).alias("ip"))), lambda x: x["ip"] != "")
    own = F.filter(held, lambda x, i: F.array_position(F.transform(held, lambda y: y["name"]), x["name"]) == i + 1)["ip"]
    return distinct_valid(F.concat(xs, own))


def network(cidr: Column) -> Column:
    """cidr, ip_num, net_num, length of an address."""
    n, length = ip_number(F.substring_index(cidr, "/", 1)), F.substring_index(cidr, "/", -1).cast("int")
    return F.struct(cidr.alias("cidr"), n.alias("ip_num"), (n - n % F.pow(F.lit(2), 32 - length).cast("bigint")).alias("net_num"), length.alias("length"))


def addresses(configs: DataFrame) -> DataFrame:
    """host, pos, cidr, ip_num, net_num, length of every address of cidrs(); site_id too where configs has it."""
    if "nets" not in configs.columns:
        configs = once(configs, cidrs=cidrs()).withColumn("nets", F.transform("cidrs", network))
    nets = F.col("nets")
    return configs.select("host", *_site(configs), F.posexplode(nets).alias("pos", "n")).select("host", *_site(configs), "pos", "n.*")


def _site(configs: DataFrame) -> list[str]:
    return ["site_id"] if "site_id" in configs.columns else []


def peer_ips() -> Column:
    return distinct_valid(all_of(R.BGP_PEER))


def peer_asns() -> Column:
    """(ip, asn) of neighbours with a configured system, by first appearance; the last assignment counts."""
    pairs = F.filter(_zipped(R.BGP_PEER_AS, "ip", "asn"), lambda x: valid_ip(x["ip"]))
    return F.transform(F.array_distinct(F.transform(pairs, lambda x: x["ip"])), lambda i: F.struct(i, F.element_at(F.filter(pairs, lambda x: x["ip"] == i), -1)["asn"])).cast("array<struct<ip: string, asn: bigint>>")


def bgp_peers(configs: DataFrame) -> DataFrame:
    """host, ip of every distinct neighbour, asn where one is configured; the last assignment counts."""
    if "peers" not in configs.columns:
        configs = once(configs, peers=peer_ips(), peer_asns=peer_asns())
    rows = configs.select("host", *_site(configs), F.col("peer_asns").alias("asns"), F.explode("peers").alias("ip"))
    return rows.select("host", *_site(configs), "ip", F.try_element_at(F.filter("asns", lambda x: x["ip"] == F.col("ip")), F.lit(1))["asn"].alias("asn"))


def peer_blocks(configs: DataFrame) -> DataFrame:
    """host, pos, ip, remote_as of neighbours in braced blocks, then in lines; the first of an address counts."""
    both = F.concat(_zipped(R.BGP_PEER_BLOCK, "ip", "remote_as"), _zipped(R.BGP_PEER_LINE, "ip", "remote_as"))
    rows = configs.select("host", F.posexplode(both).alias("pos", "p")).select("host", "pos", "p.*")
    return rows.groupBy("host", "ip").agg(F.min("pos").alias("pos"), F.min_by("remote_as", "pos").alias("remote_as"))


def descriptions(configs: DataFrame) -> DataFrame:
    """host, pos, description of every description; site_id too where configs has it."""
    own = F.col("described") if "described" in configs.columns else all_of(R.DESCRIPTION)
    return configs.select("host", *_site(configs), F.posexplode(own).alias("pos", "d")).select("host", *_site(configs), "pos", strip(F.col("d")).alias("description"))


def speed(number: Column, unit: Column) -> Column:
    n = number.try_cast("bigint")
    return F.when(number == "", "").when(F.upper(unit) == "G", F.concat(n.cast("string"), F.lit("G"))).when((n >= 1000) & (n % 1000 == 0), F.concat((n / 1000).cast("bigint").cast("string"), F.lit("G"))).otherwise(F.concat(n.cast("string"), F.lit("M")))


def speed_of_name(name: Column) -> Column:
    out = None
    for prefix, v in R.SPEED_BY_NAME:
        hit = F.lower(name).startswith(prefix)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise("")


def _zipped(pattern: str, *names: str) -> Column:
    """Groups 1, 2, ... of every match as structs of these names."""
    return F.arrays_zip(*[all_of(pattern, k + 1) for k in range(len(names))]).cast(f"array<struct<{', '.join(f'{n}: string' for n in names)}>>")


def braced_blocks() -> Column:
    """name, body of blocks 'interface X {', each up to its first line with nothing but a closing brace."""
    return _zipped(R.BRACED_BLOCK, "name", "body")


def interfaces(configs: DataFrame, braced: bool = True) -> DataFrame:
    """host, name, pos, ip, description, speed and the OSPF columns of interfaces: of set lines (junos), then indented blocks, then braced ones.

    The first that has a value counts, of the OSPF columns, which only braced blocks have, the last; they are null where none has."""
    none = F.lit("")

    def entry(name: Column, ip: Column = none, description: Column = none, number: Column = none, unit: Column = none, body: Column = none) -> Column:
        return F.struct(name.alias("name"), ip.alias("ip"), strip(description).alias("description"), speed(number, unit).alias("speed"), body.alias("body"))

    def inner(x: Column, address: str, description: str, body: Column = none) -> Column:
        return entry(x["name"], F.regexp_extract(x["body"], address, 1), F.regexp_extract(x["body"], description, 1), F.regexp_extract(x["body"], R.SPEED, 1), F.regexp_extract(x["body"], R.SPEED, 2), body)

    addressed = F.transform(_zipped(R.SET_ADDRESS, "name", "v"), lambda x: entry(x["name"], ip=x["v"]))
    described = F.transform(_zipped(R.SET_DESCRIPTION, "name", "v"), lambda x: entry(x["name"], description=x["v"]))
    timed = F.transform(_zipped(R.SET_SPEED, "name", "v", "u"), lambda x: entry(x["name"], number=x["v"], unit=x["u"]))
    forms = [F.filter(F.concat(addressed, described, timed), lambda _: F.col("platform").startswith("junos")), F.transform(_zipped(R.INTERFACE_BLOCK, "name", "body"), lambda x: inner(x, R.LINE_ADDRESS, R.BLOCK_DESCRIPTION))]
    if braced:
        forms.append(F.transform(braced_blocks(), lambda x: inner(x, R.BRACED_ADDRESS, R.BRACED_DESCRIPTION, x["body"])))
    rows = configs.select("host", F.posexplode(F.concat(*forms)).alias("pos", "b")).select("host", "pos", "b.*")
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("pos"))), F.lit("")).alias(c)

    def last(name: str, pattern: str, kind: str) -> Column:
        v = F.regexp_extract("body", pattern, 1)
        return F.max_by(v, F.when(v != "", F.col("pos"))).cast(kind).alias(f"ospf_{name}")

    out = rows.groupBy("host", "name").agg(F.min("pos").alias("pos"), first("ip"), first("description"), first("speed"), *[last(*x) for x in R.OSPF])
    return out.withColumn("speed", F.when(F.col("speed") != "", F.col("speed")).otherwise(speed_of_name(F.col("name"))))


def family_names() -> Column:
    """Address families in their full names, in order; EVPN where it is signalled."""
    names = F.create_map(*[F.lit(x) for p in R.FAMILY_NAMES for x in p])
    found = F.array_distinct(F.transform(F.transform(all_of(R.ADDRESS_FAMILY), lambda a: F.regexp_replace(F.lower(a), r"\s+", "-")), lambda a: F.coalesce(F.try_element_at(names, a), a)))
    evpn = F.col("text").rlike(R.EVPN_SIGNALLED) | F.exists(found, lambda a: F.contains(a, F.lit("evpn")))
    return F.when(evpn, F.array_distinct(F.array_append(found, F.lit("l2vpn-evpn")))).otherwise(found)


def families(configs: DataFrame) -> DataFrame:
    """host, families ARRAY of family_names()."""
    return configs.select("host", family_names().alias("families"))


def with_vnis(configs: DataFrame) -> DataFrame:
    """configs with l2_vnis, l3_vnis: network ids by first appearance, layer 3 from 50000 on, and those of routing instances of frr."""
    number = lambda xs: F.transform(xs, lambda x: x.cast("bigint"))
    frr = F.col("platform") == "frr"
    inner = lambda bodies: number(F.flatten(F.transform(bodies, lambda x: F.regexp_extract_all(x["body"], F.lit(R.BODY_VNI), F.lit(1)))))
    none = F.array().cast("array<bigint>")
    blocks = F.when(frr, inner(F.filter(_zipped(R.INTERFACE_BLOCK, "name", "body"), lambda x: F.lower(x["name"]).startswith("vxlan")))).otherwise(none)
    bound = F.when(frr, inner(_zipped(R.VRF_BLOCK, "name", "body"))).otherwise(none)
    rows = once(configs, _plain=F.array_distinct(F.concat(*[number(all_of(p)) for p in R.VNI], blocks)), _bound=bound)
    more = F.filter("_bound", lambda v: ~F.array_contains("_plain", v))
    return rows.withColumns({"l2_vnis": F.filter("_plain", lambda v: v < 50_000), "l3_vnis": F.array_distinct(F.concat(F.filter("_plain", lambda v: v >= 50_000), more))}).drop("_plain", "_bound")


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def role_of(host: Column) -> Column:
    """firewall, router, ... of a name of the form site-function-number, else unknown."""
    known = F.create_map(*[F.lit(x) for p in R.ROLES for x in p])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(F.lower(host), R.HOST_ROLE, 1)), F.lit("unknown"))


def platform_guess(text: Column) -> Column:
    out, head = None, F.substring(text, 1, 5000)
    for name, words in R.GUESSES:
        out = F.when(has_word(head, words), name) if out is None else out.when(has_word(head, words), name)
    return out.otherwise("unknown")


def nodes(configs: DataFrame) -> DataFrame:
    """One row per host with all that links are inferred from and described by; store it once, then join.

    host, site_id, platform, function, cluster, nets, peers, peer_asns, mlag, described, families, local_asn, router_id,
    vtep_source, vtep_ip, l2_vnis, l3_vnis, has_bgp, has_ospf, has_evpn, has_vxlan, isp_uplink, ifs (the interfaces in order).
    The router id is that of OSPF, else the first address of length 32; the address of a tunnel end is that of its source
    interface, else, where EVPN is advertised, of the first loopback that has one."""
    words = [has_word(F.col("text"), w).alias(f"has_{n}") for n, w in R.NODE_WORDS]
    uplink = F.exists(all_of(R.UPLINK_DESCRIPTION), lambda d: has_word(d, R.UPLINK_WORDS))
    own = once(with_vnis(configs), cidrs=cidrs()).select(
        "host", "site_id", "platform", "function", F.col("text").rlike(dict(R.FLAGS)["cluster"]).alias("cluster"), F.transform("cidrs", network).alias("nets"), peer_ips().alias("peers"), peer_asns().alias("peer_asns"), distinct_valid(all_of(R.MLAG_PEER)).alias("mlag"), all_of(R.DESCRIPTION).alias("described"),
        family_names().alias("families"), F.nullif(first_of(*R.LOCAL_AS), F.lit("")).cast("bigint").alias("local_asn"), first_of(*R.ROUTER_ID).alias("ospf_id"), first_of(*R.VTEP_SOURCE).alias("source"), F.col("text").rlike(R.ADVERTISED).alias("advertised"), "l2_vnis", "l3_vnis", *words, uplink.alias("isp_uplink"),
    )
    rows = interfaces(configs).withColumn("ip_num", ip_number(F.substring_index("ip", "/", 1)))
    entry = ["pos", "name", "ip", "ip_num", "description", "speed", *[c for c in rows.columns if c.startswith("ospf_")]]
    held = rows.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("ifs"))
    both = own.join(held, "host", "left").withColumn("ifs", F.coalesce("ifs", F.array().cast(held.schema["ifs"].dataType)))
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    alone = F.substring_index(first(F.filter("nets", lambda n: n["length"] == 32))["cidr"], "/", 1)
    named = first(F.filter("ifs", lambda i: F.lower(i["name"]) == F.lower("source")))
    called = lambda c: F.slice(F.filter("ifs", lambda i: F.lower(i["name"]) == c), 1, 1)
    loops = F.flatten(F.array(*map(called, R.VTEP_LOOPBACKS)))
    loop = first(F.filter(loops, lambda i: i["ip"] != ""))
    plain = lambda i: F.nullif(F.substring_index(i["ip"], "/", 1), F.lit(""))
    direct = F.when(F.col("source") != "", plain(named))
    both = both.withColumns({"direct": direct, "implied": F.when(direct.isNull() & F.col("advertised"), loop)})
    return both.select(
        "host", "site_id", "platform", "function", "cluster", "nets", "peers", "peer_asns", "mlag", "described", "families", "local_asn", F.coalesce(F.nullif("ospf_id", F.lit("")), alone, F.lit("")).alias("router_id"), F.coalesce(F.nullif("source", F.lit("")), F.col("implied.name"), F.lit("")).alias("vtep_source"),
        F.coalesce("direct", plain(F.col("implied")), F.lit("")).alias("vtep_ip"), "l2_vnis", "l3_vnis", *[f"has_{n}" for n, _ in R.NODE_WORDS], "isp_uplink", "ifs",
    )


def wide(configs: DataFrame) -> DataFrame:
    """host, local_asn, router_id, version, model, flags and counts: facts with one value per device."""
    cols = [first_of(*R.LOCAL_AS).alias("local_asn"), first_of(*R.ROUTER_ID).alias("ospf_router_id"), first_of(*R.VERSION).alias("version"), first_of(R.MODEL).alias("model")]
    cols += [F.col("text").rlike(p).alias(n) for n, p in R.FLAGS] + [F.regexp_count("text", F.lit(p)).cast("bigint").alias(f"n_{n}") for n, p in R.COUNTS]
    return configs.select("host", "site_id", "platform", "function", F.length("text").cast("bigint").alias("size"), *cols)


def named_values(configs: DataFrame) -> DataFrame:
    """host, kind, value of network ids (with_vnis()), VRFs and OSPF areas, distinct."""
    kinds = lambda c, k: F.transform(c, lambda v: F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")))
    ids = with_vnis(configs).select("host", F.inline(F.concat(kinds("l2_vnis", "l2_vni"), kinds("l3_vnis", "l3_vni"))))
    vrf = configs.select("host", F.explode(F.concat(*[all_of(p) for p in R.VRF])).alias("value"))
    vrf = vrf.select("host", F.lit("vrf").alias("kind"), F.regexp_replace("value", r"[{\s]+$", "").alias("value")).where((F.col("value") != "") & ~F.lower("value").isin(*R.VRF_SKIP))
    area = configs.select("host", F.lit("area").alias("kind"), F.explode(all_of(R.OSPF_AREA)).alias("value"))
    loops = configs.select("host", F.lit("loopback").alias("kind"), F.explode(F.when(F.col("platform").startswith("jun"), all_of(R.LOOPBACK_JUNOS)).when(F.col("platform").isin("eos", "frr", "ios"), all_of(R.LOOPBACK_LINE)).otherwise(F.array().cast("array<string>"))).alias("value"))
    zone = configs.select("host", F.lit("zone").alias("kind"), F.explode(all_of(R.ZONE)).alias("value"))
    return ids.unionByName(vrf).unionByName(area).unionByName(loops).unionByName(zone).distinct()


def endpoints(configs: DataFrame, limit: int = 8) -> DataFrame:
    """host, service, endpoints ARRAY: cleaned, distinct, in order, the first `limit`."""
    parts = []
    for name, p in R.ENDPOINTS:
        clean = F.transform(all_of(p), lambda v: F.regexp_replace(v, r"^[ ;,\t\r\n]+|[ ;,\t\r\n]+$", ""))
        parts.append(F.struct(F.lit(name).alias("service"), F.slice(F.array_distinct(F.filter(clean, lambda v: v.rlike("^[A-Za-z0-9._:-]+$"))), 1, limit).alias("endpoints")))
    return configs.select("host", F.inline(F.array(*parts))).where("size(endpoints) > 0")


def lifecycle(profile: DataFrame) -> DataFrame:
    """host, platform, version, released, ends, status by the longest version prefix."""
    tables = {True: R.EOS_LIFECYCLE, False: R.JUNOS_LIFECYCLE}

    def pick(eos: bool, i: int) -> Column:
        out = None
        for row in sorted(tables[eos], key=lambda r: -len(r[0])):
            hit = F.col("version").startswith(row[0])
            out = F.when(hit, row[i]) if out is None else out.when(hit, row[i])
        return out.otherwise(R.NOT_LISTED if i == 3 else "")

    eos = F.col("platform").isin("eos", "arista")
    value = lambda i: F.when(F.col("version") == "", R.NO_VERSION if i == 3 else "").when(eos, pick(True, i)).otherwise(pick(False, i))
    return profile.select("host", "platform", "version", value(1).alias("released"), value(2).alias("ends"), value(3).alias("status"))


def is_risky(status: Column) -> Column:
    """Whether a life cycle's status says that support has ended or is about to."""
    return F.contains(status, F.lit("🔴")) | F.contains(status, F.lit("🟠"))


def is_gateway(host_name: Column, function: Column) -> Column:
    """Whether a device leads out of its site: by its function, else by a part of its name."""
    parts = F.split(F.lower(host_name), "[-_.]")
    return F.lower(function).isin(*R.GATEWAY_FUNCTIONS) | F.arrays_overlap(parts, F.array(*map(F.lit, R.GATEWAY_PARTS)))


def role_descriptions(configs: DataFrame) -> DataFrame:
    """host, site_id, role, description: the place of a device among those of its role in its site, by name; of switches what they run."""
    told = F.exists(all_of(R.DESCRIPTION), lambda d: has_word(d, R.UPLINK_WORDS + R.MORE_UPLINK_WORDS))
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in R.ROLES for x in p]), F.get(F.split(F.lower("host"), "-"), F.lit(1))), F.lit("unknown"))
    peers = (F.regexp_count("text", F.lit(R.BGP_PEER_BLOCK)) > 0) | (F.regexp_count("text", F.lit(R.BGP_PEER_LINE)) > 0)
    flags, counts = dict(R.FLAGS), dict(R.COUNTS)
    rows = configs.select("host", "site_id", role.alias("role"), told.alias("told"), peers.alias("peers"), F.col("text").rlike(flags["cluster"]).alias("cluster"), (F.col("text").rlike(flags["evpn"]) | (F.regexp_count("text", F.lit(counts["vnis"])) > 0)).alias("fabric"))
    n = F.row_number().over(Window.partitionBy("site_id", "role").orderBy("host"))
    rows = rows.withColumn("n", n)
    number = F.col("n").cast("string")
    firewall = F.concat(F.when(F.col("n") == 1, "Primary Firewall").when(F.col("n") == 2, "Secondary Firewall").otherwise(F.concat(F.lit("Firewall #"), number)), F.when(F.col("cluster"), " (HA chassis-cluster)").otherwise(""))
    router = F.when(F.col("n") == 1, "Primary Edge Router").when(F.col("n") == 2, "Secondary Edge Router").otherwise(F.concat(F.lit("Standby Router #"), number))
    switch = F.when(F.col("peers") & F.col("told"), "ISP-edge / Core switch").when(F.col("fabric"), "EVPN-VXLAN fabric leaf").when(F.col("peers"), "Core switch").otherwise("Access / distribution switch")
    what = F.when(F.col("role") == "firewall", firewall).when(F.col("role") == "router", router).when(F.col("role") == "switch", switch).when(F.col("role") == "storage", "Storage / ACS device").when(F.col("role") == "edr", "EDR / telemetry cluster").otherwise("Unclassified network device")
    return rows.select("host", "site_id", "role", what.alias("description"))
