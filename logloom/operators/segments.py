"""VLANs, public addresses of interfaces, and carriers, from configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import config_rules as R
from logloom.operators import facts
from logloom.operators.events import strip
from logloom.operators.facts import all_of
from logloom.operators.sanitize import ip_number, is_public

#: Patterns of VLANs (id and name, or id and subnet), and of tunnels.
VLAN_BLOCK = r"(\S+)\s*\{\s*[^{}]*?vlan-id\s+(\d{1,4})\s*;[^{}]*?\}"
VLAN_SET = r"(?i)set\s+vlans\s+(\S+)\s+vlan-id\s+(\d{1,4})"
VLAN_LINE = r"(?m)^\s*vlan\s+(\d{1,4})[ \t]*\n(?:[ \t]+name\s+(\S+))?"
SUBNET_BLOCK = r"irb\s*\{[^}]*?unit\s+(\d{1,4})[^}]*?address\s+(\d{1,3}(?:\.\d{1,3}){3}/\d{1,2})"
SUBNET_LINE = r"(?m)interface\s+Vlan(\d{1,4})\s*\n(?:\s+\S[^\n]*\n)*?\s+ip\s+address\s+(\d{1,3}(?:\.\d{1,3}){3}/\d{1,2})"
TUNNEL = R.TUNNEL
#: Set lines of Junos (interface, unit, address; interface, description).
SET_ADDRESS = rf"set\s+interfaces\s+(\S+)\s+unit\s+(\d+)\s+family\s+inet\s+address\s+({R.IP}(?:/\d{{1,2}})?)"
SET_DESCRIPTION = r"""set\s+interfaces\s+(\S+)\s+(?:unit\s+\d+\s+)?description\s+"?([^";\n]+)"""
#: Words in VLAN names, in order, and the kind each stands for; words of carriers in descriptions.
VLAN_KINDS = (("mgmt", "Management"), ("management", "Management"), ("ipmi", "IPMI/BMC"), ("bmc", "IPMI/BMC"), ("pxe", "PXE/Boot"), ("boot", "PXE/Boot"), ("storage", "Storage"), ("stor", "Storage"), ("dr", "DR/Backup"), ("backup", "DR/Backup"), ("advpn", "ADVPN"), ("vpn", "ADVPN"), ("prod", "Production/Access"), ("access", "Production/Access"), ("wan", "WAN/External"), ("transit", "WAN/External"), ("core", "Network/Transit"), ("fabric", "Network/Transit"), ("infra", "Infrastructure"))
#: Networks 10.x.y.0 by x and the range of y, then numbers of VLANs, and the kind each stands for.
SUBNET_KINDS = ((1, 0, 255, "Management"), (245, 200, 206, "Storage"), (245, 207, 207, "IPMI/BMC"), (245, 208, 209, "PXE/Boot"), (92, 0, 255, "DR/Backup"), (216, 0, 255, "DR/Backup"), (218, 0, 255, "DR/Backup"), (2, 0, 255, "Network/Transit"), (253, 0, 255, "Production/Access"))
NUMBER_KINDS = (((14, 15), "Management"), ((22, 23), "Storage"), ((24,), "DR/Backup"), ((28, 100), "IPMI/BMC"), ((30,), "PXE/Boot"), ((20, 21, 63, 64), "Production/Access"), ((206, 216, 226), "ADVPN"), ((10, 19, 33, 34, 66, 115), "Network/Transit"))
LAST_NUMBERS, LAST_KIND = 4000, "Infrastructure"
CARRIERS = (("telia", "Telia"), ("arelion", "Arelion"), ("lumen", "Lumen"), ("cogent", "Cogent"), ("ntt", "NTT"), ("gtt", "GTT"), ("leaseweb", "Leaseweb"), ("level3", "Level3"), ("centurylink", "CenturyLink"), ("verizon", "Verizon"), ("att", "AT&T"), ("deutsche telekom", "Deutsche Telekom"), ("vodafone", "Vodafone"), ("optus", "Optus"), ("telstra", "Telstra"), ("tpg", "TPG"), ("swisscom", "Swisscom"), ("colt", "Colt"), ("comcast", "Comcast"), ("orange", "Orange"), ("bt", "BT"), ("kpn", "KPN"), ("tata", "Tata"), ("akamai", "Akamai"))


def by_word(c: Column, words: tuple, other: str) -> Column:
    """The value of the first word that c holds, whatever the case."""
    out = None
    for w, v in words:
        hit = F.contains(F.lower(c), F.lit(w))
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(other)


def _pairs(pattern: str, a: int = 1, b: int = 2) -> Column:
    return F.arrays_zip(all_of(pattern, a).alias("a"), all_of(pattern, b).alias("b"))


def vlans(configs: DataFrame) -> DataFrame:
    """host, vlan_id, name, subnets ARRAY: the first non-empty name, all subnets in order."""
    junos = F.col("platform").startswith("jun")
    named = F.when(junos, F.concat(_pairs(VLAN_BLOCK, 2, 1), _pairs(VLAN_SET, 2, 1))).otherwise(_pairs(VLAN_LINE))
    nets = F.when(junos, _pairs(SUBNET_BLOCK)).otherwise(_pairs(SUBNET_LINE))
    rows = lambda xs, kind: configs.select("host", F.posexplode(xs).alias("pos", "p")).select("host", "pos", F.col("p.a").cast("int").alias("vlan_id"), F.lit(kind).alias("kind"), F.col("p.b").alias("v"))
    both = rows(named, "name").unionByName(rows(nets, "net"))
    name = F.when((F.col("kind") == "name") & (F.col("v") != ""), F.col("v"))
    net = F.when(F.col("kind") == "net", F.struct("pos", "v"))
    return both.groupBy("host", "vlan_id").agg(F.coalesce(F.min_by(name, F.when(name.isNotNull(), F.col("pos"))), F.lit("")).alias("name"), F.array_distinct(F.transform(F.array_sort(F.collect_list(net)), lambda x: x["v"])).alias("subnets"))


def subnet_kind(cidr: Column) -> Column:
    """The kind a network stands for, null for none."""
    octets = F.split(F.substring_index(cidr, "/", 1), r"\.")
    o = [F.get(octets, F.lit(i)).try_cast("int") for i in range(3)]
    out = None
    for second, low, high, kind in SUBNET_KINDS:
        hit = (o[0] == 10) & (o[1] == second) & o[2].between(low, high)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def number_kind(vlan_id: Column) -> Column:
    out = None
    for numbers, kind in NUMBER_KINDS:
        out = F.when(vlan_id.isin(*numbers), kind) if out is None else out.when(vlan_id.isin(*numbers), kind)
    return out.when(vlan_id >= LAST_NUMBERS, LAST_KIND).otherwise("Other")


def vlan_kind(by_subnet: Column, name: Column, vlan_id: Column) -> Column:
    """By the networks, else by words of the name, else by the number."""
    return F.coalesce(by_subnet, F.nullif(by_word(name, VLAN_KINDS, ""), F.lit("")), number_kind(vlan_id))


def merged_vlans(per_host: DataFrame) -> DataFrame:
    """vlan_id, name, n_hosts, n_subnets, kind over all devices: the name of the first host that has one, the kind of the first network that has one."""
    name = F.when(F.col("name") != "", F.col("name"))
    rows = per_host.groupBy("vlan_id").agg(F.coalesce(F.min_by(name, F.when(name.isNotNull(), F.col("host"))), F.lit("")).alias("name"), F.count("*").alias("n_hosts"))
    nets = per_host.select("vlan_id", "host", F.posexplode("subnets").alias("pos", "net")).withColumn("k", subnet_kind(F.col("net")))
    nets = nets.groupBy("vlan_id").agg(F.count_distinct("net").alias("n_subnets"), F.min_by("k", F.when(F.col("k").isNotNull(), F.struct("host", "pos"))).alias("by_subnet"))
    rows = rows.join(nets, "vlan_id", "left")
    return rows.select("vlan_id", "name", "n_hosts", F.coalesce("n_subnets", F.lit(0).cast("bigint")).alias("n_subnets"), vlan_kind(F.col("by_subnet"), F.col("name"), F.col("vlan_id")).alias("kind"))


def wan_addresses(interfaces: DataFrame) -> DataFrame:
    """host, name, ip, description, carrier of interfaces(host, name, ip, description) with a public address."""
    public = is_public(ip_number(F.substring_index("ip", "/", 1)))
    return interfaces.where(public).select("host", "name", "ip", "description", by_word(F.col("description"), CARRIERS, "").alias("carrier"))


def _scoped(configs: DataFrame) -> DataFrame:
    """scoped_addresses with pos, the place in the order of the text."""
    opening = r"^\s*((?:ge|xe|et|ae|eth|reth|fe|me|fxp|st|lo)\S*)\s*\{"
    address = rf"address\s+({R.IP}(?:/\d{{1,2}})?)\s*;"
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    parts = lambda x: F.struct(F.regexp_extract(x, opening, 1).alias("opened"), F.regexp_extract(x, r"^\s*description\s+\"?([^\";\n]+)\"?\s*;", 1).alias("told"), F.regexp_extract_all(x, F.lit(address), F.lit(1)).alias("ips"), (count(x, "{") - count(x, "}")).alias("net"))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<name:string,at:int>>").alias("stack"), F.lit("").alias("d"), F.array().cast("array<struct<name:string,ip:string,description:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        opens = x["opened"] != ""
        stack = F.when(opens, F.array_append(acc["stack"], F.struct(x["opened"].alias("name"), acc["depth"].alias("at")))).otherwise(acc["stack"])
        d = F.when(x["told"] != "", strip(x["told"])).when(opens, F.lit("")).otherwise(acc["d"])
        name = F.try_element_at(stack, F.lit(-1))["name"]
        hits = F.transform(x["ips"], lambda ip: F.struct(name.alias("name"), ip.alias("ip"), d.alias("description")))
        found = F.when((F.size(x["ips"]) > 0) & (F.size(stack) > 0), F.concat(acc["found"], hits)).otherwise(acc["found"])
        depth = acc["depth"] + x["net"]
        left = F.filter(stack, lambda s: s["at"] < depth)
        return F.struct(depth.alias("depth"), left.alias("stack"), F.when(F.size(left) < F.size(stack), F.lit("")).when(F.size(stack) == 0, F.lit("")).otherwise(d).alias("d"), found.alias("found"))

    rows = configs.select("host", F.aggregate(F.transform(F.split("text", "\n"), parts), start, step)["found"].alias("found"))
    return rows.select("host", F.posexplode("found").alias("pos", "f")).select("host", "pos", "f.*")


def scoped_addresses(configs: DataFrame) -> DataFrame:
    """host, name, ip, description of addresses in nested blocks: each line's open interface, by a fold over the lines.

    The stack holds the open interfaces with the depth at which each began. When one closes, the one around it is open
    again, without a description until the next is told."""
    return _scoped(configs).drop("pos")


def set_addresses(configs: DataFrame) -> DataFrame:
    """host, pos, name, ip, description of addresses in set lines; name is interface.unit, the interface's first description counts."""
    at = F.arrays_zip(*[all_of(SET_ADDRESS, k).alias(n) for k, n in ((1, "name"), (2, "unit"), (3, "ip"))])
    told = F.arrays_zip(all_of(SET_DESCRIPTION, 1).alias("name"), F.transform(all_of(SET_DESCRIPTION, 2), strip).alias("d"))
    both = F.concat(F.transform(at, lambda x: F.struct(x["name"].alias("name"), x["unit"].alias("unit"), x["ip"].alias("ip"), F.lit(None).cast("string").alias("d"))), F.transform(told, lambda x: F.struct(x["name"].alias("name"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("ip"), x["d"].alias("d"))))
    rows = configs.select("host", F.posexplode(both).alias("pos", "x")).select("host", "pos", "x.*")
    hit = F.when(F.col("ip").isNotNull(), F.struct("pos", "unit", "ip"))
    rows = rows.groupBy("host", "name").agg(F.collect_list(hit).alias("hits"), F.coalesce(F.min_by("d", F.when(F.col("d").isNotNull(), F.col("pos"))), F.lit("")).alias("description"))
    return rows.select("host", "name", "description", F.inline("hits")).select("host", "pos", F.concat_ws(".", "name", "unit").alias("name"), "ip", "description")


def junos_addresses(configs: DataFrame) -> DataFrame:
    """host, name, ip, description of addresses in nested blocks and in set lines: of equal addresses of a host the first, blocks before lines."""
    rows = _scoped(configs).withColumn("form", F.lit(0)).unionByName(set_addresses(configs).withColumn("form", F.lit(1)))
    return rows.groupBy("host", "ip").agg(F.min(F.struct("form", "pos", "name", "description")).alias("x")).select("host", "x.name", "ip", "x.description")


def wan_of(configs: DataFrame) -> DataFrame:
    """wan_addresses() of configurations: of junos in nested blocks and set lines, else of indented blocks."""
    junos = F.col("platform").startswith("jun")
    plain = facts.interfaces(configs.where(~junos), braced=False).select("host", "name", "ip", "description")
    return wan_addresses(plain.unionByName(junos_addresses(configs.where(junos))))


def carrier_asn(text: Column, carrier: Column) -> Column:
    """The system of the first session within 500 characters behind a description that names the carrier, else ''."""
    out = None
    for word, name in CARRIERS:
        hit = F.regexp_extract(text, rf"(?i)description[^;]*{word}[^;]*[\s\S]{{0,500}}?peer-as\s+(\d+)", 1)
        out = F.when(carrier == name, hit) if out is None else out.when(carrier == name, hit)
    return out.otherwise("")


def carriers(wan: DataFrame, configs: DataFrame) -> DataFrame:
    """carrier, n_addresses, n_interfaces, asn, shutdown of wan_addresses(): the system that the first host with one tells.

    A carrier is shut down where a description says so, or where the text disables or deactivates one of its interfaces."""
    rows = wan.where("carrier != ''").join(configs.select("host", "text"), "host")
    literal = F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E"))
    off = F.rlike("text", F.concat(F.lit(r"(?i)(?:deactivate\s+interfaces\s+"), literal, F.lit(r"|interfaces\s+"), literal, F.lit(r"[\s\S]{0,200}disable)")))
    down = F.lower("description").rlike("disabled|shutdown|decommis") | off
    rows = rows.select("carrier", "host", "ip", "name", down.alias("down"), F.nullif(carrier_asn(F.col("text"), F.col("carrier")), F.lit("")).alias("asn"))
    return rows.groupBy("carrier").agg(F.count_distinct("ip").alias("n_addresses"), F.count_distinct("host", "name").alias("n_interfaces"), F.coalesce(F.min_by("asn", F.when(F.col("asn").isNotNull(), F.col("host"))), F.lit("")).alias("asn"), F.bool_or("down").alias("shutdown"))


def tunnels(configs: DataFrame) -> DataFrame:
    """host, pos, interface, address, description of tunnel interfaces of junos, each up to its first closing brace."""
    own = F.arrays_zip(all_of(TUNNEL, 1).alias("interface"), all_of(TUNNEL, 2).alias("body"))
    rows = configs.where("platform like 'jun%'").select("host", F.posexplode(own).alias("pos", "t"))
    told = F.regexp_extract("t.body", r"description\s+([^;\n]+)", 1)
    return rows.select("host", "pos", "t.interface", F.regexp_extract("t.body", rf"address\s+({R.IP}/\d{{1,2}})", 1).alias("address"), F.btrim(told, F.lit(' "')).alias("description"))
