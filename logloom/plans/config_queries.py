"""Queries over device configurations, raw lines and texts, and the same questions as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import config_rules as R
from logloom.functions.session import stored, table
from logloom.operators import cascade, compliance, diff, facts, sanitize, segments, topology
from logloom.plans import config_sql, fleet

Query = Callable[[SparkSession, str], DataFrame]
SEARCHES = config_sql.SEARCHES


def _configs(spark, sf_dir):
    return fleet.configs(spark, sf_dir)


def _stored_configs(spark, sf_dir):
    """The fleet's texts, spread over all tasks: few bytes may be much work for patterns."""
    return stored(_configs(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "host"), "configs")


def _nodes(spark, sf_dir):
    """Facts of the fleet, from one reading of its texts each for devices and interfaces."""
    return stored(facts.nodes(_stored_configs(spark, sf_dir)), "nodes")


def _sites(spark, sf_dir):
    return table(spark, sf_dir, "site_manifest").select("site_id", "default_link_speed")


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "device_profile").select(F.col("profile_id").alias("id"), F.regexp_replace("config_text", "\r", "").alias("text"))


def parse_lines(spark, sf_dir):
    return cascade.parse(table(spark, sf_dir, "raw_line"))


def parse_format_counts(spark, sf_dir):
    return cascade.parse(table(spark, sf_dir, "raw_line")).groupBy("fmt", "severity_raw").agg(F.count("*").alias("n"))


def routing_lines(spark, sf_dir):
    return cascade.parse_routing(table(spark, sf_dir, "raw_line"))


def sanitize_text(spark, sf_dir):
    return sanitize.sanitize(_texts(spark, sf_dir)).select("id", "n", F.sha2("text", 256).alias("digest"))


def sanitize_report(spark, sf_dir):
    rows = sanitize.sanitize(_texts(spark, sf_dir)).select(F.explode("by_rule").alias("rule", "n"))
    return rows.groupBy("rule").agg(F.sum("n").alias("n"))


def mask_public_ipv4(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return sanitize.mask_public(rows).select("id", "n", F.sha2("text", 256).alias("digest"))


def mask_pii(spark, sf_dir):
    """Configurations without secrets, names and public addresses."""
    rows = _configs(spark, sf_dir).select(F.col("host").alias("id"), "text")
    return sanitize.sanitize_all(rows, mask_pii=True).select("id", "n", F.sha2("text", 256).alias("digest"))


def mask_report(spark, sf_dir):
    rows = sanitize.mask_names(_configs(spark, sf_dir).select(F.col("host").alias("id"), "text")).select(F.explode("by_rule").alias("rule", "n"))
    return rows.groupBy("rule").agg(F.sum("n").alias("n"))


def device_ips(spark, sf_dir):
    return facts.addresses(_configs(spark, sf_dir)).select("host", "cidr", "ip_num", "net_num", F.col("length").cast("bigint").alias("length"))


def bgp_peers(spark, sf_dir):
    return facts.bgp_peers(_configs(spark, sf_dir)).drop("site_id")


def mlag_peers(spark, sf_dir):
    return _configs(spark, sf_dir).select("host", F.explode(facts.distinct_valid(facts.all_of(R.MLAG_PEER))).alias("ip"))


def descriptions(spark, sf_dir):
    return facts.descriptions(_configs(spark, sf_dir)).select("host", F.col("pos").cast("bigint").alias("pos"), "description")


def interfaces(spark, sf_dir):
    return facts.interfaces(_configs(spark, sf_dir)).select("host", "name", "ip", "description", "speed")


def interface_ospf(spark, sf_dir):
    rows = facts.interfaces(_configs(spark, sf_dir)).drop("pos", "ip", "description", "speed")
    return rows.where(F.coalesce(*[F.col(c).cast("string") for c in rows.columns if c.startswith("ospf_")]).isNotNull())


def address_families(spark, sf_dir):
    return facts.families(_configs(spark, sf_dir)).select("host", F.array_join("families", ",").alias("families"))


def device_profiles(spark, sf_dir):
    return facts.wide(_configs(spark, sf_dir))


def named_values(spark, sf_dir):
    return facts.named_values(_configs(spark, sf_dir))


def service_endpoints(spark, sf_dir):
    return facts.endpoints(_configs(spark, sf_dir)).withColumn("endpoints", F.array_join("endpoints", ","))


def lifecycle(spark, sf_dir):
    return facts.lifecycle(facts.wide(_configs(spark, sf_dir)).select("host", "platform", "version"))


def peer_blocks(spark, sf_dir):
    return facts.peer_blocks(_configs(spark, sf_dir)).select("host", "ip", "remote_as")


def node_facts(spark, sf_dir):
    rows = _nodes(spark, sf_dir)
    numbers = lambda c: F.array_join(F.transform(F.array_sort(c), lambda v: v.cast("string")), ",").alias(c)
    return rows.select("host", "local_asn", "router_id", "vtep_source", "vtep_ip", numbers("l2_vnis"), numbers("l3_vnis"), F.array_join("families", ",").alias("families"), F.size("ifs").cast("bigint").alias("interfaces"))


def node_flags(spark, sf_dir):
    return topology.described_nodes(_nodes(spark, sf_dir), table(spark, sf_dir, "device_inventory"))


def node_overlay(spark, sf_dir):
    return topology.overlay(_configs(spark, sf_dir), table(spark, sf_dir, "action_item"))


def platform_guesses(spark, sf_dir):
    return _configs(spark, sf_dir).select("host", facts.platform_guess(F.col("text")).alias("platform"))


def edge_candidates(spark, sf_dir):
    return topology.candidates(_nodes(spark, sf_dir)).select("source", "target", "rule", "confidence").distinct()


def subnet_owners(spark, sf_dir):
    rows = topology.subnet_owners(facts.addresses(_nodes(spark, sf_dir)))
    return rows.select("site_id", "net_num", F.col("length").cast("bigint").alias("length"), F.array_join("owners", ",").alias("owners"))


def edges_best(spark, sf_dir):
    return topology.best(topology.candidates(_nodes(spark, sf_dir)))


def _detail(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return topology.detail(topology.best(topology.candidates(nodes)), nodes, _sites(spark, sf_dir))


def edge_detail(spark, sf_dir):
    rows, text = _detail(spark, sf_dir), lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return rows.withColumns({c: text(c) for c in ("families", "l2_vnis", "l3_vnis", "layers")})


def edge_layers(spark, sf_dir):
    return topology.layer_counts(_detail(spark, sf_dir))


def compliance_checks(spark, sf_dir):
    return compliance.check(_configs(spark, sf_dir))


def compliance_rollup(spark, sf_dir):
    rows = compliance.rollup(compliance.check(_configs(spark, sf_dir)))
    return rows.withColumn("failing", F.array_join(F.transform("failing", lambda f: F.concat(f["device"], F.lit(": "), f["reason"])), "|"))


def compliance_totals(spark, sf_dir):
    return compliance.totals(compliance.check(_configs(spark, sf_dir)))


def fleet_search(spark, sf_dir):
    configs = _configs(spark, sf_dir)
    parts = [compliance.search_fleet(configs, p).select(F.lit(p).alias("pattern"), "device", "match_count", F.array_join("snippets", "|").alias("snippets")) for p in SEARCHES]
    return parts[0].unionByName(parts[1])


def fleet_search_totals(spark, sf_dir):
    hits = fleet_search(spark, sf_dir).groupBy("pattern").agg(F.count("*").alias("devices"), F.sum("match_count").alias("matches"))
    return hits.crossJoin(F.broadcast(_configs(spark, sf_dir).agg(F.count("*").alias("checked"))))  # one row


def fingerprints(spark, sf_dir):
    """What to look for in a fleet, of the descriptions and first samples of action items."""
    rows = table(spark, sf_dir, "action_item").select(F.col("item_id").alias("id"), F.concat_ws("\n", "description", F.get("sample_messages", F.lit(0))).alias("evidence"))
    return compliance.fingerprint(rows)


def role_descriptions(spark, sf_dir):
    """Of each device, what it is among those of its role and site, in order of names."""
    return facts.role_descriptions(_configs(spark, sf_dir))


def role_counts(spark, sf_dir):
    return _configs(spark, sf_dir).groupBy(F.element_at(F.split("host", "-"), 2).alias("role")).agg(F.count("*").alias("n"))


def version_counts(spark, sf_dir):
    return facts.wide(_configs(spark, sf_dir)).where("version != ''").groupBy("version").agg(F.count("*").alias("n"))


def composition(spark, sf_dir):
    rows = facts.wide(_configs(spark, sf_dir)).withColumn("role", F.when(F.col("function") != "", F.col("function")).otherwise("unknown"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), *[F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",").alias(f"{c}s") for c in ("version", "model", "host")])


def bgp_split(spark, sf_dir):
    """Sessions inside and outside of the autonomous systems that devices run, by site."""
    configs = _configs(spark, sf_dir)
    profile = facts.wide(configs)
    own = profile.where("local_asn != ''").select(F.col("local_asn").cast("bigint").alias("asn")).distinct().withColumn("inside", F.lit(True))
    peers = facts.bgp_peers(configs).where("asn is not null").join(own, "asn", "left")
    return peers.groupBy("site_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("inside")).alias("ibgp"), F.count_if(F.col("inside").isNull()).alias("ebgp"))


def asn_holders(spark, sf_dir):
    return facts.wide(_configs(spark, sf_dir)).where("local_asn != ''").groupBy("local_asn").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"))


def remote_as_top(spark, sf_dir):
    """The systems with most sessions, and who that is: a carrier, one of the fleet's own, or someone else."""
    configs = stored(_configs(spark, sf_dir), "configs")
    known = segments.carriers(segments.wan_of(configs), configs).where("asn != ''").groupBy(F.col("asn").cast("bigint").alias("asn")).agg(F.min("carrier").alias("carrier"))
    own = facts.wide(configs).where("local_asn != ''").select(F.col("local_asn").cast("bigint").alias("asn")).distinct().withColumn("own", F.lit(True))
    rows = facts.bgp_peers(configs).where("asn is not null").groupBy("asn").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "asn").limit(15)
    who = F.coalesce("carrier", F.when(F.col("own"), "internal/iBGP"), F.lit("external (unknown)"))
    return rows.join(known, "asn", "left").join(own, "asn", "left").select("asn", "n", who.alias("identity"))


def missing_services(spark, sf_dir):
    """By site, the devices without NTP, syslog or AAA, and those with SNMP communities."""
    configs = _configs(spark, sf_dir)
    per = facts.endpoints(configs).groupBy("host").agg(F.collect_set("service").alias("s"))
    rows = configs.select("host", "site_id", F.col("text").rlike(dict(R.FLAGS)["snmp_v2c"]).alias("v2c")).join(per, "host", "left")
    has = lambda s: F.coalesce(F.array_contains("s", s), F.lit(False))
    lists = {"no_ntp": ~has("ntp"), "no_syslog": ~has("syslog"), "no_aaa": ~has("radius") & ~has("tacacs"), "snmp_v2c": F.col("v2c")}
    return rows.groupBy("site_id").agg(F.count("*").alias("devices"), *[F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("host")))), ",").alias(n) for n, c in lists.items()])


def site_facts(spark, sf_dir):
    """By site, what runs anywhere in it, sums over its devices, distinct public addresses, devices that lead out and old software."""
    configs = _stored_configs(spark, sf_dir)
    nodes, wide = facts.nodes(configs), facts.wide(configs)
    old = facts.lifecycle(wide.select("host", "platform", "version")).select("host", facts.is_risky(F.col("status")).alias("risky"))
    rows = nodes.select("host", "site_id", "function", *[f"has_{n}" for n, _ in R.NODE_WORDS], F.size("peers").alias("n_peers"), F.size("ifs").alias("n_ifs")).join(wide.select("host", "isis", "bfd", "n_static_routes", "n_descriptions"), "host").join(old, "host")
    wan = segments.wan_of(configs).join(configs.select("host", "site_id"), "host").groupBy("site_id").agg(F.count_distinct("ip").alias("wan_ips"))
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    out = rows.groupBy("site_id").agg(F.count("*").alias("devices"), *[F.bool_or(c).alias(c) for c in (*[f"has_{n}" for n, _ in R.NODE_WORDS], "isis", "bfd")], *map(total, ("n_peers", "n_ifs", "n_static_routes", "n_descriptions")), F.count_if(facts.is_gateway(F.col("host"), F.col("function"))).alias("gateways"), F.count_if("risky").alias("risky"))
    return out.join(wan, "site_id", "left").withColumn("wan_ips", F.coalesce("wan_ips", F.lit(0).cast("bigint")))


def facilities(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for code, city, _ in R.FACILITIES for x in (code, city)])
    return table(spark, sf_dir, "site_manifest").select("site_id", F.coalesce(F.try_element_at(known, F.lower(F.substring("site_id", 1, 3))), F.lit("Unknown city")).alias("city"))


def site_inventory(spark, sf_dir):
    """Devices, captures and bytes of each site of the manifest."""
    sites = table(spark, sf_dir, "site_manifest").select("site_id", "vendor")
    devices = table(spark, sf_dir, "device_inventory").groupBy("site_id").agg(F.count("*").alias("devices"))
    captures = table(spark, sf_dir, "device_profile").groupBy("site_id").agg(F.count("*").alias("captures"), F.sum("config_size_bytes").alias("bytes"))
    rows = sites.join(devices, "site_id", "left").join(captures, "site_id", "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("site_id", "vendor", *[F.coalesce(c, zero).alias(c) for c in ("devices", "captures", "bytes")])


def diff_sections(spark, sf_dir):
    return diff.sections(diff.pairs(table(spark, sf_dir, "device_profile")))


def diff_unified(spark, sf_dir):
    return diff.unified(diff.pairs(table(spark, sf_dir, "device_profile")))


def queries() -> dict[str, Query]:
    own = (
        parse_lines, parse_format_counts, routing_lines, sanitize_text, sanitize_report, mask_public_ipv4, mask_pii, mask_report, device_ips, bgp_peers, mlag_peers, descriptions, interfaces, interface_ospf, address_families, device_profiles, named_values, service_endpoints, lifecycle, peer_blocks,
        node_facts, node_flags, node_overlay, platform_guesses, edge_candidates, edges_best, subnet_owners, edge_detail, edge_layers, compliance_checks, compliance_rollup, compliance_totals, fleet_search, fleet_search_totals, fingerprints, role_descriptions, role_counts, version_counts, composition, bgp_split,
        asn_holders, remote_as_top, missing_services, site_facts, facilities, site_inventory, diff_sections, diff_unified,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return config_sql.queries()
