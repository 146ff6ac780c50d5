"""Queries that run as streams over what is there, and segment queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.session import stored, table
from logloom.operators import segments
from logloom.plans import config_sql, fleet
from logloom.plans.config_sql import _q
from logloom.plans.log_queries import classified_sql
from logloom.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
LIMITS = {"routing": 1, "interface": 1, "security": 3}


def _us(c: str):
    return F.unix_micros(c)


def stream_severity_counts(spark, sf_dir):
    return stream.run_now(stream.severity_counts(stream.read(spark, f"{sf_dir}/log_event.parquet")), ["severity", "category"], f"{sf_dir}/log_event.parquet")


def stream_windows(spark, sf_dir):
    rows = stream.run_now(stream.windows(stream.read(spark, f"{sf_dir}/log_event.parquet")), ["start", "hostname", "category"], f"{sf_dir}/log_event.parquet")
    return rows.withColumn("start", _us("start"))


def window_alerts(spark, sf_dir):
    return stream.alerts(stream.windows(table(spark, sf_dir, "log_event")), LIMITS).withColumn("start", _us("start"))


def host_sessions(spark, sf_dir):
    rows = stream.sessions(table(spark, sf_dir, "log_event").where("hostname != ''"))
    return rows.withColumns({"start": _us("start"), "end": _us("end")})


def _configs(spark, sf_dir):
    return fleet.configs(spark, sf_dir)


def vlans(spark, sf_dir):
    return segments.vlans(_configs(spark, sf_dir)).withColumn("subnets", F.array_join("subnets", ","))


def vlan_kinds(spark, sf_dir):
    return segments.merged_vlans(segments.vlans(_configs(spark, sf_dir)))


def vlan_kind_counts(spark, sf_dir):
    return vlan_kinds(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def wan_addresses(spark, sf_dir):
    return segments.wan_of(_configs(spark, sf_dir))


def nested_addresses(spark, sf_dir):
    return segments.scoped_addresses(_configs(spark, sf_dir).where("platform like 'jun%'"))


def carriers(spark, sf_dir):
    configs = stored(_configs(spark, sf_dir), "configs")
    return segments.carriers(segments.wan_of(configs), configs)


def tunnels(spark, sf_dir):
    return segments.tunnels(_configs(spark, sf_dir)).drop("pos")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (stream_severity_counts, stream_windows, window_alerts, host_sessions, vlans, vlan_kinds, vlan_kind_counts, nested_addresses, wan_addresses, carriers, tunnels)}


def oracle_sql() -> dict[str, str]:
    c = classified_sql()
    w = c + ", w AS (SELECT (epoch_us(l.received_at) // 300000000) * 300000000 AS start, c0.hostname, vc AS category, count(*) AS n FROM (SELECT seq, hostname, category AS vc FROM c) c0 JOIN log_event l USING (seq) GROUP BY ALL)"
    return {
        "stream_severity_counts": c + " SELECT severity, category, count(*) AS n FROM c GROUP BY ALL",
        "stream_windows": w + " SELECT start, hostname, category, n FROM w",
        "window_alerts": w + " SELECT start, hostname, category, n FROM w WHERE n > CASE category " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in LIMITS.items()) + " ELSE 1000000000 END",
        "host_sessions": """WITH e AS (SELECT split_part(hostname, '.', 1) AS hostname, epoch_us(received_at) AS t FROM log_event WHERE hostname <> ''),
 b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY hostname ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM e),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY hostname ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM b)
 SELECT min(t) AS start, max(t) + 1800000000 AS "end", hostname, count(*) AS n FROM g GROUP BY hostname, k""",
        **config_sql.segment_queries(),
    }
