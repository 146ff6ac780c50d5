"""Results as files and texts. Tables are written by the executors; texts hold small results and are made on the driver."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a text shows of a table.
SHOWN = 500


def findings_csv(findings: DataFrame, path: str) -> None:
    """severity, category, title, affected_devices, evidence, rationale; line ends become blanks, lists are joined."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ").alias(c)
    rows = findings.select(*map(flat, ("severity", "category", "title")), F.array_join("affected_devices", ", ").alias("affected_devices"), *map(flat, ("evidence", "rationale")))
    rows.write.mode("overwrite").option("header", "true").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def cell(value: object) -> str:
    """A value inside a table of Markdown."""
    return re.sub(r"\s*\n\s*", " ", str("" if value is None else value)).replace("\\", "\\\\").replace("|", "\\|")


def code(value: object) -> str:
    return "`" + str("" if value is None else value).replace("`", "'") + "`"


def shown(df: DataFrame, limit: int = SHOWN) -> tuple[list[str], list[tuple], bool]:
    """Columns, the first `limit` rows, and whether there are more."""
    rows = [tuple(r) for r in df.limit(limit + 1).collect()]
    return df.columns, rows[:limit], len(rows) > limit


def markdown(title: str, parts: Iterable[tuple[str, DataFrame]], limit: int = SHOWN) -> str:
    out = [f"# {title}"]
    for name, df in parts:
        columns, rows, more = shown(df, limit)
        out += ["", f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows] + (["", f"Only the first {limit} rows are shown."] if more else [])
    return "\n".join(out) + "\n"


def page(title: str, parts: Iterable[tuple[str, DataFrame]], limit: int = SHOWN) -> str:
    """The same as a page that stands alone; every value is escaped."""
    e = lambda v: html.escape(str("" if v is None else v))
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>"]
    for name, df in parts:
        columns, rows, more = shown(df, limit)
        out.append(f"<h2>{e(name)}</h2><table><tr>" + "".join(f"<th>{e(c)}</th>" for c in columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in rows]
        out.append("</table>" + f"<p>Only the first {limit} rows are shown.</p>" * more)
    return "".join(out) + "</body></html>"


def _name(x: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", x)


#: Shapes of nodes by role, colours by the worst finding.
MERMAID_SHAPES, GRAPHVIZ_SHAPES = {"firewall": ("[(", ")]"), "router": ("([", "])")}, {"firewall": "octagon", "router": "ellipse"}
COLOURS = {"critical": "#f85149", "high": "#ff7b72", "medium": "#d29922", "low": "#79c0ff"}
TAGS = (("has_bgp", "BGP"), ("has_ospf", "OSPF"), ("has_evpn", "EVPN"), ("has_vxlan", "VXLAN"), ("isp_uplink", "ISP"))


def _links(edges: DataFrame, limit: int) -> tuple[list, bool]:
    rows = edges.select("source", "target", "rule", "confidence").orderBy("source", "target").limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def _nodes(nodes: DataFrame | None, rows: list, limit: int) -> tuple[list[dict], bool]:
    """Nodes of described_nodes() and overlay(), else those of the links; whether there are more."""
    if nodes is None:
        return [{"host": n} for n in sorted({x for r in rows for x in (r["source"], r["target"])})], False
    found = [r.asDict() for r in nodes.orderBy("host").limit(limit + 1).collect()]
    return found[:limit], len(found) > limit


def mermaid(edges: DataFrame, nodes: DataFrame | None = None, limit: int = SHOWN) -> str:
    """Links of best() as a diagram text, with nodes(host, role, flags, severity) those without links too; what is cut is said."""
    rows, more = _links(edges, limit)
    known, many = _nodes(nodes, rows, limit)
    out = ["graph LR"]
    for n in known:
        left, right = MERMAID_SHAPES.get(n.get("role"), ("[", "]"))
        tags = ",".join(t for c, t in TAGS if n.get(c))
        label = n["host"].replace('"', "'") + (f"<br/>{tags}" if tags else "")
        out.append(f'  {_name(n["host"])}{left}"{label}"{right}')
    out += [f"  {_name(r['source'])} ---|{r['rule']}| {_name(r['target'])}" for r in rows]
    out += [f"  style {_name(n['host'])} fill:{COLOURS[n['severity']]}" for n in known if n.get("severity") in COLOURS]
    return "\n".join(out + [f"%% only the first {limit} nodes and links are shown"] * (more or many)) + "\n"


def graphviz(edges: DataFrame, nodes: DataFrame | None = None, limit: int = SHOWN) -> str:
    """The same for Graphviz."""
    rows, more = _links(edges, limit)
    known, many = _nodes(nodes, rows, limit)
    quoted = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = ["graph network {"]
    for n in known if nodes is not None else ():
        tags = ", ".join(t for c, t in TAGS if n.get(c))
        out.append(f"  {quoted(n['host'])} [shape={GRAPHVIZ_SHAPES.get(n.get('role'), 'box')}, style=filled, fillcolor={quoted(COLOURS.get(n.get('severity'), '#21262d'))}, label={quoted(n['host'] + (chr(10) + tags if tags else ''))}];")
    out += [f"  {quoted(r['source'])} -- {quoted(r['target'])} [label={quoted(r['rule'])}];" for r in rows]
    return "\n".join(out + [f"  // only the first {limit} nodes and links are shown"] * (more or many) + ["}"]) + "\n"


def analysis(classified: DataFrame, external_alerts: int = 0, events: int = 300) -> DataFrame:
    """One row: score, grade, counts by severity and category, ranked items, busiest devices and the newest `events` events as one value."""
    from logloom.operators import events as E

    one = E.health(classified, external_alerts)
    pairs = lambda df, k: df.agg(F.map_from_entries(F.collect_list(F.struct(k, "n"))).alias(f"{k}_counts"))
    rows = lambda df, name, *order: df.agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))).alias(name))
    items = rows(E.action_items(classified), "action_items", "rank")
    newest = E.newest_by_severity(classified, events).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(E.severity_rank(F.col("severity")), F.desc("timestamp"), "seq")))
    devices = E.top_devices(classified)
    parts = [pairs(E.severity_counts(classified), "severity"), pairs(E.category_counts(classified), "category"), items, devices.agg(F.collect_list(F.struct(*devices.columns)).alias("top_devices")), rows(newest, "events", "place")]
    for part in parts:
        one = one.crossJoin(F.broadcast(part))  # one row each
    return one


def analysis_json(classified: DataFrame, **kw: int) -> str:
    return analysis(classified, **kw).select(F.to_json(F.struct("*"))).first()[0]
