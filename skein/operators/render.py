"""Compact text of results, made on the driver from small collected frames."""

from __future__ import annotations

import datetime
from itertools import combinations

from pyspark.sql import functions as F

from skein.model import Graph
from skein.operators import find, joins, report, text

#: Columns that are folded into one line, and what marks a soft delete.
TIMESTAMPS = ("created_at", "updated_at", "deleted_at", "createdAt", "updatedAt", "deletedAt")
DEFAULT_SHOWN = 40


def column_line(name: str, attrs: dict, target: str | None) -> str:
    kind = f"enum({attrs['enum_values']})" if attrs.get("enum_values") else attrs.get("data_type", "")
    parts = [name, kind]
    if attrs.get("primary_key"):
        parts.append("PK")
    else:
        parts += [mark for key, mark in (("unique", "unique"), ("not_null", "NN")) if attrs.get(key)]
    if target:
        parts.append(f"→ {target}")
    default = attrs.get("default")
    if default and "nextval" not in default and len(default) <= DEFAULT_SHOWN:
        parts.append(f"default {default}")
    if attrs.get("comment"):
        parts.append(f"-- {attrs['comment']}")
    return "  " + " ".join(p for p in parts if p)


def render(graph: Graph, name: str) -> str:
    """A table, view, schema, endpoint, function or definition with what surrounds it."""
    node_id = report.resolve_id(graph, name)
    if node_id is None:
        return f"not found: {name}"
    node = graph.nodes.where(F.col("id") == node_id).first()
    edges = report.describe(graph, node_id).collect()
    ids = [e.other for e in edges]
    near = {r.id: r for r in graph.nodes.where(F.col("id").isin(ids)).collect()} if ids else {}
    named = lambda kind, way: [near[e.other].name for e in edges if e.type == kind and e.dir == way and e.other in near]
    if node.type in ("function", "definition"):
        return _code(node, named)
    if node.type == "endpoint":
        return _endpoint(graph, node, edges, near)
    return _container(graph, node, edges, near)


def _container(graph: Graph, node, edges: list, near: dict) -> str:
    a = node.attrs or {}
    rows = a.get("row_count") or (f"~{a['row_count_estimate']}" if a.get("row_count_estimate") else "")
    lines = [f"{node.type} {node.name}" + (f" ({rows} rows)" if rows not in ("", "0", "~0") else "") + (f" -- {a['comment']}" if a.get("comment") else "")]
    members = [near[e.other] for e in edges if e.type in ("HAS_COLUMN", "HAS_PROPERTY") and e.dir == "out" and e.other in near]
    targets = {r.src: r.dst for r in graph.edges.where(F.col("type").isin("FOREIGN_KEY", "REFERS_TO") & F.col("src").isin([m.id for m in members])).orderBy(F.desc("ord")).collect()} if members else {}
    stamps = [m.name.rsplit(".", 1)[-1] for m in members if m.name.rsplit(".", 1)[-1] in TIMESTAMPS]
    for m in members:
        short = m.name.rsplit(".", 1)[-1]
        if short not in TIMESTAMPS:
            target = targets.get(m.id)
            lines.append(column_line(short, m.attrs or {}, target.split(":", 1)[1].removeprefix("public.") if target else None))
    if stamps:
        lines.append("  timestamps: " + ", ".join(stamps) + (" (soft delete)" if any(s.startswith("deleted") for s in stamps) else ""))
    if a.get("enum_values"):
        lines.append(f"  values: {a['enum_values']}")
    if a.get("default_filter"):
        lines.append(f"  default filter: {a['default_filter']}")
    pair = lambda e: f"{near[e.other].name} ({e.attrs['from_column']}→{e.attrs['to_column']})" if e.attrs.get("from_column") else near[e.other].name
    out = [pair(e) for e in edges if e.type == "REFERENCES" and e.dir == "out" and e.other in near]
    back = [near[e.other].name + (f" ({e.attrs['from_column']})" if e.attrs.get("from_column") else "") for e in edges if e.type == "REFERENCES" and e.dir == "in" and e.other in near]
    lines += [f"  references: {', '.join(out)}"] if out else []
    lines += [f"  referenced by: {', '.join(back)}"] if back else []
    return "\n".join(lines)


def _endpoint(graph: Graph, node, edges: list, near: dict) -> str:
    a = node.attrs or {}
    base = graph.nodes.where("type = 'api'").select(F.col("attrs")["base_url"].alias("u")).first()
    lines = [node.name + (f" -- {a['comment']}" if a.get("comment") else ""), f"  url: {(base.u if base and base.u else '')}{a.get('path', '')}"]
    lines += [f"  {k}: {a[k]}" for k in ("auth", "tags", "path_params", "query_params", "header_params") if a.get(k)]
    shown = lambda e: ("array<%s>" if e.attrs.get("cardinality") == "array" else "%s") % near[e.other].name + (f" ({e.attrs['status']})" if e.attrs.get("status") else "")
    for title, kind in (("accepts", "ACCEPTS"), ("returns", "RESPONDS_WITH")):
        found = [shown(e) for e in edges if e.type == kind and e.other in near]
        lines += [f"  {title}: {', '.join(found)}"] if found else []
    return "\n".join(lines)


def capped(names: list[str], most: int) -> str:
    names = sorted(set(names))
    return ", ".join(names[:most]) + (f" … +{len(names) - most} more" if len(names) > most else "")


def _code(node, named) -> str:
    a = node.attrs or {}
    place = f"{a.get('file', '')}:{a.get('line_start', '')}" + (f"-{a['line_end']}" if a.get("line_end") else "")
    lines = [a.get("signature") or node.name, f"  at {place}"]
    lines += [f"  {a['doc']}"] if a.get("doc") else []
    for title, kind, way, most in (("callers", "CALLS", "in", 12), ("calls", "CALLS", "out", 12), ("methods", "HAS_METHOD", "out", 30)):
        found = named(kind, way)
        lines += [f"  {title}: {capped(found, most)}"] if found else []
    lines += ["  " + line for line in a["body"].split("\n")] if a.get("body") else []
    return "\n".join(lines)


def header(graph: Graph, now: datetime.datetime | None = None) -> str:
    """Where the graph came from, how old it is, and its dialect."""
    now = now or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    kind = graph.source.split(":", 1)[0]
    name = {"postgres": "postgresql"}.get(kind, kind)
    if graph.extracted_at is None:
        return f"-- {name}"
    s = int((now - graph.extracted_at).total_seconds())
    age = "just now" if s < 60 else f"{s // 60}m ago" if s < 3600 else f"{s // 3600}h ago" if s < 86400 else f"{s // 86400}d ago"
    return f"-- {graph.source}, extracted {age} ({graph.extracted_at:%Y-%m-%d}); {name}"


def context_pack(graph: Graph, question: str, limit: int = 4, **search) -> str:
    """The tables (or schemas and endpoints) that a question is about, and how they join."""
    texts = text.node_texts(graph)
    kinds = ("endpoint", "schema") if graph.is_api() else ("table",)
    blocks, names = [], []
    for kind in kinds:
        _, hits = find.find(graph.nodes, texts, question, kind, limit if limit > 0 else 4, **search)
        for r in hits.collect():
            blocks.append(render(graph, r.id))
            names += [r.name] if kind != "endpoint" else []
    conditions = [r.cond for r in joins.join_conditions(graph, list(combinations(names, 2))).collect()] if len(names) > 1 else []
    return "\n\n".join([header(graph), *blocks] + (["joins:\n" + "\n".join(f"  {c}" for c in conditions)] if conditions else []))


def code_context_pack(graph: Graph, question: str, limit: int = 6, budget: int = 16 << 10, **search) -> str:
    """Definitions, functions and files that a question is about, until the budget of text is used up."""
    limit = limit if limit > 0 else 6
    texts = text.node_texts(graph)
    out, size = [], 0
    for kind, most in (("definition", limit // 2 + 1), ("function", limit), ("file", limit // 2)):
        _, hits = find.find(graph.nodes, texts, question, kind, most, **search)
        for r in hits.join(graph.nodes.select("id", "attrs"), "id").orderBy(F.desc("score"), "id").collect():
            a = r.attrs or {}
            if a.get("generated") or a.get("external") or size > budget or len(out) >= 2 * limit:
                continue
            block = f"{r.name}: {(a.get('doc_body') or '')[:200]}" if kind == "file" else render(graph, r.id)
            out.append(block)
            size += len(block.encode())
    return "\n\n".join(out)


def overview(graph: Graph) -> str:
    lines = [header(graph), report.status_line(graph.nodes)]
    for r in report.overview_tables(graph).orderBy("name").collect():
        lines.append(f"  {r.name} ({r.columns} cols{f', {r.row_count} rows' if r.row_count else ''})" + (f" → {r.refs}" if r.refs else ""))
    return "\n".join(lines)


def diff_text(nodes, edges) -> str:
    """Node and edge differences as lines, in order."""
    mark = {"added": "+", "removed": "-", "changed": "~"}
    lines = [f"{mark[r.change]} {r.id}" + (f" ({'; '.join(r.notes)})" if r.notes else "") for r in nodes.orderBy("change", "id").collect()]
    return "\n".join(lines + [f"{r.type}: +{r.added} -{r.removed} edges" for r in edges.orderBy("type").collect()])
