"""Overviews and descriptions of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import join_capped
from skein.model import ID_PREFIXES, Graph


def overview_counts(nodes: DataFrame) -> DataFrame:
    """(type, n) of all nodes."""
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def overview_tables(graph: Graph) -> DataFrame:
    """(name, row_count, columns, refs): each table or schema with its members and what it references, in edge order."""
    kind, member = ("schema", "HAS_PROPERTY") if graph.is_api() else ("table", "HAS_COLUMN")
    heads = graph.nodes.where(F.col("type") == kind)
    members = graph.edges.where(F.col("type") == member).groupBy("src").agg(F.count("*").alias("columns"))
    names = graph.nodes.select(F.col("id").alias("dst"), F.col("name").alias("other"))
    refs = graph.edges.where("type = 'REFERENCES'").join(names, "dst").groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "other"))), lambda x: x["other"]), ", ").alias("refs"))
    rows = heads.join(members, heads["id"] == members["src"], "left").drop("src").join(refs, F.col("id") == F.col("src"), "left")
    count = F.coalesce(F.col("attrs")["row_count"], F.col("attrs")["row_count_estimate"]).try_cast("long")
    return rows.select("name", count.alias("row_count"), F.coalesce("columns", F.lit(0)).alias("columns"), F.coalesce("refs", F.lit("")).alias("refs"))


def resolve_id(graph: Graph, name: str) -> str | None:
    """The id that describe() means: the name itself, or with one of the known prefixes, each also with public."""
    tried = [name, *(p + q + name for p in ID_PREFIXES for q in ("", "public."))]
    found = {r.id for r in graph.nodes.where(F.col("id").isin(tried)).select("id").collect()}
    return next((t for t in tried if t in found), None)


def describe(graph: Graph, name: str) -> DataFrame:
    """(type, other, dir, attrs) of the edges at a node, in order; a self-loop is out."""
    node = resolve_id(graph, name)
    at = graph.edges_of(node or name)
    out = F.col("src") == (node or name)
    return at.select("type", F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other"), F.when(out, "out").otherwise("in").alias("dir"), "attrs", "ord").orderBy("ord")


def routes(graph: Graph, file: str = "") -> DataFrame:
    """(file, line, method, path, handler, middleware, models, callers) of routes, lists sorted and capped."""
    heads = graph.nodes.where("type = 'route'").where(F.coalesce(F.col("attrs")["file"], F.lit("")).contains(file))
    names = graph.nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other"), F.col("attrs")["file"].alias("other_file"))
    out = graph.edges.where("type IN ('HANDLED_BY', 'USES_MIDDLEWARE', 'USES_MODEL')").join(names, F.col("dst") == F.col("other_id")).groupBy("src").agg(
        F.max_by("other", F.when(F.col("type") == "HANDLED_BY", F.col("ord"))).alias("handler"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "USES_MIDDLEWARE", F.struct(F.coalesce(F.col("attrs")["order"].try_cast("int"), F.lit(0)).alias("order"), "ord", "other")))).alias("middleware"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "USES_MODEL", F.col("other")))).alias("models"),
    )
    calls = graph.edges.where("type = 'CALLS_ENDPOINT'").join(names, F.col("src") == F.col("other_id")).select(F.col("dst").alias("route"), F.concat("other", F.lit(" ("), F.coalesce("other_file", F.lit("")), F.lit(":"), F.coalesce(F.col("attrs")["line"], F.lit("")), F.lit(")")).alias("caller"))
    calls = calls.groupBy("route").agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    rows = heads.join(out, F.col("id") == F.col("src"), "left").join(calls, F.col("id") == F.col("route"), "left")
    a = F.col("attrs")
    empty = F.array().cast("array<string>")
    method = F.when(F.coalesce(a["method"], F.lit("")) == "", "ANY").otherwise(a["method"])
    return rows.select(a["file"].alias("file"), a["line_start"].try_cast("int").alias("line"), method.alias("method"), a["path"].alias("path"), "handler", F.array_join(F.transform("middleware", lambda x: x["other"]), ", ").alias("middleware"), join_capped(F.coalesce("models", empty), 10).alias("models"), join_capped(F.coalesce("callers", empty), 6).alias("callers")).orderBy("file", "line", "path")


def models(graph: Graph, file: str = "") -> DataFrame:
    """(file, name, table, field_count, renamed, associations) of data models."""
    heads = graph.nodes.where("type = 'model' OR attrs['model_table'] IS NOT NULL").where(F.coalesce(F.col("attrs")["file"], F.lit("")).contains(file))
    names = graph.nodes.select(F.col("id").alias("dst"), F.col("name").alias("other"))
    out = graph.edges.where("type = 'REFERENCES' AND attrs['kind'] IS NOT NULL").join(names, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.concat(F.col("attrs")["kind"], F.lit(" "), "other"))).alias("assocs"))
    a = F.col("attrs")
    empty = F.array().cast("array<string>")
    renamed = F.filter(F.split(F.coalesce(a["fields"], F.lit("")), ", "), lambda x: x.contains("→"))
    rows = heads.join(out, F.col("id") == F.col("src"), "left")
    return rows.select(a["file"].alias("file"), "name", F.coalesce(a["table"], a["model_table"]).alias("table"), a["field_count"].try_cast("int").alias("field_count"), join_capped(renamed, 12).alias("renamed"), join_capped(F.coalesce("assocs", empty), 10).alias("associations")).orderBy("file", "name")


def status_line(nodes: DataFrame) -> str:
    """Counts by type in order, as one line."""
    return ", ".join(f"{r.n} {r.type}" for r in overview_counts(nodes).orderBy("type").collect())
