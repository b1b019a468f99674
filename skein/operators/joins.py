"""Join paths between tables and schemas, and small relational helpers of the graph."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import Graph, merged
from skein.operators.paths import DRIVER_EDGES, cheapest_path, search

STEP = "step int, from_table string, to_table string, from_column string, to_column string"


def container_id(graph: Graph, name: str) -> str | None:
    """The table or schema that a name means, with or without the public schema."""
    kind = "schema:" if graph.is_api() else "table:"
    tried = [kind + name, kind + "public." + name]
    found = {r.id for r in graph.nodes.where(F.col("id").isin(tried)).select("id").collect()}
    return next((t for t in tried if t in found), None)


def reference_edges(graph: Graph, views: bool = False) -> DataFrame:
    """References that a join can use; those of views only if asked for."""
    edges = graph.edges.where("type = 'REFERENCES'")
    return edges if views else edges.where("coalesce(attrs['via'], '') <> 'view'")


def join_path(graph: Graph, start: str, goal: str, views: bool = False) -> DataFrame:
    """Steps of the cheapest join path; empty if there is none or a name is unknown.

    A reference that is followed backwards has its columns swapped. Of a
    composite key the columns stay joined by commas; see on_condition.
    """
    spark = graph.spark
    a, b = container_id(graph, start), container_id(graph, goal)
    edges = reference_edges(graph, views)
    steps = cheapest_path(edges, a, b) if a and b else []
    if not steps:
        return spark.createDataFrame([], STEP)
    used = {r.ord: r.attrs for r in edges.where(F.col("ord").isin([s[2] for s in steps])).select("ord", "attrs").collect()}
    names = {r.id: r.name for r in graph.nodes.where(F.col("id").isin([x for s in steps for x in s[:2]])).collect()}
    rows = [step_row(graph, i, s, used[s[2]] or {}, names) for i, s in enumerate(steps, 1)]
    return spark.createDataFrame(rows, STEP)


def step_row(graph: Graph, i: int, step: tuple, attrs: dict, names: dict) -> tuple:
    a, b, _, forward = step
    if graph.is_api():
        prop = attrs.get("from_property", "") + ("[]" if attrs.get("cardinality") == "array" else "")
        return i, names[a], names[b], prop, ""
    ends = attrs.get("from_column", ""), attrs.get("to_column", "")
    return i, names[a], names[b], *(ends if forward else ends[::-1])


def on_condition(a: str, columns: str, b: str, others: str) -> str:
    """a.x = b.y, for composite keys joined by AND."""
    pairs = zip(columns.split(","), others.split(","), strict=False)
    return " AND ".join(f"{a}.{x.strip()} = {b}.{y.strip()}" for x, y in pairs)


def hint(graph: Graph, steps: list) -> str:
    """A path as SQL joins, or as a chain of properties for an API."""
    if graph.is_api():
        return "".join([steps[0].from_table, *(f" → {s.to_table} ({s.from_column})" for s in steps)]) if steps else ""
    return " ".join(f"JOIN {s.to_table} ON {on_condition(s.from_table, s.from_column, s.to_table, s.to_column)}" for s in steps)


def join_conditions(graph: Graph, pairs: list[tuple[str, str]], most_steps: int = 3) -> DataFrame:
    """Distinct `l = r` conditions of the cheapest paths between pairs of tables, of a few steps each.

    The references are collected once for all pairs: a schema's, up to DRIVER_EDGES; beyond, each pair is searched by joins.
    """
    edges = reference_edges(graph)
    if edges.count() > DRIVER_EDGES:
        few = [join_path(graph, a, b).where(F.col("step") <= most_steps + 1).collect() for a, b in pairs]
        ends = (sorted((f"{s.from_table}.{s.from_column}", f"{s.to_table}.{s.to_column}")) for steps in few if len(steps) <= most_steps for s in steps)
        return graph.spark.createDataFrame([(c,) for c in sorted({" = ".join(e) for e in ends})], "cond string")
    refs = edges.orderBy("ord").collect()
    ways: dict[str, list] = defaultdict(list)
    for e in refs:
        ways[e.src].append((e.dst, e.ord, True))
        if e.src != e.dst:
            ways[e.dst].append((e.src, e.ord, False))
    attrs = {e.ord: e.attrs or {} for e in refs}
    names = {r.id: r.name for r in graph.nodes.where(F.col("id").isin(list(ways))).select("id", "name").collect()}
    found = set()
    for start, goal in pairs:
        a, b = container_id(graph, start), container_id(graph, goal)
        steps = search(ways, a, b) if a and b and a != b else []
        if len(steps) <= most_steps:
            for s in steps:
                _, x, y, cx, cy = step_row(graph, 0, s, attrs[s[2]], names)
                found.add(" = ".join(sorted((f"{x}.{cx}", f"{y}.{cy}"))))
    return graph.spark.createDataFrame([(c,) for c in sorted(found)], "cond string")


def annotated(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Nodes with attributes overridden by (id, attrs); unknown ids are ignored."""
    over = annotations.select("id", F.col("attrs").alias("over"))
    return nodes.join(over, "id", "left").withColumn("attrs", merged(F.col("attrs"), F.col("over"))).drop("over")


def value_domains(tables: dict[str, DataFrame], columns: dict[str, list[str]], most: int) -> DataFrame:
    """(col, enum_values): the sorted values of columns that have at most so many."""
    out = None
    for t, names in columns.items():
        # One pass over each table, whatever the number of its columns.
        pairs = F.explode(F.array(*[F.struct(F.lit(f"{t}.{c}").alias("col"), F.col(c).cast("string").alias("v")) for c in names])).alias("p")
        values = tables[t].select(pairs).select("p.col", "p.v").where("v IS NOT NULL").distinct()
        out = values if out is None else out.unionByName(values)
    few = out.groupBy("col").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return out.join(F.broadcast(few), "col").groupBy("col").agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("enum_values"))
