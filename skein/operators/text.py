"""The canonical text of a node, made of its attributes and its neighbours' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.model import Graph

#: Relationship lists of a node's text, in this order: title, edge type, whether the node is the edge's source.
SECTIONS = [
    ("Columns", "HAS_COLUMN", True), ("Properties", "HAS_PROPERTY", True), ("Methods", "HAS_METHOD", True), ("Called by", "CALLS", False),
    ("Calls backend routes", "CALLS_ENDPOINT", True), ("Touches models", "USES_MODEL", True), ("Used by routes", "USES_MODEL", False), ("Handled by", "HANDLED_BY", True),
    ("Middleware", "USES_MIDDLEWARE", True), ("Writes", "WRITES", True), ("Reads", "READS", True), ("Written by", "WRITES", False), ("Read by", "READS", False),
    ("Accepts", "ACCEPTS", True), ("Returns", "RESPONDS_WITH", True), ("References", "REFERENCES", True), ("Referenced by", "REFERENCES", False), ("Used by", "REFERS_TO", False),
]


def _part(attrs: Column, key: str, before: str = " ", after: str = "", most: int | None = None) -> Column:
    value = attrs[key] if most is None else F.substring(attrs[key], 1, most)
    return F.when(F.coalesce(attrs[key], F.lit("")) != "", F.concat(F.lit(before), value, F.lit(after))).otherwise("")


def own_text(kind: Column, name: Column, attrs: Column) -> Column:
    """What a node says of itself, in fixed order."""
    route = F.when((kind == "route") & attrs["path"].isNotNull(), F.concat(F.lit(" "), F.when(F.coalesce(attrs["method"], F.lit("")) == "", "ANY").otherwise(attrs["method"]), F.lit(" "), attrs["path"], F.lit("."))).otherwise("")
    return F.concat(
        kind, F.lit(" "), name, F.lit("."),
        _part(attrs, "comment", after="."), _part(attrs, "entity_note", after="."), _part(attrs, "enum_values", " Allowed values: ", "."), _part(attrs, "data_type", " Type ", "."),
        _part(attrs, "signature", " Signature: ", "."), _part(attrs, "file", " In file ", "."), _part(attrs, "doc"), _part(attrs, "doc_body", most=300), route,
        F.when(kind == "comment", _part(attrs, "text")).otherwise(""),
        F.when(kind == "model", F.concat(_part(attrs, "table", " table ", "."), _part(attrs, "fields", " Fields: ", "."))).otherwise(""),
    )


def node_texts(graph: Graph) -> DataFrame:
    """(id, type, name, text) of every node; neighbours in the order of their edges.

    One shuffle of the listed edges by node, and one join with the nodes.
    """
    names = graph.nodes.select("id", F.col("name").alias("other"))
    sides = []
    for position, (title, kind, out) in enumerate(SECTIONS):
        own, far = ("src", "dst") if out else ("dst", "src")
        rows = graph.edges.where(F.col("type") == kind)
        rows = rows if out or kind != "REFERENCES" else rows.where("src <> dst")
        sides.append(rows.select(F.col(own).alias("node"), F.col(far).alias("id"), "ord", F.lit(position).alias("position"), F.lit(title).alias("title")))
    listed = sides[0]
    for more in sides[1:]:
        listed = listed.unionByName(more)
    listed = listed.join(names, "id").groupBy("node", "position", "title").agg(F.array_sort(F.collect_list(F.struct("ord", "other"))).alias("others"))
    lists = listed.select("node", F.struct("position", F.concat(F.lit(" "), "title", F.lit(": "), F.array_join(F.transform("others", lambda x: x["other"]), ", "), F.lit(".")).alias("text")).alias("part"))
    lists = lists.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "").alias("lists"))
    rows = graph.nodes.join(lists, F.col("id") == F.col("node"), "left")
    return rows.select("id", "type", "name", F.concat(own_text(F.col("type"), F.col("name"), F.col("attrs")), F.coalesce("lists", F.lit(""))).alias("text"))
