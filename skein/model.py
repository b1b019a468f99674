"""The property graph: two DataFrames, and the rules for changing, saving and reading them."""

from __future__ import annotations

import dataclasses
import datetime
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "id string, type string, name string, attrs map<string,string>"
EDGES = "src string, dst string, type string, attrs map<string,string>, ord bigint"
#: Id prefixes that describe() tries, in this order.
ID_PREFIXES = ("table:", "column:", "view:", "index:", "schema:", "property:", "endpoint:", "api:")
#: Prefixes that a short id drops, in this order.
SHORT_PREFIXES = ("table:", "view:", "column:", "index:", "schema:", "property:", "endpoint:", "api:", "public.")


def merged(base: Column, over: Column) -> Column:
    """Two attribute maps as one; over wins where both have a key. Null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def attrs_key(attrs: Column) -> Column:
    """A map as a canonical string, for grouping and comparing."""
    entries = F.array_sort(F.map_entries(F.coalesce(attrs, F.create_map().cast("map<string,string>"))))
    return F.to_json(entries)


@dataclasses.dataclass
class Graph:
    """Nodes (unique by id) and edges (a multiset in the order of ord), with where they came from."""

    nodes: DataFrame
    edges: DataFrame
    source: str = ""
    extracted_at: datetime.datetime | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @classmethod
    def of(cls, spark: SparkSession, nodes: Iterable[tuple], edges: Iterable[tuple], source: str = "", extracted_at: datetime.datetime | None = None) -> Graph:
        """From rows (id, type, name, attrs) and (src, dst, type, attrs), as a driver-side source lists them.

        Of nodes with one id the last is kept; edges keep their order.
        """
        unique = {n[0]: (*n[:3], n[3] or {}) for n in nodes}
        rows = [(s, d, t, a or {}, i) for i, (s, d, t, a) in enumerate(edges)]
        return cls(spark.createDataFrame(list(unique.values()), NODES), spark.createDataFrame(rows, EDGES), source, extracted_at)

    # -- reading ---------------------------------------------------------------

    def nodes_by_type(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("type") == kind).orderBy("name", "id")

    def edges_of(self, node: str) -> DataFrame:
        """Edges at a node in either direction; a self-loop appears once."""
        return self.edges.where((F.col("src") == node) | (F.col("dst") == node))

    def undirected(self, *kinds: str) -> DataFrame:
        """(a, b, ..., forward): every edge from both ends, a self-loop once."""
        return undirected(self.edges.where(F.col("type").isin(*kinds)) if kinds else self.edges)

    def is_api(self) -> bool:
        return self.source.startswith("openapi:")

    # -- changing --------------------------------------------------------------

    def add_nodes(self, more: DataFrame) -> Graph:
        """Add nodes; one whose id exists replaces the old one."""
        kept = self.nodes.join(more.select("id").distinct(), "id", "left_anti")
        return dataclasses.replace(self, nodes=kept.unionByName(last_by_id(more)))

    def add_edges(self, more: DataFrame) -> Graph:
        """Append edges; neither endpoints nor repetition are checked."""
        top = self.edges.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        return dataclasses.replace(self, edges=self.edges.unionByName(more.withColumn("ord", F.col("ord") + top)))

    def remove_nodes_where(self, condition: Column) -> Graph:
        """Remove nodes and every edge that touches one of them."""
        gone = self.nodes.where(condition).select(F.col("id").alias("gone"))
        kept = self.nodes.where(~F.coalesce(condition, F.lit(False)))
        edges = self.edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
        return dataclasses.replace(self, nodes=kept, edges=edges)

    def apply_delta(self, removed_ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> Graph:
        """Remove ids (one column, id) with their edges, then upsert nodes and append edges."""
        gone = removed_ids.select(F.col("id").alias("gone")).distinct()
        left = self.nodes.join(gone, F.col("id") == F.col("gone"), "left_anti")
        kept = self.edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
        return dataclasses.replace(self, nodes=left, edges=kept).add_nodes(nodes).add_edges(edges)

    def annotated(self, annotations: DataFrame) -> Graph:
        """Override attributes by (id, attrs); ids that don't exist are ignored."""
        over = annotations.select("id", F.col("attrs").alias("over"))
        return dataclasses.replace(self, nodes=self.nodes.join(over, "id", "left").select("id", "type", "name", merged(F.col("attrs"), F.col("over")).alias("attrs")))

    def deduplicated(self) -> Graph:
        """Keep the first edge of each (src, dst, type)."""
        return dataclasses.replace(self, edges=dedupe_edges(self.edges))

    # -- storing ---------------------------------------------------------------

    def save(self, path: str) -> str:
        """Write a new version under path and point to it last, so readers see a whole graph."""
        version = f"{path}/v-{uuid.uuid4().hex}"
        self.nodes.write.partitionBy("type").parquet(f"{version}/nodes")
        self.edges.write.partitionBy("type").parquet(f"{version}/edges")
        self.spark.createDataFrame([(self.source, self.extracted_at, version)], "source string, extracted_at timestamp, version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, annotations: DataFrame | None = None) -> Graph:
        meta = spark.read.parquet(f"{path}/meta").first()
        nodes = spark.read.parquet(f"{meta.version}/nodes").select("id", "type", "name", "attrs")
        edges = spark.read.parquet(f"{meta.version}/edges").select("src", "dst", "type", "attrs", "ord")
        graph = cls(nodes, edges, meta.source, meta.extracted_at)
        return graph if annotations is None else graph.annotated(annotations)

    def save_json(self, path: str) -> None:
        """The one-file exchange format: {source, extracted_at, nodes: {id: node}, edges: []}. For graphs that fit the driver."""
        at = self.extracted_at.isoformat() + "Z" if self.extracted_at else "0001-01-01T00:00:00Z"
        nodes = {r.id: {"id": r.id, "type": r.type, "name": r.name, "attrs": r.attrs} for r in self.nodes.orderBy("id").toLocalIterator()}
        edges = [{"from": r.src, "to": r.dst, "type": r.type} | ({"attrs": r.attrs} if r.attrs else {}) for r in self.edges.orderBy("ord").toLocalIterator()]
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"source": self.source, "extracted_at": at, "nodes": nodes, "edges": edges}, f, indent=2)

    @classmethod
    def load_json(cls, spark: SparkSession, path: str) -> Graph:
        attrs = "map<string,string>"
        schema = f"source string, extracted_at string, nodes map<string,struct<id:string,type:string,name:string,attrs:{attrs}>>, edges array<struct<`from`:string,`to`:string,type:string,attrs:{attrs}>>"
        doc = spark.read.schema(schema).json(path, multiLine=True)
        empty = F.create_map().cast(attrs)
        nodes = doc.select(F.explode("nodes").alias("key", "n")).select("n.id", "n.type", "n.name", F.coalesce("n.attrs", empty).alias("attrs"))
        edges = doc.select(F.posexplode("edges").alias("ord", "e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.type", F.coalesce("e.attrs", empty).alias("attrs"), F.col("ord").cast("long"))
        head = doc.select("source", F.to_timestamp("extracted_at").alias("at")).first()
        return cls(nodes, edges, head.source or "", head["at"])


def undirected(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *rest, F.lit(True).alias("forward"))
    back = edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), *rest, F.lit(False).alias("forward"))
    return there.unionByName(back)


def last_by_id(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """The last node of each id by an order column, else an arbitrary one."""
    row = F.struct("type", "name", "attrs")
    best = F.max_by(row, F.col(order)) if order else F.any_value(row)
    return nodes.groupBy("id").agg(best.alias("n")).select("id", "n.type", "n.name", "n.attrs")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """First edge by ord of each (src, dst, type)."""
    w = Window.partitionBy("src", "dst", "type").orderBy("ord")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dialect(source: Column) -> Column:
    """The kind in front of a source's colon; both spellings of postgres are postgresql."""
    kind = F.substring_index(source, ":", 1)
    return F.when(kind == "postgres", "postgresql").otherwise(kind)


def age(at: Column, now: Column) -> Column:
    """Just now, or whole minutes, hours or days ago; null if unknown."""
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))
    whole = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, "just now").when(seconds < 3600, whole(60, "m ago")).when(seconds < 86400, whole(3600, "h ago")).otherwise(F.when(seconds.isNotNull(), whole(86400, "d ago")))


def freshness(source: Column, at: Column, now: Column) -> Column:
    """Where a graph came from and how old it is; empty if its time is unknown."""
    text = F.concat(source, F.lit(", extracted "), age(at, now), F.lit(" ("), F.date_format(at, "yyyy-MM-dd"), F.lit(")"))
    return F.coalesce(text, F.lit(""))


def short_id(node: Column) -> Column:
    """An id without its type prefix and the public schema."""
    for prefix in SHORT_PREFIXES:
        node = F.when(node.startswith(prefix), F.substring(node, len(prefix) + 1, 1 << 20)).otherwise(node)
    return node
