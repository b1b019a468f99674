"""PostgreSQL catalogues, from dumps of the system tables or over JDBC.

Each input is a DataFrame with the columns of its system query; everything that
follows is joins and aggregates, so catalogues of any size work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.model import Graph

#: Columns of the inputs: dumps are JSON lines of these.
INPUTS = {
    "enums": "type_oid long, sort_order double, label string",
    "relations": "oid long, schema string, name string, kind string, comment string, estimate double, definition string",
    "columns": "rel_oid long, position int, name string, data_type string, type_oid long, not_null boolean, default_value string, comment string",
    "constraints": "rel_oid long, kind string, target_oid long, key array<int>, target_key array<int>, name string",
    "indexes": "rel_oid long, schema string, name string, is_unique boolean, key array<int>",
    "view_deps": "view_oid long, target_oid long",
}
#: Relation kinds of tables (plain, partitioned) and views (plain, materialised).
TABLE_KINDS, VIEW_KINDS = ("r", "p"), ("v", "m")


def read_dump(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(ddl).json(f"{folder}/{name}.json") for name, ddl in INPUTS.items()}


def extract(spark: SparkSession, source: str, database: str | None = None) -> Graph:
    """A graph from a folder of catalogue dumps."""
    return from_catalog(spark, read_dump(spark, source), database or source.rstrip("/").rsplit("/", 1)[-1])


def some(**attrs: Column) -> Column:
    """A map of the attributes that aren't null."""
    full = F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(full, lambda _, v: v.isNotNull())


def flag(c: Column) -> Column:
    return F.when(c, "true")


def numbered(edges: DataFrame) -> DataFrame:
    """Edges with an ord of their own: each source's edges one after another, by key and target."""
    rows = edges if "key" in edges.columns else edges.withColumn("key", F.lit(None).cast("string"))
    w = Window.partitionBy("src", "type").orderBy("key", "dst")
    base = F.shiftleft(F.shiftrightunsigned(F.xxhash64("src", "type"), 24), 20)
    return rows.withColumn("ord", base + F.row_number().over(w)).drop("key")


def from_catalog(spark: SparkSession, inputs: dict[str, DataFrame], database: str) -> Graph:
    none = F.create_map().cast("map<string,string>")
    base = f"database:{database}"
    rel = inputs["relations"].where(F.col("kind").isin(*TABLE_KINDS, *VIEW_KINDS))
    view = F.col("kind").isin(*VIEW_KINDS)
    shown = F.when(F.col("schema") == "public", F.col("name")).otherwise(F.concat_ws(".", "schema", "name"))
    rel = rel.withColumns({"shown": shown, "full": F.concat_ws(".", "schema", "name")}).withColumn("id", F.concat(F.when(view, "view:").otherwise("table:"), "full"))
    heads = rel.select("id", F.when(view, "view").otherwise("table").alias("type"), F.col("shown").alias("name"), some(comment=F.col("comment"), schema=F.col("schema"), row_count_estimate=F.when(F.col("estimate") >= 0, F.col("estimate").cast("long")), partitioned=flag(F.col("kind") == "p"), materialized=flag(F.col("kind") == "m"), sql=F.col("definition")).alias("attrs"))
    names = rel.select(F.col("oid").alias("rel_oid"), "full", "shown", F.col("id").alias("rel_id"))

    labels = inputs["enums"].groupBy("type_oid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "label"))), lambda x: x["label"]), ", ").alias("enum_values"))
    keys = inputs["constraints"]
    members = keys.where("kind IN ('p', 'u')").select("rel_oid", "kind", F.explode("key").alias("position")).groupBy("rel_oid", "position").agg(F.max(F.col("kind") == "p").alias("pk"), F.max(F.col("kind") == "u").alias("uq"))
    cols = inputs["columns"].where("position > 0").join(names, "rel_oid").join(labels, "type_oid", "left").join(members, ["rel_oid", "position"], "left")
    cols = cols.withColumn("id", F.concat(F.lit("column:"), "full", F.lit("."), "name"))
    columns = cols.select("id", F.lit("column").alias("type"), F.concat("shown", F.lit("."), "name").alias("name"), some(data_type=F.col("data_type"), not_null=flag(F.col("not_null")), default=F.col("default_value"), comment=F.col("comment"), enum_values=F.col("enum_values"), primary_key=flag(F.col("pk")), unique=flag(F.col("uq"))).alias("attrs"))
    place = cols.select("rel_oid", "position", F.col("id").alias("column_id"), F.col("name").alias("column"))

    # Parallel keys between the same tables are told apart by their constraints' names.
    pairs = keys.where("kind = 'f'").select("rel_oid", "target_oid", "name", F.posexplode(F.arrays_zip("key", "target_key")).alias("n", "k")).select("rel_oid", "target_oid", "name", "n", F.col("k.key").alias("position"), F.col("k.target_key").alias("to_position"))
    there = place.select(F.col("rel_oid").alias("target_oid"), F.col("position").alias("to_position"), F.col("column_id").alias("to_id"), F.col("column").alias("to_column"))
    pairs = pairs.join(place, ["rel_oid", "position"]).join(there, ["target_oid", "to_position"])
    foreign = pairs.select(F.col("column_id").alias("src"), F.col("to_id").alias("dst"), F.lit("FOREIGN_KEY").alias("type"), none.alias("attrs"), F.col("name").alias("key"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c]), ",")
    target = names.select(F.col("rel_oid").alias("target_oid"), F.col("rel_id").alias("target_id"))
    refs = pairs.groupBy("rel_oid", "target_oid", "name").agg(listed("column").alias("f"), listed("to_column").alias("t")).join(names, "rel_oid").join(target, "target_oid")
    refs = refs.select(F.col("rel_id").alias("src"), F.col("target_id").alias("dst"), F.lit("REFERENCES").alias("type"), some(from_column=F.col("f"), to_column=F.col("t")).alias("attrs"), F.col("name").alias("key"))

    idx = inputs["indexes"].withColumn("id", F.concat(F.lit("index:"), "schema", F.lit("."), "name"))
    indexes = idx.select("id", F.lit("index").alias("type"), "name", some(unique=flag(F.col("is_unique")), schema=F.col("schema")).alias("attrs"))
    has_index = idx.join(names, "rel_oid").select(F.col("rel_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_INDEX").alias("type"), none.alias("attrs"))
    covers = idx.select("rel_oid", "id", F.explode("key").alias("position")).join(place, ["rel_oid", "position"]).select(F.col("id").alias("src"), F.col("column_id").alias("dst"), F.lit("INDEXES").alias("type"), none.alias("attrs"))

    deps = inputs["view_deps"].where("view_oid <> target_oid").distinct().join(names.select(F.col("rel_oid").alias("view_oid"), F.col("rel_id").alias("src")), "view_oid").join(target, "target_oid")
    uses = deps.select("src", F.col("target_id").alias("dst"), F.lit("REFERENCES").alias("type"), F.create_map(F.lit("via"), F.lit("view")).alias("attrs"))

    top = spark.createDataFrame([(base, "database", database, {})], heads.schema)
    has_table = heads.select(F.lit(base).alias("src"), F.col("id").alias("dst"), F.lit("HAS_TABLE").alias("type"), none.alias("attrs"))
    has_column = cols.select(F.col("rel_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_COLUMN").alias("type"), none.alias("attrs"), F.col("position").cast("long").alias("ord"))
    edges = has_column
    for part in (has_table, foreign, refs, has_index, covers, uses):
        edges = edges.unionByName(numbered(part))
    return Graph(top.unionByName(heads).unionByName(columns).unionByName(indexes), edges, f"postgres:{database}")
