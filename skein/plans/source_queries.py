"""Connectors on databases, documents, catalogues and source trees that are made of the test tables."""

from __future__ import annotations

import json
import sqlite3
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph
from skein.operators import report
from skein.plans.registry import query, table
from skein.shared import shared_dir
from skein.sources import codebase, openapi, postgres, sqlite


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a file in the shared folder, whatever store that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(text.encode())
    out.close()


def small_database(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions and nations as an SQLite file with keys, a CHECK, a view and an index. The driver writes and reads it."""
    path = place(spark, "sqlite").removeprefix("file://")
    put(spark, f"file://{path}/.made", "")
    regions, nations = (table(spark, sf_dir, t).collect() for t in ("region", "nation"))
    names = ", ".join(f"'{r.r_name}'" for r in sorted(regions, key=lambda r: r.r_regionkey))
    with sqlite3.connect(f"{path}/world.db") as db:
        db.execute(f"CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT NOT NULL CHECK (r_name IN ({names})))")
        db.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT UNIQUE, n_regionkey INTEGER REFERENCES region)")
        db.execute("CREATE VIEW named AS SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
        db.execute("CREATE INDEX of_region ON nation(n_regionkey)")
        db.executemany("INSERT INTO region VALUES (?, ?)", [(r.r_regionkey, r.r_name) for r in regions])
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", [(n.n_nationkey, n.n_name, n.n_regionkey) for n in nations])
    return sqlite.extract(spark, f"{path}/world.db")


@query("""SELECT 'region' AS name, count(*) AS row_count, 2::BIGINT AS columns, '' AS refs FROM region UNION ALL SELECT 'nation', count(*), 3, 'region' FROM nation""")
def sqlite_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overview_tables(small_database(spark, sf_dir))


@query("""SELECT 'region.r_name' AS name, string_agg(r_name, ', ' ORDER BY r_regionkey) AS enum_values FROM region""")
def sqlite_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_database(spark, sf_dir).nodes.select("name", F.col("attrs")["enum_values"].alias("enum_values")).where("enum_values IS NOT NULL")


@query("""SELECT * FROM (VALUES ('table:nation', 'table:region', 'REFERENCES', 'n_regionkey', 'r_regionkey'), ('column:nation.n_regionkey', 'column:region.r_regionkey', 'FOREIGN_KEY', '', ''),
('view:named', 'table:nation', 'REFERENCES', '', ''), ('view:named', 'table:region', 'REFERENCES', '', ''), ('table:nation', 'index:of_region', 'HAS_INDEX', '', ''), ('table:nation', 'index:sqlite_autoindex_nation_1', 'HAS_INDEX', '', ''),
('index:of_region', 'column:nation.n_regionkey', 'INDEXES', '', ''), ('index:sqlite_autoindex_nation_1', 'column:nation.n_name', 'INDEXES', '', '')) v(src, dst, type, from_column, to_column)""")
def sqlite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = small_database(spark, sf_dir).edges.where("type NOT IN ('HAS_TABLE', 'HAS_COLUMN')")
    column = lambda c: F.coalesce(F.col("attrs")[c], F.lit("")).alias(c)
    return found.select("src", "dst", "type", column("from_column"), column("to_column"))


def world_api(spark: SparkSession, sf_dir: str) -> Graph:
    """An OpenAPI document with a schema for each region and nation and an endpoint for each nation."""
    nations = table(spark, sf_dir, "nation").collect()
    ref = lambda name: {"$ref": f"#/components/schemas/{name}"}
    schemas = {f"world.Nation{n.n_nationkey}": {"required": ["id"], "properties": {"id": {"type": "integer"}, "region": ref(f"world.Region{n.n_regionkey}")}} for n in nations}
    for r in table(spark, sf_dir, "region").collect():
        own = {f"n{n.n_nationkey}": {"type": "array", "items": ref(f"world.Nation{n.n_nationkey}")} for n in nations if n.n_regionkey == r.r_regionkey}
        schemas[f"world.Region{r.r_regionkey}"] = {"properties": own | {"kind": ref("Kind")}}
    schemas["Kind"] = {"type": "string", "enum": ["a", "b"]}
    paths = {f"/nations/{n.n_nationkey}": {"get": {"security": [{"key": []}] if n.n_nationkey % 2 else [], "responses": {"200": {"content": {"application/json": {"schema": ref(f"world.Nation{n.n_nationkey}")}}}}}} for n in nations}
    spec = {"openapi": "3.0.0", "info": {"title": "World"}, "servers": [{"url": "https://world.example"}], "components": {"schemas": schemas, "securitySchemes": {"key": {"type": "http", "scheme": "bearer"}}}, "paths": paths}
    path = place(spark, "openapi") + "/world.json"
    put(spark, path, json.dumps(spec))
    return openapi.extract(spark, path)


@query("""SELECT 'schema:Nation' || n_nationkey AS src, 'schema:Region' || n_regionkey AS dst, 'REFERENCES' AS type, 'region' AS property, '' AS cardinality FROM nation
UNION ALL SELECT 'schema:Region' || n_regionkey, 'schema:Nation' || n_nationkey, 'REFERENCES', 'n' || n_nationkey, 'array' FROM nation
UNION ALL SELECT 'endpoint:GET /nations/' || n_nationkey, 'schema:Nation' || n_nationkey, 'RESPONDS_WITH', '', '' FROM nation""")
def openapi_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = world_api(spark, sf_dir).edges.where("type IN ('REFERENCES', 'RESPONDS_WITH', 'ACCEPTS')")
    some = lambda c, name: F.coalesce(F.col("attrs")[c], F.lit("")).alias(name)
    return found.select("src", "dst", "type", some("from_property", "property"), some("cardinality", "cardinality"))


@query("""SELECT 'endpoint:GET /nations/' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 1 THEN 'Bearer' ELSE '' END AS auth, '' AS data_type, '' AS enum_values FROM nation
UNION ALL SELECT 'property:Nation' || n_nationkey || '.id', '', 'integer', '' FROM nation UNION ALL SELECT 'property:Region' || r_regionkey || '.kind', '', 'Kind', 'a, b' FROM region
UNION ALL SELECT 'property:Region' || n_regionkey || '.n' || n_nationkey, '', 'array<Nation' || n_nationkey || '>', '' FROM nation UNION ALL SELECT 'property:Nation' || n_nationkey || '.region', '', 'Region' || n_regionkey, '' FROM nation""")
def openapi_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = world_api(spark, sf_dir).nodes.where("type IN ('endpoint', 'property')")
    return found.select("id", *[F.coalesce(F.col("attrs")[c], F.lit("")).alias(c) for c in ("auth", "data_type", "enum_values")])


def world_tree(spark: SparkSession, sf_dir: str) -> Graph:
    """A Python file for each region, with a function for each nation that calls the next one, and an import of the next region."""
    root = place(spark, "tree")
    nations = sorted((n.n_regionkey, n.n_nationkey) for n in table(spark, sf_dir, "nation").collect())
    regions = sorted(r.r_regionkey for r in table(spark, sf_dir, "region").collect())
    for r in regions:
        own = [k for region, k in nations if region == r]
        body = "".join(f"def n{k}():\n    return n{own[(i + 1) % len(own)]}()\n\n" for i, k in enumerate(own))
        put(spark, f"{root}/r{r}.py", f"import r{(r + 1) % len(regions)}\n{body}")
        put(spark, f"{root}/node_modules/skipped{r}.py", "def never():\n    pass\n")
        put(spark, f"{root}/docs/r{r}.md", f"# Region {r}\n" + "".join(f"Uses `n{k}()` of `r{r}.py`.\n" for k in own))
    return codebase.extract(spark, root)


WORLD = """WITH o AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation),
f AS (SELECT *, 'func:r' || r || '.py:n' || k || ':' || (3 * i - 1) AS id FROM o), n AS (SELECT count(*) AS n FROM region)"""


@query(f"""{WORLD} SELECT id AS src, 'file:r' || r || '.py' AS dst, 'BELONGS_TO' AS type FROM f UNION ALL SELECT a.id, b.id, 'CALLS' FROM f a JOIN f b ON a.r = b.r AND b.i = a.i % a.c + 1 WHERE a.c > 1
UNION ALL SELECT 'file:r' || r_regionkey || '.py', 'file:r' || (r_regionkey + 1) % n || '.py', 'IMPORTS' FROM region, n UNION ALL SELECT 'doc:docs/r' || r || '.md', id, 'MENTIONS' FROM f
UNION ALL SELECT 'doc:docs/r' || r_regionkey || '.md', 'file:r' || r_regionkey || '.py', 'MENTIONS' FROM region UNION ALL SELECT 'doc:docs/r' || r_regionkey || '.md', 'file:docs/r' || r_regionkey || '.md', 'BELONGS_TO' FROM region""")
def codebase_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world_tree(spark, sf_dir).edges.select("src", "dst", "type")


@query(f"""{WORLD} SELECT id, 'function' AS type, 'n' || k AS name, (3 * i - 1)::VARCHAR AS line FROM f UNION ALL SELECT 'file:r' || r_regionkey || '.py', 'file', 'r' || r_regionkey || '.py', '' FROM region
UNION ALL SELECT 'file:docs/r' || r_regionkey || '.md', 'file', 'docs/r' || r_regionkey || '.md', '' FROM region UNION ALL SELECT 'doc:docs/r' || r_regionkey || '.md', 'file', 'Region ' || r_regionkey || ' (doc)', '' FROM region""")
def codebase_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world_tree(spark, sf_dir).nodes.select("id", "type", "name", F.coalesce(F.col("attrs")["line_start"], F.lit("")).alias("line"))


def world_catalogue(spark: SparkSession, sf_dir: str) -> Graph:
    """A PostgreSQL catalogue with an enum of the regions' names and two foreign keys between the same tables."""
    rows = {
        "relations": [(1, "public", "region", "r", "all regions", 5.0, None), (2, "geo", "nation", "p", None, -1.0, None), (3, "public", "named", "m", None, 1.0, "SELECT 1")],
        "columns": [(1, 1, "key", "integer", 0, True, None, None), (1, 2, "name", "names", 77, False, None, None), (2, 1, "key", "integer", 0, True, "0", None), (2, 2, "region", "integer", 0, False, None, None), (2, 3, "former", "integer", 0, False, None, None)],
        "constraints": [(1, "p", 0, [1], [], "region_pk"), (2, "f", 1, [3], [1], "z_former"), (2, "f", 1, [2], [1], "a_region"), (1, "u", 0, [2], [], "region_name")],
        "indexes": [(2, "geo", "nation_region", False, [2]), (1, "public", "region_pk", True, [1])],
        "view_deps": [(3, 1), (3, 2), (3, 3)],
    }
    inputs = {n: spark.createDataFrame(rows.get(n, []), ddl) for n, ddl in postgres.INPUTS.items()}
    inputs["enums"] = table(spark, sf_dir, "region").select(F.lit(77).cast("long").alias("type_oid"), F.col("r_regionkey").cast("double").alias("sort_order"), F.col("r_name").alias("label"))
    return postgres.from_catalog(spark, inputs, "world")


@query("""WITH e AS (SELECT string_agg(r_name, ', ' ORDER BY r_regionkey) AS v FROM region) SELECT id, type, name, coalesce(enum_values, '') AS enum_values, pk, uq FROM (
SELECT 'database:world' AS id, 'database' AS type, 'world' AS name, NULL AS enum_values, '' AS pk, '' AS uq UNION ALL SELECT 'table:public.region', 'table', 'region', NULL, '', '' UNION ALL SELECT 'table:geo.nation', 'table', 'geo.nation', NULL, '', ''
UNION ALL SELECT 'view:public.named', 'view', 'named', NULL, '', '' UNION ALL SELECT 'column:public.region.key', 'column', 'region.key', NULL, 'true', '' UNION ALL SELECT 'column:public.region.name', 'column', 'region.name', v, '', 'true' FROM e
UNION ALL SELECT 'column:geo.nation.' || c, 'column', 'geo.nation.' || c, NULL, '', '' FROM (VALUES ('key'), ('region'), ('former')) x(c) UNION ALL SELECT 'index:geo.nation_region', 'index', 'nation_region', NULL, '', '' UNION ALL SELECT 'index:public.region_pk', 'index', 'region_pk', NULL, '', 'true')""")
def postgres_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda c, name: F.coalesce(F.col("attrs")[c], F.lit("")).alias(name)
    return world_catalogue(spark, sf_dir).nodes.select("id", "type", "name", some("enum_values", "enum_values"), some("primary_key", "pk"), some("unique", "uq"))


@query("""SELECT * FROM (VALUES ('table:geo.nation', 'table:public.region', 'REFERENCES', 'region', 1), ('table:geo.nation', 'table:public.region', 'REFERENCES', 'former', 2), ('view:public.named', 'table:public.region', 'REFERENCES', '', 2), ('view:public.named', 'table:geo.nation', 'REFERENCES', '', 1),
('column:geo.nation.region', 'column:public.region.key', 'FOREIGN_KEY', '', 1), ('column:geo.nation.former', 'column:public.region.key', 'FOREIGN_KEY', '', 1), ('table:geo.nation', 'index:geo.nation_region', 'HAS_INDEX', '', 1), ('table:public.region', 'index:public.region_pk', 'HAS_INDEX', '', 1),
('index:geo.nation_region', 'column:geo.nation.region', 'INDEXES', '', 1), ('index:public.region_pk', 'column:public.region.key', 'INDEXES', '', 1)) v(src, dst, type, from_column, place)""")
def postgres_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the place of each among its source's edges of that type."""
    found = world_catalogue(spark, sf_dir).edges.where("type NOT IN ('HAS_TABLE', 'HAS_COLUMN')")
    rank = F.expr("row_number() OVER (PARTITION BY src, type ORDER BY ord)")
    return found.select("src", "dst", "type", F.coalesce(F.col("attrs")["from_column"], F.lit("")).alias("from_column"), rank.alias("place"))


@query("""SELECT id, type, name, status, again FROM (SELECT 'order:' || o_orderkey AS id, 'order' AS type, o_orderpriority AS name, o_orderstatus AS status, 'true' AS again FROM orders WHERE o_totalprice > 300000)
UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, '', 'true' FROM customer""")
def saved_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that was saved, loaded and annotated."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000").selectExpr("concat('order:', o_orderkey) AS id", "'order' AS type", "o_orderpriority AS name", "map('status', o_orderstatus) AS attrs")
    customers = table(spark, sf_dir, "customer").selectExpr("concat('customer:', c_custkey) AS id", "'customer' AS type", "c_name AS name", "CAST(map() AS map<string,string>) AS attrs")
    edges = table(spark, sf_dir, "orders").where("o_totalprice > 300000").selectExpr("concat('order:', o_orderkey) AS src", "concat('customer:', o_custkey) AS dst", "'OF' AS type", "CAST(map() AS map<string,string>) AS attrs", "o_orderkey AS ord")
    path = place(spark, "graph")
    nodes = orders.unionByName(customers)
    Graph(nodes, edges, "catalog:orders").save(path)
    back = Graph.load(spark, path, nodes.selectExpr("id", "map('again', 'true') AS attrs"))
    some = lambda c: F.coalesce(F.col("attrs")[c], F.lit("")).alias(c)
    return back.nodes.select("id", "type", "name", some("status"), some("again"))
