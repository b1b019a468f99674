"""A catalogue of Parquet tables as a graph: tables, columns and declared foreign keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph

#: Tables of the test data and their declared keys (table, column, target table, target column).
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"),
]


def extract(spark: SparkSession, source: str, tables: tuple[str, ...] = TABLES, keys: list[tuple[str, str, str, str]] = KEYS, counts: bool = True) -> Graph:
    """Schemas and row counts come from the files' footers, all counts in one job; what is built on the driver is the size of the schema."""
    name = source.rstrip("/").rsplit("/", 1)[-1]
    nodes, edges = [(f"database:{name}", "database", name, {})], []
    frames = {t: spark.read.parquet(f"{source}/{t}.parquet") for t in tables}
    counted = reduce(DataFrame.unionByName, [df.agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t, df in frames.items()]) if counts and frames else None
    rows = {r.t: r.n for r in counted.collect()} if counted is not None else {}
    for t, df in frames.items():
        nodes.append((f"table:{t}", "table", t, {"row_count": str(rows[t])} if t in rows else {}))
        edges.append((f"database:{name}", f"table:{t}", "HAS_TABLE", {}))
        for column, kind in df.dtypes:
            nodes.append((f"column:{t}.{column}", "column", f"{t}.{column}", {"data_type": kind}))
            edges.append((f"table:{t}", f"column:{t}.{column}", "HAS_COLUMN", {}))
    for t, c, target, target_column in keys:
        edges.append((f"column:{t}.{c}", f"column:{target}.{target_column}", "FOREIGN_KEY", {}))
        edges.append((f"table:{t}", f"table:{target}", "REFERENCES", {"from_column": c, "to_column": target_column}))
    return Graph.of(spark, nodes, edges, f"catalog:{source}")
