"""Incremental refresh of a codebase graph.

The facts of files are kept as a table of their own. A refresh parses only
files whose modification time changed, replaces their facts, and links all facts
again, so no link can go stale. A stream of files does the same for each batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph
from skein.operators.diff import file_drift
from skein.shared import written
from skein.sources import codebase

#: A refresh is refused when so many files are recorded and less than this share is still there: a wrong root.
GUARD_FILES, GUARD_SHARE = 20, 0.5


def has_drift(recorded: DataFrame, found: DataFrame) -> bool:
    """Whether any file was added, deleted or changed; (path, mtime) on both sides."""
    return file_drift(recorded, found).limit(1).count() > 0


class WrongRoot(ValueError):
    """Most recorded files are missing: the tree is probably another one."""


def refreshed_facts(spark: SparkSession, root: str, facts: DataFrame, recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, changes) after parsing what changed; changes is (path, change)."""
    files = codebase.walk(spark, root)
    changes = written(file_drift(recorded, files.select("path", "mtime")), "changes")
    known = recorded.count()
    gone = changes.where("change = 'deleted'").count()
    if known >= GUARD_FILES and known - gone < GUARD_SHARE * known:
        raise WrongRoot(f"{gone} of {known} recorded files are missing")
    dirty = changes.where("change <> 'deleted'").select("path")
    fresh = codebase.facts(files.join(dirty, "path", "left_semi"))
    kept = facts.join(changes.select("path"), "path", "left_anti")
    return written(kept.unionByName(fresh), "facts"), changes


def refresh(spark: SparkSession, root: str, facts: DataFrame, recorded: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, facts, changes) of a tree after a refresh."""
    found, changes = refreshed_facts(spark, root, facts, recorded)
    return codebase.link_facts(found, codebase.walk(spark, root), f"codebase:{root}"), found, changes


def watch(spark: SparkSession, root: str, facts_path: str, checkpoint: str):
    """A streaming query that keeps a facts table up to date with new and rewritten files.

    Each batch appends facts under its number; current_facts reads the latest of
    every path. A batch that is tried again overwrites itself.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)

    def store(batch: DataFrame, number: int) -> None:
        base = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
        files = batch.select(F.regexp_extract("path", ".*?" + "\\Q" + base + "\\E" + "(.*)$", 1).alias("path"), "content").where("path <> ''")
        codebase.facts(files).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{facts_path}/batch={number}-{uuid.uuid5(uuid.NAMESPACE_URL, facts_path)}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_facts(spark: SparkSession, facts_path: str) -> DataFrame:
    """The facts of the last batch in which each path was seen."""
    rows = spark.read.schema(codebase.FACTS + ", batch int").option("recursiveFileLookup", "true").parquet(facts_path)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi").drop("batch")
