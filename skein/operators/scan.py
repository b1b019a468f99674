"""Scans over text tables: lines, grep, trees, and reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.shared import written

MAX_FILE = 2 << 20


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, text) of every line of (path, content); line counts from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def matches(text: Column, pattern: str, regex: bool) -> Column:
    return text.rlike("(?i)" + pattern) if regex else F.lower(text).contains(pattern.lower())


def grep(files: DataFrame, pattern: str, regex: bool = False, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first hits by path and line, and the exact total (one row, total).

    Files with NUL in their first 512 characters and those above 2 MiB are skipped.
    """
    text = files.where((F.octet_length("content") <= MAX_FILE) & ~F.substring("content", 1, 512).contains("\x00"))
    # A file without a hit is not split.
    hits = lines_of(text.where(matches(F.col("content"), pattern, False)) if not regex else text).where(matches(F.col("text"), pattern, regex))
    return hits.orderBy("path", "line").limit(limit), hits.agg(F.count("*").alias("total"))


def tree(paths: DataFrame, prefix: str = "", depth: int = 0) -> DataFrame:
    """(entry): paths under a prefix; beyond the depth a folder appears once as `folder/...`."""
    under = paths.where(F.col("path").startswith(prefix)) if prefix else paths
    if depth <= 0:
        return under.select(F.col("path").alias("entry")).distinct()
    rest = F.substring("path", len(prefix) + 1, 1 << 20)
    parts = F.split(F.regexp_replace(rest, "^/", ""), "/")
    cut = F.concat(F.lit(prefix), F.when(rest.startswith("/"), "/").otherwise(""), F.array_join(F.slice(parts, 1, depth), "/"), F.lit("/..."))
    return under.select(F.when(F.size(parts) > depth, cut).otherwise(F.col("path")).alias("entry")).distinct()


def budget_cut(rows: DataFrame, size: str, order: list, budget: int, group: str | None = None) -> DataFrame:
    """The rows that are reached before the sizes of those in front of them exceed the budget.

    Without groups rows are sorted by ranges; each range's size tells which ranges the budget reaches.
    """
    if group:
        w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("used", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("used") <= budget)
    line = written(rows.orderBy(*order).withColumn("skein_range", F.spark_partition_id()), "line")
    before, used = {}, 0
    for r in line.groupBy("skein_range").agg(F.sum(size).alias("n")).orderBy("skein_range").collect():  # one row for each range
        if used > budget:
            break
        before[r.skein_range], used = used, used + (r.n or 0)
    if not before:
        return rows.withColumn("used", F.lit(0).cast("long")).limit(0)
    w = Window.partitionBy("skein_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])[F.col("skein_range")]
    reached = line.where(F.col("skein_range").isin(list(before)))
    return reached.withColumn("used", F.coalesce(F.sum(size).over(w), F.lit(0)) + base).where(F.col("used") <= budget).drop("skein_range")


def coverage_gap(texts: DataFrame, name: str, wired: DataFrame) -> DataFrame:
    """(mentioned, wired, gap): texts (id, text) that contain a name, and those of them that have a link (id)."""
    word = texts.where(F.col("text").contains(name)).select("id").distinct()
    counted = word.join(wired.select("id").distinct().withColumn("w", F.lit(1)), "id", "left")
    return counted.agg(F.count("*").alias("mentioned"), F.count("w").alias("wired")).withColumn("gap", F.col("mentioned") - F.col("wired"))


def file_summaries(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, summary): a file's own doc, else its title, else that of its earliest documented function."""
    first = functions.where("doc <> ''").groupBy("file").agg(F.min_by("doc", "line_start").alias("doc"))
    return files.join(first, files["path"] == first["file"], "left").select("path", F.coalesce("file_doc", "title", "doc").alias("summary"))
