"""Differences between graphs, snapshots and code; drift of files and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.model import attrs_key
from skein.shared import written

#: Longest attribute value that a change shows.
SHOWN = 32


def attr_changes(old: Column, new: Column) -> Column:
    """Sorted notes on changed keys: -k, +k, `k changed` for sql and long values, else `k: old → new`."""
    notes = F.map_zip_with(
        old,
        new,
        lambda k, a, b: F.when(b.isNull(), F.concat(F.lit("-"), k))
        .when(a.isNull(), F.concat(F.lit("+"), k))
        .when(a != b, F.when((k == "sql") | (F.octet_length(a) > SHOWN) | (F.octet_length(b) > SHOWN), F.concat(k, F.lit(" changed"))).otherwise(F.concat(k, F.lit(": "), a, F.lit(" → "), b))),
    )
    return F.array_sort(F.filter(F.map_values(notes), lambda x: x.isNotNull()))


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change, notes): added, removed, or changed attributes; names and types don't count."""
    a, b = old.select("id", F.col("attrs").alias("a")), new.select("id", F.col("attrs").alias("b"))
    rows = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "id", "full")
    empty = F.create_map().cast("map<string,string>")
    notes = attr_changes(F.coalesce("a", empty), F.coalesce("b", empty))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.size(notes) > 0, "changed")
    return rows.select("id", change.alias("change"), F.when(change == "changed", notes).alias("notes")).where("change IS NOT NULL")


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(type, added, removed): multiset differences of edges, keyed by ends, type and attributes."""
    keyed = lambda df, name: df.groupBy("type", "src", "dst", attrs_key(F.col("attrs")).alias("k")).agg(F.count("*").alias(name))
    both = keyed(old, "n").join(keyed(new, "m"), ["type", "src", "dst", "k"], "full").select("type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    sums = both.groupBy("type").agg(F.sum(F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("removed"))
    return sums.where("added > 0 OR removed > 0")


def diff_code(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, type, old_id, new_id) for entities (id, type, file, name, signature, doc) of touched files.

    Same file, type and name: changed if signature or doc differ. Of the rest, in
    one file and type: equal signatures but for the name are renamed, paired in
    order. Then signatures that are unique on both sides are moved. What is left
    was removed or added.
    """
    a = old.withColumn("sig", F.coalesce("signature", F.lit(""))).withColumn("doc", F.coalesce("doc", F.lit("")))
    b = new.withColumn("sig", F.coalesce("signature", F.lit(""))).withColumn("doc", F.coalesce("doc", F.lit("")))
    numbered = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("file", "type", "name").orderBy("id")))
    a, b = numbered(a), numbered(b)
    left = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    x, y = left(a, "a_"), left(b, "b_")
    same = x.join(y, (F.col("a_file") == F.col("b_file")) & (F.col("a_type") == F.col("b_type")) & (F.col("a_name") == F.col("b_name")) & (F.col("a_k") == F.col("b_k")))
    changed = same.where("a_sig <> b_sig OR a_doc <> b_doc").select(F.lit("changed").alias("kind"), F.col("a_type").alias("type"), F.col("a_id").alias("old_id"), F.col("b_id").alias("new_id"))
    a1, b1 = a.join(same.select(F.col("a_id").alias("id")), "id", "left_anti"), b.join(same.select(F.col("b_id").alias("id")), "id", "left_anti")
    mask = F.expr("CASE WHEN locate(name, sig) > 0 THEN concat(substr(sig, 1, locate(name, sig) - 1), '\\0', substr(sig, locate(name, sig) + length(name))) ELSE sig END")
    slot = Window.partitionBy("file", "type", "mask").orderBy("id")
    ranked = lambda df: df.where("sig <> ''").withColumn("mask", mask).withColumn("slot", F.row_number().over(slot))
    r = left(ranked(a1), "a_").join(left(ranked(b1), "b_"), F.expr("a_file = b_file AND a_type = b_type AND a_mask = b_mask AND a_slot = b_slot"))
    renamed = r.select(F.lit("renamed").alias("kind"), F.col("a_type").alias("type"), F.col("a_id").alias("old_id"), F.col("b_id").alias("new_id"))
    a2, b2 = a1.join(renamed.select(F.col("old_id").alias("id")), "id", "left_anti"), b1.join(renamed.select(F.col("new_id").alias("id")), "id", "left_anti")
    # What is left is read four times, so it is written once.
    a2, b2 = written(a2.select("id", "type", "sig"), "left"), written(b2.select("id", "type", "sig"), "left")
    unique = lambda df, p: df.where("sig <> ''").groupBy("type", "sig").agg(F.count("*").alias(p + "n"), F.min("id").alias(p + "id")).where(f"{p}n = 1")
    moved = unique(a2, "a_").join(unique(b2, "b_"), ["type", "sig"]).select(F.lit("moved").alias("kind"), "type", F.col("a_id").alias("old_id"), F.col("b_id").alias("new_id"))
    gone = a2.join(moved.select(F.col("old_id").alias("id")), "id", "left_anti").select(F.lit("removed").alias("kind"), "type", F.col("id").alias("old_id"), F.lit(None).cast("string").alias("new_id"))
    come = b2.join(moved.select(F.col("new_id").alias("id")), "id", "left_anti").select(F.lit("added").alias("kind"), "type", F.lit(None).cast("string").alias("old_id"), F.col("id").alias("new_id"))
    return changed.unionByName(renamed).unionByName(moved).unionByName(gone).unionByName(come)


def file_drift(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change): added, deleted or changed, comparing mtimes of (path, mtime)."""
    rows = recorded.select("path", F.col("mtime").alias("a")).join(found.select("path", F.col("mtime").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return rows.select("path", change.alias("change")).where("change IS NOT NULL")


def orphan_annotations(annotations: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Annotated ids that the old graph had and the new one lacks."""
    return annotations.select("id").distinct().join(old_nodes.select("id"), "id", "left_semi").join(new_nodes.select("id"), "id", "left_anti")


def doc_drift(mentions: DataFrame, targets: DataFrame, changed: DataFrame, limit: int = 15) -> DataFrame:
    """(doc, broken, stale) of documents whose tokens no longer resolve, or whose targets changed after them.

    mentions (doc, token); targets (token, target); changed (id, at): last change of documents and targets.
    """
    asked = mentions.distinct()
    met = asked.join(targets, "token", "left")
    at = changed.select("id", "at")
    rows = met.join(at.select(F.col("id").alias("doc"), F.col("at").alias("doc_at")), "doc", "left").join(at.select(F.col("id").alias("target"), F.col("at").alias("target_at")), "target", "left")
    counts = rows.groupBy("doc").agg(F.sum(F.col("target").isNull().cast("long")).alias("broken"), F.sum(F.coalesce((F.col("target_at") > F.col("doc_at")), F.lit(False)).cast("long")).alias("stale"))
    return counts.where("broken + stale > 0").orderBy(F.desc(F.col("broken") + F.col("stale")), "doc").limit(limit)
