"""Command line: extract a graph, and ask it.

python -m skein.cli extract KIND SOURCE GRAPH
python -m skein.cli check|update codebase SOURCE GRAPH
python -m skein.cli overview|find|describe|path|query|code-query|impact|blast|routes|models|annotate|diff GRAPH ...
python -m skein.cli grep|tree|code-diff|doc-drift|companions GRAPH ...    (of a source tree)
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.model import Graph
from skein.operators import code, diff, find, joins, link, paths, render, report, scan, text
from skein.sources import codebase, git, open_source
from skein.streaming import refresh


def notes_path(graph: str) -> str:
    return f"{graph}/annotations.json"


def annotate(graph: str, node: str, pairs: dict[str, str], clear: bool = False) -> dict:
    """Set attributes of a node in the overlay; an empty value removes a key, an empty node goes."""
    notes = json.load(open(notes_path(graph), encoding="utf-8")) if os.path.exists(notes_path(graph)) else {}
    own = {} if clear else notes.get(node, {})
    own = {k: v for k, v in (own | pairs).items() if v}
    notes = {k: v for k, v in (notes | {node: own}).items() if v}
    with open(notes_path(graph), "w", encoding="utf-8") as f:
        json.dump(notes, f, indent=1, sort_keys=True)
    return notes


def load(spark: SparkSession, graph: str) -> Graph:
    found = Graph.load(spark, graph)
    if os.path.exists(notes_path(graph)):
        with open(notes_path(graph), encoding="utf-8") as f:
            rows = list(json.load(f).items())
        return found.annotated(spark.createDataFrame(rows, "id string, attrs map<string,string>")) if rows else found
    return found


def shown(rows) -> str:
    return "\n".join("\t".join("" if v is None else str(v) for v in r) for r in rows)


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    if args.command == "extract":
        graph = open_source(spark, args.args[0], args.args[1])
        graph.save(args.graph)
        return report.status_line(graph.nodes)
    if args.command in ("check", "update"):
        return renew(spark, args.graph, args.args[1], args.command == "update")
    if args.command == "annotate":
        pairs = dict(a.split("=", 1) for a in args.args[1:])
        return json.dumps(annotate(args.graph, args.args[0], pairs).get(args.args[0], {}))
    graph = load(spark, args.graph)
    words = " ".join(args.args)
    if args.command == "overview":
        return render.overview(graph)
    if args.command == "find":
        method, hits = find.find(graph.nodes, text.node_texts(graph), words, args.type, args.limit or 10, full_text=True)
        return method + "\n" + shown(hits.collect())
    if args.command == "describe":
        return render.render(graph, words)
    if args.command == "path":
        steps = joins.join_path(graph, *args.args[:2]).collect()
        return joins.hint(graph, steps) or "no path found"
    if args.command == "query":
        return render.context_pack(graph, words, args.limit or 4)
    if args.command == "code-query":
        return render.code_context_pack(graph, words, args.limit or 6)
    if args.command == "impact":
        ids = [r.id for r in graph.nodes.where((F.col("type") == "function") & (F.col("name") == words)).where("coalesce(attrs['external'], '') <> 'true'").collect()] or [words]
        if len(ids) > 1:
            return "ambiguous:\n" + "\n".join(sorted(ids))
        return shown(paths.capped(paths.impact(graph.edges, ids[0], args.depth), "level", ["id"]).select("level", "id", "more").orderBy("level", "id").collect())
    if args.command == "blast":
        seeds = graph.nodes.where((F.col("id") == words) | (F.col("id") == "file:" + words) | (F.col("name") == words)).select("id")
        return shown(paths.blast(graph.edges, seeds, args.depth, external=graph.nodes.where("attrs['external'] = 'true'").select("id")).orderBy("level", "type", "id").collect())
    if args.command in ("routes", "models"):
        return shown(getattr(report, args.command)(graph, words).collect())
    if args.command == "diff":
        other = Graph.load(spark, args.args[0])
        return render.diff_text(diff.diff_nodes(graph.nodes, other.nodes), diff.diff_edges(graph.edges, other.edges))
    root = graph.source.split(":", 1)[1]
    if args.command == "grep":
        hits, total = scan.grep(text_files(spark, root), words, regex=args.type == "regex", limit=args.limit or 50)
        return shown(hits.collect()) + f"\n{total.first().total} hits"
    if args.command == "tree":
        names = graph.nodes.where("type = 'file' AND attrs['doc'] IS NULL").select("id", F.col("name").alias("path"))
        return "\n".join(r.entry for r in scan.tree(names.select("path"), words, args.depth).orderBy("entry").collect())
    if args.command == "code-diff":
        return code_diff(spark, graph, root, words or "HEAD", args.limit or 30)
    if args.command == "doc-drift":
        return shown(drifted_documents(spark, graph, root, args.limit or 15).collect())
    if args.command == "companions":
        pairs = link.co_change(git.commit_files(spark, root))
        return shown(code.companions(pairs, args.limit or 10).where(F.col("id") == words).select("other", "count").orderBy(F.desc("count"), "other").collect())
    raise ValueError(f"unknown command {args.command!r}")


def renew(spark: SparkSession, path: str, root: str, write: bool) -> str:
    """What changed in a tree since its graph was made; with write the graph is made anew from what changed."""
    graph = Graph.load(spark, path)
    recorded = graph.nodes.where("type = 'file' AND attrs['mtime'] IS NOT NULL").select(F.col("name").alias("path"), F.col("attrs")["mtime"].cast("long").alias("mtime"))
    if not write:
        changes = diff.file_drift(recorded, codebase.walk(spark, root).select("path", "mtime")).orderBy("path").collect()
        return shown([(r.change, r.path) for r in changes]) or "no drift"
    facts = codebase.written(codebase.facts(codebase.walk(spark, root).join(recorded.select("path"), "path", "left_semi")), "facts")
    found, _, changes = refresh.refresh(spark, root, facts, recorded)
    found.save(path)
    return shown([(r.change, r.path) for r in changes.orderBy("path").collect()]) or "no drift"


def text_files(spark: SparkSession, root: str):
    return codebase.walk(spark, root).select("path", F.decode("content", "UTF-8").alias("content"))


def entities(graph: Graph):
    """(id, type, file, name, signature, doc) of functions and definitions."""
    a = F.col("attrs")
    return graph.nodes.where("type IN ('function', 'definition') AND attrs['file'] IS NOT NULL").select("id", "type", a["file"].alias("file"), "name", a["signature"].alias("signature"), a["doc"].alias("doc"))


def code_diff(spark: SparkSession, graph: Graph, root: str, ref: str, most: int) -> str:
    """What changed in functions and definitions since a reference of git, with those who call them now."""
    touched = git.changed_files(spark, root, ref)
    if not touched.limit(1).count():
        return "no changed files"
    place = git.tree_at(spark, root, ref)
    try:
        old = entities(codebase.extract(spark, place)).join(touched.select(F.col("old_path").alias("file")).distinct(), "file", "left_semi")
        new = entities(codebase.extract(spark, root)).join(touched.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
        changes = diff.diff_code(old, new)
        callers = code.current_callers(graph.edges).select(F.col("id").alias("new_id"), "callers")
        rows = changes.join(callers, "new_id", "left").select("kind", "type", F.coalesce("new_id", "old_id").alias("id"), F.array_join("callers", ", ").alias("callers")).orderBy("kind", "id").limit(most).collect()
    finally:
        git.drop_tree(root, place)
    return shown(rows)


def drifted_documents(spark: SparkSession, graph: Graph, root: str, most: int):
    """(doc, broken, stale) of documents whose symbols are gone, or changed in git after them."""
    facts = codebase.facts(codebase.walk(spark, root).where(F.col("path").rlike(r"[.]mdx?$")))
    mentions = facts.where("kind = 'token'").select(F.col("path").alias("doc"), F.col("name").alias("token"))
    named = graph.nodes.where("type IN ('function', 'definition') AND attrs['external'] IS NULL").select(F.col("name").alias("token"), F.col("attrs")["file"].alias("target"))
    files = graph.nodes.where("type = 'file'").select(F.col("name").alias("token"), F.col("name").alias("target"))
    changed = git.last_commits(spark, root).select(F.col("path").alias("id"), "at")
    return diff.doc_drift(mentions, named.unionByName(files).distinct(), changed, most)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skein")
    parser.add_argument("command")
    parser.add_argument("graph")
    parser.add_argument("args", nargs="*")
    parser.add_argument("--type")
    parser.add_argument("--limit", type=int, default=0)
    parser.add_argument("--depth", type=int, default=3)
    spark = SparkSession.builder.appName("skein").getOrCreate()
    print(run(spark, parser.parse_args(argv)))


if __name__ == "__main__":
    main()
