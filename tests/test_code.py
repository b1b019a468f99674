"""Git, projects, overlays, vectors and the commands of a source tree."""

import argparse
import subprocess

import pytest
from pyspark.sql import functions as F
from skein import cli
from skein.operators import vectors
from skein.sources import git, projects


def test_jsonc_and_overlays(spark):
    text = '{"a": "x // no, ] comment", // one\n "b": [1, 2,], "c\\"": {"d": 1,\n}, }'
    import json

    assert json.loads(projects.strip_jsonc(text)) == {"a": "x // no, ] comment", "b": [1, 2], 'c"': {"d": 1}}
    nodes, edges = projects.overlay(spark, '{"Order": "what a customer buys", }', '{"features": {"pay": ["a.py", "b.py"]}, "generates": {"spec.yml": ["c.py"]}}')
    assert {r.id for r in nodes.collect()} == {"def:Order", "feature:pay"}
    assert [(r.src, r.dst, r.type) for r in edges.orderBy("ord").collect()] == [("feature:pay", "file:a.py", "IMPLEMENTED_BY"), ("feature:pay", "file:b.py", "IMPLEMENTED_BY"), ("file:spec.yml", "file:c.py", "GENERATES")]


def test_projects(spark):
    files = spark.createDataFrame([(p,) for p in ("go.mod", "web/package.json", "web/pyproject.toml", "web/src/a.js", "lib/X.csproj", "lib/deep/b.cs", "README.md")], "path string")
    found = projects.detect_projects(files)
    assert {(r.folder, r.manifest) for r in found.collect()} == {("", "go.mod"), ("web", "package.json"), ("lib", "X.csproj")}
    near = {r.path: r.folder for r in projects.nearest_project(files, found).collect()}
    assert near["web/src/a.js"] == "web" and near["lib/deep/b.cs"] == "lib" and near["README.md"] == "" and len(near) == 7


def test_vector_store(spark):
    texts = spark.createDataFrame([("1", "table", "a"), ("2", "table", "bb"), ("3", "database", "c"), ("4", "column", "dddd")], "id string, type string, text string")
    none = spark.createDataFrame([], vectors.STORED)
    embed = lambda xs: [[float(len(x)), 0.0] for x in xs]
    first = vectors.reindex(texts, none, embed)
    assert {(r.id, r.model, tuple(r.vector)) for r in first.collect()} == {("1", "bge-m3", (1.0, 0.0)), ("2", "bge-m3", (1.0, 0.0)), ("4", "bge-m3", (1.0, 0.0))}
    held = spark.createDataFrame(first.collect(), vectors.STORED)
    broken = lambda xs: [[0.0, 5.0] for x in xs]
    changed = texts.withColumn("text", F.when(F.col("id") == "2", "new").otherwise(F.col("text")))
    second = {r.id: tuple(r.vector) for r in vectors.reindex(changed, held, broken).collect()}
    assert second == {"1": (1.0, 0.0), "2": (0.0, 1.0), "4": (1.0, 0.0)}
    other = vectors.reindex(texts, held, broken, model="other", only=texts.where("id = '4'"))
    assert [(r.id, r.model) for r in other.collect()] == [("4", "other")]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(4):
        (root / "shop.py").write_text(f"def total(items):\n    return sum(items) + {k}\n\n\ndef pay(items):\n    return total(items)\n")
        (root / "tax.py").write_text(f"RATE = {k}\n\n\ndef rate():\n    return RATE\n")
        (root / "README.md").write_text("# Shop\nSee `total` and `gone`.\n") if k == 0 else None
        run("add", ".")
        run("commit", "-q", "-m", f"step {k}")
    return root


def test_git_scans(spark, tree):
    assert {r.path for r in git.tracked(spark, str(tree)).collect()} == {"shop.py", "tax.py", "README.md"}
    baskets = git.commit_files(spark, str(tree))
    assert baskets.select("basket").distinct().count() == 4 and baskets.count() == 9
    assert git.last_commits(spark, str(tree)).count() == 3
    (tree / "new.py").write_text("x = 1\n")
    assert [(r.change, r.path) for r in git.changed_files(spark, str(tree), "HEAD").collect()] == [("added", "new.py")]
    (tree / "new.py").unlink()


def test_commands_of_a_tree(spark, tree, tmp_path):
    graph = str(tmp_path / "g")
    ask = lambda command, *args, **kw: cli.run(spark, argparse.Namespace(command=command, graph=graph, args=list(args), **({"type": None, "limit": 0, "depth": 3} | kw)))
    ask("extract", "codebase", str(tree))
    assert ask("check", "codebase", str(tree)) == "no drift"
    assert ask("grep", "RETURN total") == "shop.py\t6\t    return total(items)\n1 hits"
    assert ask("tree", depth=1) == "README.md\nshop.py\ntax.py"
    assert ask("companions", "shop.py") == "tax.py\t4"
    assert ask("code-diff") == "no changed files"
    drift = ask("doc-drift").split("\t")
    assert drift[0] == "README.md" and drift[1:] == ["1", "0"]
    before = (tree / "tax.py").read_text()
    (tree / "tax.py").write_text(before.replace("def rate():", "def rate(year):"))
    shown = ask("code-diff", "HEAD")
    assert shown.startswith("changed\tfunction\tfunc:tax.py:rate:4")
    assert ask("check", "codebase", str(tree)) == "changed\ttax.py" and ask("update", "codebase", str(tree)) == "changed\ttax.py"
    assert ask("check", "codebase", str(tree)) == "no drift"
    (tree / "tax.py").write_text(before)
    assert ask("find", "total of items").startswith("keyword-fts")


def test_scripts_and_forms_of_templates():
    from skein.sources.lexing import line_at, parse_file

    page = """<html><script src="/a.js">gone()</script>
<form action='/users' METHOD="post"></form>
<script type="module">
function load() {
  fetch("/users/1");
}
</script><script type="text/template">other()</script></html>
"""
    facts = parse_file("web/page.vue", page.encode())
    assert {(f["kind"], f["name"], f["line"]) for f in facts if f["kind"] in ("function", "client")} == {("function", "load", 4), ("client", '"/users/1"', 5), ("client", '"/users"', 2)}
    assert {f["name"] for f in facts if f["kind"] == "call"} == {"fetch"}
    assert [line_at("a\nb\nc", k) for k in range(5)] == [1, 1, 2, 2, 3]


def test_companions_and_builtins_of_a_tree(spark, tree):
    from skein.sources import open_source

    graph = open_source(spark, "codebase", str(tree))
    (edge,) = graph.edges.where("type = 'CO_CHANGED'").collect()
    assert (edge.src, edge.dst, edge.attrs["count"], edge.attrs["confidence"]) == ("file:shop.py", "file:tax.py", "4", "medium")
    names = {r.id for r in graph.nodes.collect()}
    assert "call:sum" in names and "call:print" not in names
