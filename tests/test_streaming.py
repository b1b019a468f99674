import os
import time

import pytest
from pyspark.sql import functions as F
from skein.shared import written
from skein.sources import codebase
from skein.streaming import refresh


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.py": "def one():\n    return two()\n", "b.py": "def two():\n    return 1\n", "c.py": "x = 1\n"}.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_refresh_equals_a_full_extract(spark, tree):
    files = codebase.walk(spark, str(tree))
    facts, recorded = written(codebase.facts(files), "f"), written(files.select("path", "mtime"), "m")
    assert not refresh.has_drift(recorded, codebase.walk(spark, str(tree)))
    time.sleep(1.1)
    (tree / "b.py").write_text("def two():\n    return three()\n\n\ndef three():\n    return 0\n")
    os.remove(tree / "c.py")
    (tree / "d.py").write_text("def four():\n    return one()\n")
    graph, _, changes = refresh.refresh(spark, str(tree), facts, recorded)
    assert {(r.path, r.change) for r in changes.collect()} == {("b.py", "changed"), ("c.py", "deleted"), ("d.py", "added")}
    full = codebase.extract(spark, str(tree))
    shown = lambda g: {(r.src, r.dst, r.type) for r in g.edges.collect()}
    assert shown(graph) == shown(full) and {r.id for r in graph.nodes.collect()} == {r.id for r in full.nodes.collect()}


def test_refresh_refuses_another_tree(spark, tree):
    files = codebase.walk(spark, str(tree))
    recorded = spark.range(30).select(F.concat(F.lit("gone"), "id").alias("path"), F.lit(1).cast("long").alias("mtime"))
    with pytest.raises(refresh.WrongRoot):
        refresh.refreshed_facts(spark, str(tree), codebase.facts(files), recorded)


def test_stream_of_files(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    run = lambda: refresh.watch(spark, str(tree), str(out / "facts"), str(out / "checkpoint")).awaitTermination(120)
    run()
    (tree / "e.py").write_text("def five():\n    return 5\n")
    run()
    names = {r.name for r in refresh.current_facts(spark, str(out / "facts")).where("kind = 'function'").collect()}
    assert names == {"one", "two", "five"}
