"""Every registered query with oracle SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from skein.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    assert got.columns
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry_imports_without_llm(tmp_path):
    """The driver file works when the training-data folders are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "skein"), tmp_path / "skein", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 50 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
