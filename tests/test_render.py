import argparse
import sqlite3

import pytest
from skein import cli
from skein.operators import render
from skein.sources import open_source

from tests.test_sources import DDL


@pytest.fixture(scope="module")
def shop_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("db") / "shop.db"
    with sqlite3.connect(path) as db:
        db.executescript(DDL)
    return str(path)


def test_table_text(spark, shop_path):
    shown = render.render(open_source(spark, "sqlite", shop_path), "loans")
    lines = shown.split("\n")
    assert lines[0] == "table loans" and "  member INTEGER NN → members.member_no" in lines
    assert any(x.startswith("  references: ") and "members (member→member_no)" in x for x in lines) and any(x.startswith("  referenced by: ") and "fines (loan)" in x for x in lines)
    assert "  kind enum(open, closed, depot)" in "\n".join(x.replace(" NN", "") for x in render.render(open_source(spark, "sqlite", shop_path), "shelves").split("\n"))
    assert render.render(open_source(spark, "sqlite", shop_path), "nothing") == "not found: nothing"


def test_context_pack(spark, shop_path):
    pack = render.context_pack(open_source(spark, "sqlite", shop_path), "loans of members", limit=3)
    assert "table members (2 rows)" in pack and "loans.member = members.member_no" in pack and "; sqlite" in pack


def test_cli(spark, shop_path, tmp_path):
    graph = str(tmp_path / "g")
    ask = lambda command, *args, **kw: cli.run(spark, argparse.Namespace(command=command, graph=graph, args=list(args), **({"type": None, "limit": 0, "depth": 3} | kw)))
    assert "5 table" in ask("extract", "sqlite", shop_path)
    assert ask("path", "members", "volumes").startswith("JOIN loans ON members.member_no = loans.member")
    assert ask("find", "members").startswith("name\ntable:members")
    assert ask("annotate", "table:members", "comment=people", "x=1") == '{"comment": "people", "x": "1"}'
    assert ask("annotate", "table:members", "x=") == '{"comment": "people"}'
    assert "table members (2 rows) -- people" in ask("describe", "members") and "5 table" in ask("overview")
    assert ask("diff", graph).startswith("~ table:members (-comment)")
