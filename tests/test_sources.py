import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from skein.model import Graph
from skein.operators import joins, report
from skein.sources import open_source

DDL = """
CREATE TABLE members (member_no INTEGER PRIMARY KEY, full_name TEXT NOT NULL, card TEXT UNIQUE, grade TEXT CHECK (grade IN ('junior', 'adult')));
CREATE TABLE shelves (shelf_id INTEGER PRIMARY KEY, room TEXT, kind TEXT NOT NULL CHECK ("kind" IN ('open', 'closed', 'depot')));
CREATE TABLE volumes (volume_id INTEGER PRIMARY KEY, shelf INTEGER REFERENCES shelves, heading TEXT, pages INTEGER);
CREATE TABLE loans (loan_id INTEGER PRIMARY KEY, member INTEGER NOT NULL REFERENCES members(member_no), volume INTEGER NOT NULL REFERENCES volumes(volume_id), due TEXT);
CREATE TABLE fines (fine_id INTEGER PRIMARY KEY, loan INTEGER REFERENCES loans(loan_id), cents INTEGER);
CREATE VIEW late_loans AS SELECT * FROM loans WHERE due < '2020';
CREATE INDEX loan_by_member ON loans(member);
CREATE INDEX loan_by_due ON loans(due);
INSERT INTO members VALUES (1, 'Ada', 'c1', 'adult'), (2, 'Ben', 'c2', 'junior');
INSERT INTO shelves VALUES (1, 'A', 'open');
INSERT INTO volumes VALUES (1, 1, 'x', 10), (2, 1, 'y', 20), (3, 1, 'z', 30);
"""


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("db") / "library.db"
    with sqlite3.connect(path) as db:
        db.executescript(DDL)
    return open_source(spark, "sqlite", str(path))


def test_sqlite_counts(shop):
    counts = {r.type: r.n for r in report.overview_counts(shop.nodes).collect()}
    assert counts == {"database": 1, "table": 5, "column": 18, "view": 1, "index": 3}
    edges = {r.type: r.n for r in report.overview_counts(shop.edges).collect()}
    assert edges == {"HAS_TABLE": 6, "HAS_COLUMN": 18, "FOREIGN_KEY": 4, "REFERENCES": 5, "HAS_INDEX": 3, "INDEXES": 3}
    enums = {r.name: r.e for r in shop.nodes.select("name", F.col("attrs")["enum_values"].alias("e")).where("e IS NOT NULL").collect()}
    assert enums == {"members.grade": "junior, adult", "shelves.kind": "open, closed, depot"}
    rows = {r.name: r for r in report.overview_tables(shop).collect()}
    assert rows["members"].row_count == 2 and rows["volumes"].row_count == 3 and rows["loans"].refs in ("members, volumes", "volumes, members")


def test_join_path(shop):
    steps = joins.join_path(shop, "fines", "shelves").collect()
    assert [(s.from_table, s.to_table, s.from_column, s.to_column) for s in steps] == [("fines", "loans", "loan", "loan_id"), ("loans", "volumes", "volume", "volume_id"), ("volumes", "shelves", "shelf", "shelf_id")]
    assert joins.hint(shop, steps) == "JOIN loans ON fines.loan = loans.loan_id JOIN volumes ON loans.volume = volumes.volume_id JOIN shelves ON volumes.shelf = shelves.shelf_id"
    assert joins.join_path(shop, "members", "members").count() == 0 and joins.join_path(shop, "members", "nothing").count() == 0
    assert report.resolve_id(shop, "members") == "table:members"


def test_save_and_load(shop, spark, tmp_path):
    shop.save(str(tmp_path / "g"))
    back = Graph.load(spark, str(tmp_path / "g"))
    assert back.nodes.count() == 28 and back.edges.count() == 39 and back.source == shop.source
    shop.save_json(str(tmp_path / "g.json"))
    again = Graph.load_json(spark, str(tmp_path / "g.json"))
    assert again.nodes.count() == 28 and again.edges.count() == 39
    notes = spark.createDataFrame([("table:members", {"comment": "people"}), ("table:none", {"a": "b"})], "id string, attrs map<string,string>")
    noted = Graph.load(spark, str(tmp_path / "g"), notes)
    assert noted.nodes.where("id = 'table:members'").first().attrs["comment"] == "people" and noted.nodes.count() == 28


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        open_source(spark, "oracle", "x")


SPEC = {
    "openapi": "3.0.0", "info": {"title": "Shop", "version": "1"}, "security": [{"key": []}],
    "servers": [{"url": "https://{host}/v1", "variables": {"host": {"default": "api.example.com"}}}],
    "components": {
        "securitySchemes": {"key": {"type": "apiKey", "in": "header", "name": "X-Key"}, "bearer": {"type": "http", "scheme": "bearer"}},
        "schemas": {
            "app.models.User": {"required": ["id"], "properties": {"id": {"type": "integer", "format": "int64"}, "state": {"$ref": "#/components/schemas/State"}, "orders": {"type": "array", "items": {"$ref": "#/components/schemas/Order"}}, "nick": {"anyOf": [{"type": "string"}, {"type": "null"}]}}},
            "Order": {"properties": {"owner": {"allOf": [{"$ref": "#/components/schemas/app.models.User"}]}}},
            "State": {"type": "string", "enum": ["on", "off"]}, "a.Dup": {"type": "object"}, "b.Dup": {"type": "object"},
        },
    },
    "paths": {"/users": {
        "parameters": [{"name": "page", "in": "query", "schema": {"type": "integer"}}],
        "get": {"security": [], "responses": {"200": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/app.models.User"}}}}}, "404": {}}},
        "post": {"requestBody": {"content": {"text/plain": {}, "application/json": {"schema": {"$ref": "#/components/schemas/app.models.User"}}}}, "responses": {"default": {"content": {}}}},
    }},
}


def test_openapi(spark, tmp_path):
    path = tmp_path / "spec.json"
    path.write_text(json.dumps(SPEC, indent=1))
    graph = open_source(spark, "openapi", str(path))
    nodes = {r.id: r for r in graph.nodes.collect()}
    assert {"schema:User", "schema:a.Dup", "schema:b.Dup", "endpoint:GET /users", "property:User.nick"} <= set(nodes)
    assert nodes["api:Shop"].attrs["base_url"] == "https://api.example.com/v1"
    assert nodes["property:User.id"].attrs == {"data_type": "integer(int64)", "not_null": "true"}
    assert nodes["property:User.state"].attrs["enum_values"] == "on, off" and nodes["property:User.nick"].attrs["data_type"] == "string"
    assert nodes["property:User.orders"].attrs["data_type"] == "array<Order>"
    assert "auth" not in nodes["endpoint:GET /users"].attrs and nodes["endpoint:POST /users"].attrs["auth"] == "apiKey header X-Key"
    assert nodes["endpoint:GET /users"].attrs["query_params"] == "page integer"
    edges = {(r.src, r.dst, r.type): r.attrs for r in graph.edges.collect()}
    assert edges["schema:User", "schema:Order", "REFERENCES"] == {"from_property": "orders", "cardinality": "array"}
    assert ("property:User.state", "schema:State", "REFERS_TO") not in edges
    assert edges["endpoint:GET /users", "schema:User", "RESPONDS_WITH"] == {"status": "200", "cardinality": "array"} and ("endpoint:POST /users", "schema:User", "ACCEPTS") in edges
    assert joins.hint(graph, joins.join_path(graph, "User", "Order").collect()).startswith("User → Order")
    (tmp_path / "no.json").write_text("{}")
    with pytest.raises(ValueError):
        open_source(spark, "openapi", str(tmp_path / "no.json"))


def test_postgres_dump(spark, tmp_path):
    dump = {
        "enums": [{"type_oid": 9, "sort_order": 2, "label": "b"}, {"type_oid": 9, "sort_order": 1, "label": "a"}],
        "relations": [{"oid": 1, "schema": "public", "name": "u", "kind": "r", "estimate": 5}, {"oid": 2, "schema": "s", "name": "o", "kind": "p", "estimate": -1}, {"oid": 3, "schema": "public", "name": "v", "kind": "m", "estimate": -1}, {"oid": 4, "schema": "public", "name": "i", "kind": "i"}],
        "columns": [{"rel_oid": 1, "position": 1, "name": "a", "data_type": "int", "type_oid": 8, "not_null": True}, {"rel_oid": 1, "position": 2, "name": "b", "data_type": "e", "type_oid": 9, "not_null": False}, {"rel_oid": 2, "position": 1, "name": "ua", "data_type": "int", "type_oid": 8}, {"rel_oid": 2, "position": 2, "name": "ub", "data_type": "e", "type_oid": 9}, {"rel_oid": 2, "position": -1, "name": "ctid", "data_type": "tid", "type_oid": 8}],
        "constraints": [{"rel_oid": 1, "kind": "p", "key": [1, 2], "name": "pk"}, {"rel_oid": 2, "kind": "f", "target_oid": 1, "key": [1, 2], "target_key": [1, 2], "name": "fk"}],
        "indexes": [{"rel_oid": 2, "schema": "s", "name": "ix", "is_unique": True, "key": [2, 0]}],
        "view_deps": [{"view_oid": 3, "target_oid": 1}, {"view_oid": 3, "target_oid": 1}, {"view_oid": 3, "target_oid": 3}],
    }
    for name, rows in dump.items():
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))
    graph = open_source(spark, "postgres", str(tmp_path))
    nodes = {r.id: r for r in graph.nodes.collect()}
    assert nodes["column:public.u.b"].attrs == {"data_type": "e", "enum_values": "a, b", "primary_key": "true"}
    assert nodes["table:s.o"].attrs["partitioned"] == "true" and "row_count_estimate" not in nodes["table:s.o"].attrs and nodes["table:public.u"].attrs["row_count_estimate"] == "5"
    assert nodes["table:public.u"].name == "u" and nodes["column:s.o.ua"].name == "s.o.ua" and "column:s.o.ctid" not in nodes
    edges = [(r.src, r.dst, r.type, tuple(sorted(r.attrs.items()))) for r in graph.edges.collect()]
    assert ("table:s.o", "table:public.u", "REFERENCES", (("from_column", "ua,ub"), ("to_column", "a,b"))) in edges
    assert [e for e in edges if e[2] == "INDEXES"] == [("index:s.ix", "column:s.o.ub", "INDEXES", ())]
    assert [e[:2] for e in edges if e[3] == (("via", "view"),)] == [("view:public.v", "table:public.u")]
    assert joins.hint(graph, joins.join_path(graph, "s.o", "u").collect()) == "JOIN u ON s.o.ua = u.a AND s.o.ub = u.b"


TREE = {
    "app/main.py": 'from app import util\nimport os\n\n\n@app.get("/users/{id}")\ndef read_user(id):\n    """Reads one."""\n    return util.load(helper(id))\n\n\ndef helper(x):\n    return x\n',
    "app/util.py": "class User(Base):\n    __tablename__ = 'users'\n    id = Column(Integer)\n    order_id = Column('oid', Integer)\n\n\nclass Order(Base):\n    id = Column(Integer)\n\n\ndef load(x):\n    return missing_thing(x)\n",
    "app/__init__.py": "",
    "web/api.ts": "import { go } from './lib';\nexport async function fetchUser(id: string) {\n  return fetch(`/users/${id}`);\n}\n",
    "web/lib.ts": "export const go = (x) => {\n  return x;\n};\n",
    "web/style.css": ".card { color: red }\n#top, .x-y { --gap: 2px }\n",
    "web/index.html": '<div class="card" id="top"></div>',
    "srv/main.go": 'package main\n\nimport "net/http"\n\n// Server serves.\ntype Server struct {\n\tName string `db:"server_name"`\n}\n\nfunc (s *Server) Run() {\n\tsetup()\n}\n\nfunc setup() {\n\tr.GET("/health", auth, health)\n}\n\nfunc auth() {}\n\nfunc health() {}\n',
    "README.md": "# Guide\n\nUse `helper()` and `app/util.py`.\n\n```\n`not_this`\n```\n",
    "node_modules/x/a.js": "function hidden() {}",
    ".git/x.py": "def hidden(): pass",
}


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return open_source(spark, "codebase", str(root))


def test_codebase(code):
    nodes = {r.id: r for r in code.nodes.collect()}
    edges = {(r.src, r.dst, r.type) for r in code.edges.collect()}
    assert not any("hidden" in n for n in nodes)
    fn = {r.name: r.id for r in nodes.values() if r.type == "function"}
    assert nodes[fn["read_user"]].attrs["doc"] == "Reads one." and nodes[fn["setup"]].attrs["exported"] == "false"
    assert (fn["read_user"], fn["helper"], "CALLS") in edges and (fn["load"], "call:missing_thing", "CALLS") in edges
    assert (fn["Run"], fn["setup"], "CALLS") in edges and ("def:srv/main.go:Server", fn["Run"], "HAS_METHOD") in edges
    assert ("file:app/main.py", "file:app/util.py", "IMPORTS") in edges and ("file:web/api.ts", "file:web/lib.ts", "IMPORTS") in edges and ("file:app/main.py", "import:os", "IMPORTS") in edges
    route = next(r.id for r in nodes.values() if r.type == "route" and r.attrs["path"] == "/users/{id}")
    health = next(r.id for r in nodes.values() if r.type == "route" and r.attrs["path"] == "/health")
    assert (route, fn["read_user"], "HANDLED_BY") in edges and (fn["fetchUser"], route, "CALLS_ENDPOINT") in edges
    assert (health, fn["health"], "HANDLED_BY") in edges and (health, fn["auth"], "USES_MIDDLEWARE") in edges
    user = nodes["model:app/util.py:User"]
    assert user.attrs["table"] == "users" and user.attrs["fields"] == "id, order_id→oid" and ("model:app/util.py:User", "model:app/util.py:Order", "REFERENCES") in edges
    assert nodes["model:srv/main.go:Server"].attrs["fields"] == "Name→server_name"
    assert ("doc:README.md", fn["helper"], "MENTIONS") in edges and ("doc:README.md", "file:app/util.py", "MENTIONS") in edges
    assert ("file:web/index.html", "file:web/style.css", "USES_STYLE") in edges and nodes["file:web/style.css"].attrs["css_selectors"] == "#top,--gap,.card,.x-y"


def test_reports_over_code(code):
    rows = {r.path: r for r in report.routes(code).collect()}
    assert rows["/health"].handler == "health" and rows["/health"].middleware == "auth" and "fetchUser" in rows["/users/{id}"].callers
    found = {r.name: r for r in report.models(code).collect()}
    assert found["User"].table == "users" and found["User"].renamed == "order_id→oid"
    assert "function" in report.status_line(code.nodes)
