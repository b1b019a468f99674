"""Cases of the operators that the query catalogue doesn't reach."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from skein.model import Graph, short_id
from skein.operators import diff, find, link, paths, scan, text

E = "src string, dst string, type string, ord long"


def test_bm25_equals_sqlite_full_text(spark):
    docs = ["red apple pie", "apple user_id apple", "the user id of an apple", "pie", "red red wine", "user other id", "zebra", "a b c"]
    with sqlite3.connect(":memory:") as db:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
        db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", list(enumerate(docs)))
        want = [(r[0], round(-r[1], 6)) for r in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH '\"apple\" OR \"user_id\" OR \"red\"' ORDER BY bm25(t), rowid")]
    rows = spark.createDataFrame([(f"{i}", d) for i, d in enumerate(docs)], "id string, text string")
    sizes = rows.select("id", F.size(find.word_tokens(F.regexp_replace("text", "_", " "))).alias("dl"))
    index = find.postings(rows.withColumn("text", F.regexp_replace("text", "_", " ")))
    got = [(int(r.id), round(r.score, 6)) for r in find.bm25(index, sizes, ["apple", "user_id", "red"], 20).collect()]
    assert got == want


def test_self_loops_cycles_and_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b", "X", 0), ("b", "c", "X", 1), ("c", "a", "X", 2), ("c", "c", "X", 3), ("c", "d", "Y", 4)], E)
    assert paths.shortest_path(edges, "a", "d") == ["a", "c", "d"]
    assert paths.shortest_path(edges, "a", "d", kinds=("X",)) == [] and paths.shortest_path(edges, "a", "a") == ["a"]
    got = {(r.id, r.level) for r in paths.impact(edges, "c", 3, ("X",)).collect()}
    assert got == {("b", 1), ("a", 2)}


def test_cheapest_path_on_the_driver_and_by_joins(spark, monkeypatch):
    rows = [("a", "hub", "R", 0), ("hub", "z", "R", 1), ("hub", "x", "R", 2), ("hub", "y", "R", 3), ("hub", "w", "R", 4), ("hub", "v", "R", 5), ("a", "p", "R", 6), ("p", "q", "R", 7), ("q", "z", "R", 8)]
    edges = spark.createDataFrame(rows, E)
    want = [("a", "p", 6, True), ("p", "q", 7, True), ("q", "z", 8, True)]
    assert paths.cheapest_path(edges, "a", "z") == want and paths.cheapest_path(edges, "a", "a") == [] and paths.cheapest_path(edges, "a", "no") == []
    monkeypatch.setattr(paths, "DRIVER_EDGES", 1)
    assert paths.cheapest_path(edges, "a", "z") == want


def test_remove_nodes_and_dangling_edges(spark):
    graph = Graph.of(spark, [("a", "t", "a", {}), ("b", "t", "b", {"x": "1"}), ("a", "t", "again", {})], [("a", "b", "X", {}), ("b", "a", "X", {}), ("a", "ghost", "X", {}), ("a", "a", "X", {})])
    assert graph.nodes.where("id = 'a'").first().name == "again"
    left = graph.remove_nodes_where(F.col("attrs")["x"] == "1")
    assert [r.id for r in left.nodes.collect()] == ["a"] and {r.dst for r in left.edges.collect()} == {"ghost", "a"}
    assert graph.edges_of("a").count() == 4


def test_node_text(spark):
    graph = Graph.of(spark, [("t", "table", "users", {"comment": "people"}), ("c1", "column", "users.id", {"data_type": "int"}), ("c2", "column", "users.name", {}), ("f", "function", "run", {"signature": "run()", "file": "a.py", "doc": "Runs."}), ("g", "function", "go", {})], [("t", "c1", "HAS_COLUMN", {}), ("t", "c2", "HAS_COLUMN", {}), ("t", "t", "REFERENCES", {}), ("g", "f", "CALLS", {})])
    got = {r.id: r.text for r in text.node_texts(graph).collect()}
    assert got["t"] == "table users. people. Columns: users.id, users.name. References: users."
    assert got["f"] == "function run. Signature: run(). In file a.py. Runs. Called by: go." and got["g"] == "function go."


def test_find_dispatch(spark):
    nodes = spark.createDataFrame([("1", "table", "users", {}), ("2", "table", "user_log", {}), ("3", "function", "users", {"external": "true"}), ("4", "table", "orders", {})], "id string, type string, name string, attrs map<string,string>")
    texts = nodes.select("id", "type", "name", F.concat("name", F.lit(" of the shop")).alias("text"))
    method, hits = find.find(nodes, texts, " users ")
    assert method == "name" and [r.id for r in hits.collect()] == ["1"]
    method, hits = find.find(nodes, texts, "orders shop")
    assert method == "keyword" and hits.first().id == "4"
    vectors = spark.createDataFrame([("1", "table", [1.0, 0.0]), ("4", "table", [0.0, 1.0]), ("gone", "table", [1.0, 0.0])], "id string, type string, vector array<float>")
    method, hits = find.find(nodes, texts, "log of users", embed=lambda q: [1.0, 0.1], vectors=vectors)
    ids = [r.id for r in hits.collect()]
    assert method == "hybrid" and ids[0] == "1" and "2" in ids and "gone" not in ids

    def down(_):
        raise OSError("no embedder")

    assert find.find(nodes, texts, "log of users", embed=down, vectors=vectors)[0] == "keyword"


def test_diff_is_empty_for_equal_and_mirrors(spark):
    a = Graph.of(spark, [("x", "t", "x", {"k": "1"}), ("y", "t", "y", {"k": "v" * 40})], [("x", "y", "E", {}), ("x", "y", "E", {})])
    b = Graph.of(spark, [("x", "u", "z", {"k": "2"}), ("w", "t", "w", {}), ("y", "t", "y", {"k": "w" * 40})], [("x", "y", "E", {})])
    assert diff.diff_nodes(a.nodes, a.nodes).count() == 0 and diff.diff_edges(a.edges, a.edges).count() == 0
    there = {r.id: (r.change, r.notes) for r in diff.diff_nodes(a.nodes, b.nodes).collect()}
    assert there == {"x": ("changed", ["k: 1 → 2"]), "w": ("added", None), "y": ("changed", ["k changed"])}
    assert diff.diff_nodes(b.nodes, a.nodes).where("change = 'removed'").first().id == "w"
    row = diff.diff_edges(a.edges, b.edges).first()
    assert (row.added, row.removed) == (0, 1)


def test_call_resolution_tiers(spark):
    uses = spark.createDataFrame([(1, "f", "a", False), (2, "f", "z", False), (3, "g", "z", False), (4, "g", "z", True), (5, "h", "z", False)], "use_id long, name string, scope string, local boolean")
    have = spark.createDataFrame([("f1", "f", "a", 1), ("f2", "f", "a", 2), ("f3", "f", "b", 3), ("g1", "g", "b", 4)], "id string, name string, scope string, ord int")
    got = {r.use_id: (r.target, r.status) for r in link.resolve_names(uses, have).collect()}
    assert got == {1: ("f1", "resolved"), 2: (None, "ambiguous"), 3: ("g1", "resolved"), 4: (None, "unresolved"), 5: (None, "unresolved")}


def test_route_wildcards_and_ties(spark):
    calls = spark.createDataFrame([(1, "w", "GET", "/api/users/1", False), (2, "w", "", "/x/:id", False), (3, "w", "GET", "users/1", True), (4, "w", "GET", "/one", False)], "call_id int, file string, method string, path string, relative boolean")
    routes = spark.createDataFrame([("r1", "s", "GET", "/users/:id"), ("r2", "s", "POST", "/users/:id"), ("r3", "s", "GET", "/x/list"), ("r4", "s", "GET", "/one"), ("r5", "t", "GET", "/one")], "route_id string, file string, method string, path string")
    got = {r.call_id: (r.route_id, r.score) for r in link.route_matches(calls, routes).collect()}
    assert got[1] == ("r1", 2) and got[3] == ("r1", 2) and 4 not in got


def test_innermost_drops_points_after_an_inner_end(spark):
    ranges = spark.createDataFrame([("outer", "f", 1, 20), ("inner", "f", 5, 8)], "range_id string, scope string, low int, high int")
    points = spark.createDataFrame([(1, "f", 3), (2, "f", 6), (3, "f", 10), (4, "f", 30), (5, "g", 3)], "point_id long, scope string, at int")
    got = {r.point_id: r.range_id for r in link.innermost(points, ranges).collect()}
    assert got == {1: "outer", 2: "inner", 3: None, 4: None, 5: None}
    got = {r.point_id: r.range_id for r in link.innermost(points, ranges, contained_first=True).collect()}
    assert got[3] == "outer"


def test_tree_and_short_ids(spark):
    rows = spark.createDataFrame([("a/b/c.py",), ("a/b/d.py",), ("a/x.py",)], "path string")
    assert sorted(r.entry for r in scan.tree(rows, "a", 1).collect()) == ["a/b/...", "a/x.py"]
    got = spark.createDataFrame([("table:public.users",), ("column:s.a.b",), ("func:x",)], "id string").select(short_id(F.col("id")).alias("s"))
    assert [r.s for r in got.collect()] == ["users", "s.a.b", "func:x"]
    with pytest.raises(Exception):  # noqa: B017  Spark's own error
        scan.grep(rows.withColumn("content", F.lit("x")), "(", regex=True)[0].collect()


def test_containing_ranges_against_all_pairs(spark):
    import random

    draw = random.Random(7)
    ranges = [(i, draw.choice("ab"), low, low + draw.choice([0, 0, 1, 2, 3, 7, 8, 40, 200])) for i in range(150) for low in [draw.randint(-60, 200)]] + [(500, "a", 9, 3), (501, "c", 0, 5)]
    points = [(i, draw.choice("abd"), draw.randint(-80, 420)) for i in range(300)]
    got = {r.point_id: r.range_id for r in link.innermost(spark.createDataFrame(points, "point_id long, scope string, at long"), spark.createDataFrame(ranges, "range_id long, scope string, low long, high long"), True).collect()}
    for p, scope, at in points:
        best = max(((low, r) for r, s, low, high in ranges if s == scope and low <= at <= high), default=(None, None))
        assert got[p] == best[1]
    none = spark.createDataFrame([], "range_id long, scope string, low long, high long")
    assert {r.range_id for r in link.innermost(spark.createDataFrame(points[:3], "point_id long, scope string, at long"), none, True).collect()} == {None}


def test_no_plan_pairs_a_whole_scope(spark):
    """A hot scope: ten thousand ranges that hold none of ten thousand points."""
    points = spark.range(10_000).selectExpr("id AS point_id", "'s' AS scope", "id * 2 + 1 AS at")
    ranges = spark.range(10_000).selectExpr("id AS range_id", "'s' AS scope", "id * 2 AS low", "id * 2 AS high")
    found = link.innermost(points, ranges, True)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter", "") and found.where("range_id IS NOT NULL").count() == 0


def test_routes_against_all_pairs(spark):
    import random

    draw = random.Random(3)
    part = lambda: draw.choice(["a", "b", "c", ":x", ":y", "d"])
    path = lambda: "/" + "/".join(part() for _ in range(draw.randint(1, 5)))
    routes = [(f"r{i:03d}", draw.choice("fg"), draw.choice(["GET", "POST", ""]), path()) for i in range(60)] + [("root", "f", "GET", "/"), ("wild", "g", "GET", "/:a/:b")]
    calls = [(i, draw.choice("fh"), draw.choice(["GET", "POST", ""]), path(), draw.random() < 0.3) for i in range(200)] + [(900, "h", "GET", "/", False)]
    got = {r.call_id: (r.route_id, r.score) for r in link.route_matches(spark.createDataFrame(calls, "call_id long, file string, method string, path string, relative boolean"), spark.createDataFrame(routes, "route_id string, file string, method string, path string")).collect()}
    want = {}
    for call, file, method, path_, relative in calls:
        tail, found = [x for x in path_.split("/") if x][::-1], {}
        for route, route_file, route_method, route_path in routes:
            other = [x for x in route_path.split("/") if x][::-1]
            n = min(len(tail), len(other))
            if n and file != route_file and (method == route_method or not method or not route_method) and all(x == y or ":" in (x[0], y[0]) for x, y in zip(tail, other, strict=False)) and (not relative or n >= 2):
                found.setdefault(n, set()).add(route)
        if found and len(found[max(found)]) == 1:
            want[call] = (*found[max(found)], max(found))
    assert got == want and len(want) > 20


def test_shared_state_of_a_hot_state(spark):
    rows = [(f"f{i:04d}", "hot", "READS") for i in range(2000)] + [("f0003", "hot", "WRITES"), ("w", "own", "WRITES")]
    got = {(r.id, r.kind): (r.n_others, r.others) for r in link.shared_state(spark.createDataFrame(rows, "id string, state string, kind string")).collect()}
    assert got["f0003", "READS"] == (1999, ["f0000", "f0001", "f0002", "f0004", "f0005", "f0006"]) and got["f1999", "WRITES"] == (1, ["f0003"])
    assert ("f0003", "WRITES") not in got and not any(k[0] == "w" for k in got) and got["f1000", "READS"][0] == 1999


def test_co_change_drops_a_huge_basket(spark):
    baskets = [("huge", i) for i in range(3000)] + [(f"b{k}", x) for k in range(5) for x in (1, 2)]
    got = link.co_change(spark.createDataFrame(baskets, "basket string, item long")).collect()
    assert [(r.a, r.b, r["count"], r.band) for r in got] == [(1, 2, 5, "high")]


def test_paths_of_any_length(spark):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", "X", i) for i in range(26)], E)
    assert paths.shortest_path(chain, "n00", "n24") == [f"n{i:02d}" for i in range(25)]
    assert paths.shortest_path(chain, "n00", "n24", most=20) == []


def test_budget_over_many_ranges(spark):
    rows = [(i, 0 if i < 300 else 7) for i in range(1000)]
    got = scan.budget_cut(spark.createDataFrame(rows, "id long, size long").repartition(7), "size", ["id"], 70).collect()
    assert {r.id: r.used for r in got} == {i: 7 * max(0, i - 300) for i in range(311)}
    assert scan.budget_cut(spark.createDataFrame([], "id long, size long"), "size", ["id"], 70).count() == 0


def test_selectors_of_styles_and_markup(spark):
    from skein.functions import text as fn

    css = "/* .gone{} */ .a.b > #top, a[data-k='x']:hover { color: red; --gap : 2px; } @media (min-width: 3px) { .in-side { width: .5em } } :root{--main-bg:#fff} .z"
    html = """<div class="one two-x {{no}}" id='main' data-role="r"><a href="#end">x</a></div><script>el.classList.add("on"); document.getElementById('late'); x.setAttribute("data-open", 1);
    el.dataset.userName = 2; q.querySelector(".deep #er [data-z]"); s = "width: var( --gap )"</script>"""
    row = spark.createDataFrame([(css, html)], "css string, html string").select(fn.css_selectors(F.col("css")).alias("defined"), fn.style_uses(F.col("html")).alias("used")).first()
    assert row.defined == sorted([".a", ".b", "#top", "[data-k]", "--gap", ".in-side", "--main-bg"])
    assert row.used == sorted([".one", ".two-x", "#main", "[data-role]", "#end", ".on", "#late", "[data-open]", "[data-user-name]", ".deep", "#er", "[data-z]", "--gap"])


def test_parallel_foreign_keys_of_postgres(spark):
    from skein.operators import joins, report
    from skein.sources import postgres

    rows = {
        "relations": [(1, "public", "orders", "r", None, 5.0, None), (2, "public", "addresses", "r", None, 5.0, None)],
        "columns": [(1, 1, "id", "int", 0, True, None, None), (1, 2, "billing_id", "int", 0, False, None, None), (1, 3, "shipping_id", "int", 0, False, None, None), (2, 1, "id", "int", 0, True, None, None)],
        "constraints": [(1, "f", 2, [3], [1], "b_shipping"), (1, "f", 2, [2], [1], "a_billing")],
    }
    graph = postgres.from_catalog(spark, {n: spark.createDataFrame(rows.get(n, []), ddl) for n, ddl in postgres.INPUTS.items()}, "shop")
    refs = graph.edges.where("type = 'REFERENCES'").orderBy("ord").collect()
    assert [r.attrs["from_column"] for r in refs] == ["billing_id", "shipping_id"] and graph.edges.where("type <> 'HAS_COLUMN'").groupBy("ord").count().where("count > 1").count() == 0
    (step,) = joins.join_path(graph, "orders", "addresses").collect()
    assert (step.from_column, step.to_column) == ("billing_id", "id")
    assert {r.name: r.refs for r in report.overview_tables(graph).collect()}["orders"] == "addresses, addresses"
