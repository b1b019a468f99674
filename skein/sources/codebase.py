"""Source trees: one distributed pass turns files into facts, joins link the facts.

Files are read through Spark, each task parses its own; call, import, route,
mention, model and style links are then the joins of skein.operators.link.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import client_path, css_selectors, style_uses
from skein.model import Graph
from skein.operators import link
from skein.shared import written
from skein.sources import git

#: Folders that are never read.
SKIPPED = ("node_modules", "vendor", "dist", "build", "target", "__pycache__", "venv", "out", "bin", "obj", "coverage")
#: Names of the languages themselves, which get no external node.
BUILTINS = (
    "append", "cap", "clear", "close", "copy", "delete", "len", "make", "max", "min", "new", "panic", "print", "println", "recover",
    "bool", "byte", "rune", "string", "error", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "complex64", "complex128",
    "isinstance", "range", "enumerate", "sorted", "repr", "getattr", "setattr", "hasattr", "require", "parseInt", "parseFloat", "Boolean", "Number", "String", "Array", "Object", "Symbol",
)
CODE = ("py", "go", "js", "jsx", "mjs", "ts", "tsx", "java", "kt", "cs", "rs", "swift")
FACTS = "path string, kind string, line int, end int, name string, attrs map<string,string>, ord bigint"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size, content) of a tree's files, path relative to the root; hidden and skipped folders left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    path = F.regexp_extract("path", ".*?" + "\\Q" + base + "\\E" + "(.*)$", 1)
    rows = found.select(path.alias("path"), F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    hidden = F.exists(F.split("path", "/"), lambda x: x.startswith(".") | x.isin(*SKIPPED))
    return rows.where((F.col("path") != "") & ~hidden)


def facts(files: DataFrame) -> DataFrame:
    """Facts of every file of (path, content)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from skein.sources.lexing import parse_file

        kind = pa.map_(pa.string(), pa.string())
        for batch in it:
            rows: dict[str, list] = {n: [] for n in ("path", "kind", "line", "end", "name", "attrs", "ord")}
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for i, f in enumerate(parse_file(path, data)):
                    for c, v in zip(rows, (path, f["kind"], f["line"], f["end"], f["name"], list(f["attrs"].items()), i), strict=True):
                        rows[c].append(v)
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), kind, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return files.select("path", "content").mapInArrow(run, FACTS)


def none() -> Column:
    return F.create_map().cast("map<string,string>")


def extract(spark: SparkSession, source: str) -> Graph:
    files = walk(spark, source)
    graph = link_facts(written(facts(files), "facts"), files, f"codebase:{source}")
    return with_companions(graph, git.commit_files(spark, source)) if git.is_tree(source) else graph


def with_companions(graph: Graph, commits: DataFrame) -> Graph:
    """The graph with links between files that commits (basket, item) changed together, but those that import one another."""
    files = graph.nodes.where("type = 'file' AND attrs['doc'] IS NULL").select(F.col("name").alias("item"), "id")
    pairs = link.co_change(commits.join(files.select("item"), "item", "left_semi"))
    linked = graph.edges.where("type = 'IMPORTS'").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    file = lambda c: F.concat(F.lit("file:"), c)
    rows = pairs.withColumns({"x": F.least(file("a"), file("b")), "y": F.greatest(file("a"), file("b"))}).join(linked, ["x", "y"], "left_anti")
    attrs = F.create_map(F.lit("count"), F.col("count").cast("string"), F.lit("ratio"), F.format_number("ratio", 2), F.lit("confidence"), F.col("band"))
    more = rows.select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit("CO_CHANGED").alias("type"), attrs.alias("attrs"), F.lit(0).cast("long").alias("ord"))
    return Graph(graph.nodes, written(graph.edges.unionByName(more), "edges"), graph.source, graph.extracted_at)


def link_facts(found: DataFrame, files: DataFrame, source: str) -> Graph:
    """The graph of a tree's facts. Nothing but the facts is needed to link again after a change."""
    a, of = F.col("attrs"), lambda kind: found.where(F.col("kind") == kind)
    file_id = F.concat(F.lit("file:"), "path")
    extra = lambda **kv: F.map_concat(a, F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull()))
    edge = lambda df, src, dst, kind, attrs=None: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (none() if attrs is None else attrs).alias("attrs"), F.col("ord").cast("long").alias("ord"))

    head = of("file").select("path", file_id.alias("id"), "attrs", "ord")
    sheets = files.where(F.col("path").rlike(r"\.(css|scss|less)$")).select("path", css_selectors(F.decode("content", "UTF-8")).alias("tokens"))
    mtime = files.select("path", "mtime")
    nodes = [head.join(mtime, "path").join(sheets.select("path", F.array_join("tokens", ",").alias("css")), "path", "left").select("id", F.lit("file").alias("type"), F.col("path").alias("name"), extra(path=F.col("path"), mtime=F.col("mtime"), css_selectors=F.nullif(F.col("css"), F.lit(""))).alias("attrs"))]
    edges = []

    functions = of("function").select(F.concat_ws(":", F.lit("func"), "path", "name", F.col("line").cast("string")).alias("id"), "path", "line", "end", "name", "attrs", "ord")
    nodes.append(functions.select("id", F.lit("function").alias("type"), "name", extra(file=F.col("path"), line_start=F.col("line"), line_end=F.col("end")).alias("attrs")))
    edges.append(edge(functions, F.col("id"), file_id, "BELONGS_TO"))
    definitions = of("definition").select(F.concat_ws(":", F.lit("def"), "path", "name").alias("id"), "path", "line", "name", "attrs", "ord").dropDuplicates(["id"])
    nodes.append(definitions.select("id", F.lit("definition").alias("type"), "name", extra(file=F.col("path"), line_start=F.col("line")).alias("attrs")))
    edges.append(edge(definitions, F.col("id"), file_id, "BELONGS_TO"))
    methods = functions.where(a["receiver"].isNotNull()).withColumn("owner", F.concat_ws(":", F.lit("def"), "path", a["receiver"]))
    edges.append(edge(methods.join(definitions.select(F.col("id").alias("owner")), "owner", "left_semi"), F.col("owner"), F.col("id"), "HAS_METHOD"))

    # Calls: the innermost function around each, then the function it names.
    calls = of("call").select(F.xxhash64("path", "ord").alias("use_id"), "path", "line", "name", F.coalesce(a["selector"] == "true", F.lit(False)).alias("local"), "ord")
    around = link.innermost(calls.select(F.col("use_id").alias("point_id"), F.col("path").alias("scope"), F.col("line").alias("at")), functions.select(F.col("id").alias("range_id"), F.col("path").alias("scope"), F.col("line").alias("low"), F.col("end").alias("high")))
    candidates = functions.select("id", "name", F.col("path").alias("scope"), "ord")
    resolved = link.resolve_names(calls.select("use_id", "name", F.col("path").alias("scope"), "local"), candidates)
    stubs = link.stubs(calls, resolved, found.sparkSession.createDataFrame([(x,) for x in BUILTINS], "name string"))
    target = F.when(F.col("target").isNotNull(), F.col("target")).when((F.col("status") == "unresolved") & ~F.col("local") & ~F.col("name").isin(*BUILTINS), F.concat(F.lit("call:"), "name"))
    made = calls.join(resolved, "use_id").join(around.select(F.col("point_id").alias("use_id"), "range_id"), "use_id").withColumns({"caller": F.coalesce("range_id", file_id), "callee": target}).where("callee IS NOT NULL AND caller <> callee")
    edges.append(edge(made.groupBy("caller", "callee").agg(F.min("ord").alias("ord")), F.col("caller"), F.col("callee"), "CALLS"))
    nodes.append(stubs.select("id", F.lit("function").alias("type"), "name", F.create_map(F.lit("external"), F.lit("true")).alias("attrs")))

    # Imports: candidate paths in order of preference, met by equality with the listing.
    imports = of("import").withColumn("spec", F.col("name"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    dotted = F.regexp_replace(F.regexp_replace("spec", "^[.]+", ""), "[.]|::", "/")
    relative = F.when(F.col("spec").startswith("./"), F.concat(folder, F.substring("spec", 3, 1 << 20))).when(F.col("spec").startswith("../"), F.concat(F.regexp_replace(folder, "[^/]*/$", ""), F.substring("spec", 4, 1 << 20)))
    python_relative = F.when(F.col("spec").rlike(r"^\.[^./]"), F.concat(folder, dotted)).when(F.col("spec").rlike(r"^\.\.[^./]"), F.concat(F.regexp_replace(folder, "[^/]*/$", ""), dotted))
    bases = F.array_compact(F.array(relative, python_relative, dotted, F.concat(folder, dotted), F.concat(F.lit("src/"), dotted), F.concat(F.lit("src/main/java/"), dotted)))
    ends = ["", *(f".{x}" for x in CODE), "/index.ts", "/index.js", "/__init__.py", "/mod.rs"]
    tried = imports.select("path", "spec", "ord", a["member"].alias("member"), F.posexplode(F.flatten(F.transform(bases, lambda b: F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat(b, e))))).alias("rank", "candidate"))
    met = tried.join(head.select(F.col("path").alias("candidate"), F.col("id").alias("target")), "candidate").groupBy("path", "spec").agg(F.min_by("target", "rank").alias("target"))
    specs = imports.groupBy("path", "spec").agg(F.min("ord").alias("ord"), F.min(F.coalesce(a["member"], F.lit("false"))).alias("member")).join(met, ["path", "spec"], "left")
    kept = specs.where("target IS NOT NULL OR member = 'false'").withColumn("to", F.coalesce("target", F.concat(F.lit("import:"), "spec"))).where(file_id != F.col("to"))
    edges.append(edge(kept.groupBy("path", "to").agg(F.min("ord").alias("ord")), file_id, F.col("to"), "IMPORTS"))
    nodes.append(kept.where("target IS NULL").select(F.col("to").alias("id"), F.lit("component").alias("type"), F.col("spec").alias("name"), F.create_map(F.lit("external"), F.lit("true")).alias("attrs")).dropDuplicates(["id"]))

    # Routes: the last handler that resolves handles, those before it are middleware.
    routes = of("route").withColumn("id", F.concat_ws(":", F.lit("route"), "path", F.when(a["method"] == "", "ANY").otherwise(a["method"]), F.col("line").cast("string"), F.col("ord").cast("string")))
    nodes.append(routes.select("id", F.lit("route").alias("type"), "name", F.map_concat(F.map_filter(a, lambda k, _: k != "handlers"), F.create_map(F.lit("file"), F.col("path"), F.lit("line_start"), F.col("line").cast("string"))).alias("attrs")))
    edges.append(edge(routes, F.col("id"), file_id, "BELONGS_TO"))
    handlers = routes.select("id", "path", "ord", F.posexplode(F.split(a["handlers"], " ")).alias("pos", "name")).where("name <> ''").withColumns({"name": F.element_at(F.split("name", "[.]"), -1), "use_id": F.xxhash64("id", "pos")})
    named = handlers.join(link.resolve_names(handlers.select("use_id", "name", F.col("path").alias("scope"), F.lit(False).alias("local")), candidates).where("target IS NOT NULL"), "use_id")
    last = named.groupBy("id").agg(F.max("pos").alias("last"))
    wired = named.join(last, "id")
    edges.append(edge(wired.where("pos = last"), F.col("id"), F.col("target"), "HANDLED_BY"))
    edges.append(edge(wired.where("pos < last"), F.col("id"), F.col("target"), "USES_MIDDLEWARE", F.create_map(F.lit("order"), F.col("pos").cast("string"))))

    # Client calls: containment first, then the one best route.
    clients = of("client").withColumn("url", client_path(F.col("name"))).where(F.col("url").startswith("/")).select(F.xxhash64("path", "ord").alias("call_id"), F.col("path").alias("file"), F.coalesce(a["method"], F.lit("")).alias("method"), F.regexp_replace("url", "[?].*$", "").alias("path"), F.lit(False).alias("relative"), "line", "ord")
    offered = routes.select(F.col("id").alias("route_id"), F.col("path").alias("file"), a["method"].alias("method"), F.regexp_replace(F.regexp_replace(a["path"], r"[{<][^}>]*[}>]", ":param"), "/$", "").alias("path"))
    hits = link.route_matches(clients.drop("line", "ord"), offered).join(clients.select("call_id", "file", "line", "ord", F.col("path").alias("url")), "call_id")
    inside = link.innermost(hits.select(F.col("call_id").alias("point_id"), F.col("file").alias("scope"), F.col("line").alias("at")), functions.select(F.col("id").alias("range_id"), F.col("path").alias("scope"), F.col("line").alias("low"), F.col("end").alias("high")), True)
    hits = hits.join(inside.select(F.col("point_id").alias("call_id"), "range_id"), "call_id").withColumn("caller", F.coalesce("range_id", F.concat(F.lit("file:"), "file")))
    first = hits.groupBy("caller", "route_id").agg(F.min_by(F.struct("url", "line"), "ord").alias("at"), F.min("ord").alias("ord"))
    edges.append(edge(first, F.col("caller"), F.col("route_id"), "CALLS_ENDPOINT", F.create_map(F.lit("path"), F.col("at.url"), F.lit("line"), F.col("at.line").cast("string"))))

    # Models, and references that their fields' names imply.
    models = of("model").withColumn("id", F.concat_ws(":", F.lit("model"), "path", "name")).dropDuplicates(["id"])
    nodes.append(models.select("id", F.lit("model").alias("type"), "name", extra(file=F.col("path"), line_start=F.col("line")).alias("attrs")))
    edges.append(edge(models, F.col("id"), file_id, "BELONGS_TO"))
    fields = models.select(F.col("id").alias("model"), F.explode(F.split(a["fields"], ", ")).alias("field")).withColumn("field", F.regexp_replace("field", "→.*$", ""))
    implied = link.infer_references(fields, models.select("id", "name"), found.sparkSession.createDataFrame([], "src string, dst string"))
    edges.append(edge(implied.withColumn("ord", F.lit(0)), F.col("src"), F.col("dst"), "REFERENCES", F.create_map(F.lit("foreign_key"), F.col("field"), F.lit("inferred"), F.lit("true"))))

    # Documents and the symbols they name; styles by shared tokens.
    docs = of("doc").withColumn("id", F.concat(F.lit("doc:"), "path"))
    nodes.append(docs.select("id", F.lit("file").alias("type"), F.concat("name", F.lit(" (doc)")).alias("name"), extra(file=F.col("path"), doc=F.lit("true")).alias("attrs")))
    edges.append(edge(docs, F.col("id"), file_id, "BELONGS_TO"))
    names = definitions.select("id", "name", F.lit(0).alias("rank")).unionByName(functions.select("id", "name", F.lit(1).alias("rank")))
    mentions = link.mention_targets(of("token").select(F.concat(F.lit("doc:"), "path").alias("doc"), F.col("name").alias("token")), head.select("id", "path"), names)
    edges.append(edge(mentions.select("doc", "target").distinct().withColumn("ord", F.lit(0)), F.col("doc"), F.col("target"), "MENTIONS"))
    sources = files.where(F.col("path").rlike(r"\.(html?|vue|svelte|[jt]sx?|css|scss|less)$") & (F.col("size") <= 1 << 20))
    used = sources.select(F.col("path").alias("file"), F.explode(style_uses(F.decode("content", "UTF-8"))).alias("token"))
    styled = link.style_links(used, sheets.select(F.col("path").alias("file"), F.explode("tokens").alias("token")))
    edges.append(edge(styled.withColumn("ord", F.lit(0)), F.concat(F.lit("file:"), "file"), F.concat(F.lit("file:"), "css"), "USES_STYLE", F.create_map(F.lit("selectors"), F.col("selectors"))))

    all_nodes, all_edges = nodes[0], edges[0]
    for n in nodes[1:]:
        all_nodes = all_nodes.unionByName(n)
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    return Graph(written(all_nodes, "nodes"), written(all_edges, "edges"), source)
