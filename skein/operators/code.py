"""Questions about code beside calls and routes: companions, callers, state, comments, snippets, specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import link
from skein.shared import written

#: A snippet's most lines and bytes, and the mark of one that was cut.
SNIPPET_LINES, SNIPPET_BYTES, CUT = 15, 800, "…"


def generated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes that are marked as generated or that something generates."""
    marked = nodes.where("attrs['generated'] = 'true'").select("id")
    return marked.unionByName(edges.where("type = 'GENERATES'").select(F.col("dst").alias("id"))).distinct()


def companions(pairs: DataFrame, most: int = 10) -> DataFrame:
    """(id, other, count, place): what changed together with each item most often; pairs (a, b, count) in either direction."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "count").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "count"))
    w = Window.partitionBy("id").orderBy(F.desc("count"), "other")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def current_callers(edges: DataFrame, most: int = 8) -> DataFrame:
    """(id, n, callers): how many distinct sources call each node, and the first of them in order."""
    calls = edges.where("type = 'CALLS'").select(F.col("dst").alias("id"), "src").distinct()
    w = Window.partitionBy("id").orderBy("src")
    first = calls.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).groupBy("id").agg(F.array_sort(F.collect_list("src")).alias("callers"))
    return calls.groupBy("id").agg(F.count("*").alias("n")).join(first, "id")


def relinked(stale: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, target): the one live function (id, file, name) that a stale id `func:file:name:line` can mean."""
    parts = F.split("id", ":")
    asked = stale.select("id").distinct().where((F.size(parts) == 4) & (parts[0] == "func")).select(F.col("id").alias("stale"), parts[1].alias("file"), parts[2].alias("name"))
    unique = functions.groupBy("file", "name").agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1")
    return asked.join(unique, ["file", "name"]).select(F.col("stale").alias("id"), "target")


def route_models(handled: DataFrame, calls: DataFrame, files: DataFrame, imports: DataFrame, models: DataFrame, depth: int = 3) -> DataFrame:
    """(route, model): models in the files that a route's handler reaches by calls, or in files that these import.

    handled (route, id); calls (a, b); files (id, file) of functions; imports (file, to_file);
    models (model, file). Calls are followed for depth levels, and the files of all but the last count.
    """
    seen = written(handled.select("route", "id").distinct().withColumn("level", F.lit(0)), "handlers")
    for level in range(1, depth):
        edge = seen.where(F.col("level") == level - 1).select("route", F.col("id").alias("a"))
        more = calls.join(edge, "a").select("route", F.col("b").alias("id")).distinct().join(seen.select("route", "id"), ["route", "id"], "left_anti")
        seen = seen.unionByName(written(more.withColumn("level", F.lit(level)), "handlers"))
    own = seen.join(files, "id").select("route", "file").distinct()
    near = own.unionByName(own.join(imports, "file").select("route", F.col("to_file").alias("file"))).distinct()
    return near.join(models, "file").select("route", "model").distinct()


def state_access(accesses: DataFrame, bindings: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, state, kind): functions that read or write imported state.

    accesses (access_id, file, name, line, kind); bindings (file, name, state): names that a file
    imports; functions (id, file, low, high). An access outside all functions, or of a name that is not imported, is none.
    """
    bound = accesses.join(bindings, ["file", "name"])
    around = link.innermost(bound.select(F.col("access_id").alias("point_id"), F.col("file").alias("scope"), F.col("line").cast("long").alias("at")), functions.select(F.col("id").alias("range_id"), F.col("file").alias("scope"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")), True)
    return bound.join(around.where("range_id IS NOT NULL"), F.col("access_id") == F.col("point_id")).select(F.col("range_id").alias("id"), "state", "kind").distinct()


def merged_comments(comments: DataFrame, consumed: DataFrame) -> DataFrame:
    """(file, line, end, text): comments (file, line, end, text) put together where one begins on the line after another, or on its last.

    consumed (file, line): lines that already belong to a declaration; comments with such a line are left out.
    """
    taken = consumed.select("file", F.col("line").alias("at")).distinct()
    touched = comments.select("file", "line", F.explode(F.sequence("line", "end")).alias("at")).join(taken, ["file", "at"], "left_semi").select("file", "line").distinct()
    left = comments.join(touched, ["file", "line"], "left_anti")
    w = Window.partitionBy("file").orderBy("line", "end")
    begins = F.coalesce((F.col("line") - F.lag("end").over(w) > 1).cast("int"), F.lit(1))
    groups = left.withColumn("begins", begins).withColumn("part", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return groups.groupBy("file", "part").agg(F.min("line").alias("line"), F.max("end").alias("end"), lines.alias("text")).drop("part")


def spec_handlers(endpoints: DataFrame, routes: DataFrame) -> DataFrame:
    """(endpoint, handler) of equal method and path: endpoints (endpoint, method, path), routes (handler, method, path)."""
    key = [F.upper("method").alias("m"), F.col("path").alias("p")]
    return endpoints.select("endpoint", *key).join(routes.select("handler", *key), ["m", "p"]).select("endpoint", "handler").distinct()


def spec_types(schemas: DataFrame, types: DataFrame) -> DataFrame:
    """(schema, type): schemas (schema, name) met by the last part of their dotted name with types (type, package, name).

    The only type of that name is taken; of several those whose package ends the schema's own.
    """
    last = F.element_at(F.split("full", "[.]"), -1)
    asked = schemas.select("schema", F.col("name").alias("full")).withColumn("name", last)
    each = types.groupBy("name").agg(F.count("*").alias("n"))
    fits = F.concat(F.lit("."), "full").endswith(F.concat(F.lit("."), F.regexp_replace("package", "/", "."), F.lit("."), "name"))
    return asked.join(types, "name").join(each, "name").where((F.col("n") == 1) | fits).select("schema", "type").distinct()


def namespace_calls(calls: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(caller, target): calls (caller, file, namespace, member) through an import (file, namespace, to_file) of a file that exports (file, name, target)."""
    there = calls.join(imports, ["file", "namespace"]).select("caller", F.col("to_file").alias("file"), F.col("member").alias("name"))
    return there.join(exports, ["file", "name"]).select("caller", "target").distinct()


def snippets(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, text): a function's stored body, else its lines (path, line, text) cut to a size, with a mark if so.

    functions (id, path, body, low, high).
    """
    stored = functions.where("body IS NOT NULL").select("id", F.col("body").alias("text"))
    asked = functions.where("body IS NULL").select("id", "path", "low", "high", F.least("high", F.col("low") + SNIPPET_LINES - 1).alias("until"))
    wanted = asked.select("id", "path", "low", "high", "until", F.explode(F.sequence("low", "until")).alias("line"))
    found = wanted.join(lines, ["path", "line"]).groupBy("id", "high", "until").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("whole"))
    cut = F.substring("whole", 1, SNIPPET_BYTES)
    return stored.unionByName(found.select("id", F.concat(cut, F.when((F.col("high") > F.col("until")) | (cut != F.col("whole")), "\n" + CUT).otherwise("")).alias("text")))


def verb_prefix(name: Column) -> Column:
    """The HTTP verb that a camelCase name starts with, in capitals; else empty."""
    return F.upper(F.regexp_extract(name, "^(get|post|put|patch|delete|head)(?=[A-Z])", 1))
