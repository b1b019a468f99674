"""Link resolution: joins with uniqueness guards. No edge is better than a wrong one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.shared import written

#: Baskets and bands of co-change mining.
CO_CHANGE = {"least_basket": 2, "most_basket": 20, "least_count": 3, "high_count": 5, "high": 0.7, "medium": 0.4}


def resolve_names(uses: DataFrame, candidates: DataFrame) -> DataFrame:
    """(use_id, target, status) for uses (use_id, name, scope, local) and candidates (id, name, scope, ord).

    A candidate of the use's own scope wins, the first by ord; else a use that
    isn't local takes the only candidate there is. status: resolved, ambiguous, unresolved.
    """
    named = candidates.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    near = candidates.groupBy("name", "scope").agg(F.min_by("id", "ord").alias("near"))
    rows = uses.join(near, ["name", "scope"], "left").join(named, "name", "left")
    target = F.when(F.col("near").isNotNull(), F.col("near")).when(~F.col("local") & (F.col("n") == 1), F.col("only"))
    status = F.when(target.isNotNull(), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return rows.select("use_id", target.alias("target"), status.alias("status"))


def stubs(uses: DataFrame, resolved: DataFrame, builtins: DataFrame) -> DataFrame:
    """(id, name): one external stub for each unresolved name that is neither local nor built in."""
    open_ = uses.join(resolved.where("status = 'unresolved'"), "use_id").where("NOT local")
    names = open_.select("name").distinct().join(builtins, "name", "left_anti")
    return names.select(F.concat(F.lit("call:"), "name").alias("id"), "name")


def innermost(points: DataFrame, ranges: DataFrame, contained_first: bool = False) -> DataFrame:
    """(point_id, range_id) of the range around each point; points (point_id, scope, at), ranges (range_id, scope, low, high).

    By default the range with the greatest start at or before the point is
    taken, and dropped if it has ended (a point after an inner range has none);
    contained_first drops ended ranges before the choice. An as-of search: ranges
    and points of a scope are sorted together and the start is carried on, so no
    pair is formed.
    """
    if contained_first:
        return containing(points, ranges)
    marks = ranges.select("scope", F.col("low").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("point_id"), F.struct("low", "range_id", "high").alias("range"))
    asks = points.select("scope", "at", F.lit(1).alias("side"), "point_id", F.lit(None).cast(marks.schema["range"].dataType).alias("range"))
    w = Window.partitionBy("scope").orderBy("at", "side", F.col("range.range_id")).rowsBetween(Window.unboundedPreceding, 0)
    carried = marks.unionByName(asks).withColumn("last", F.last("range", ignorenulls=True).over(w)).where("side = 1")
    return carried.select("point_id", F.when(F.col("last.high") >= F.col("at"), F.col("last.range_id")).alias("range_id"))


def containing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(point_id, range_id) of the range of the greatest (low, range_id) that holds each point.

    A range longer than half of 2**k, and not longer than that, lies in one or two cells of
    that size. In a half of a cell it has only one end: it holds the points from its start on,
    or those up to its end. So in each half the best start of the ranges from the left, and of those
    from the right, is carried along in order, and no pair of a range and a point is formed.
    """
    size = F.col("high") - F.col("low") + 1
    level = F.when(size == 1, 0).otherwise(F.length(F.bin(size - 1)))
    cut = ranges.where("low <= high").withColumn("level", level).withColumns({"cell": F.array_distinct(F.array(shifted("low", "level"), shifted("high", "level")))}).withColumn("cell", F.explode("cell"))
    cut = cut.withColumn("width", F.expr("shiftleft(1L, level)")).withColumns({"begin": F.col("cell") * F.col("width"), "middle": F.col("cell") * F.col("width") + F.shiftright("width", 1)})
    # Each end of a range within the cell, per half that the range reaches there.
    starts, stops = F.col("low") >= F.col("begin"), F.col("high") < F.col("begin") + F.col("width")
    inner = starts & stops
    pieces = F.filter(F.array(
        F.when(starts & (F.col("low") < F.col("middle")), F.struct(F.lit(0).alias("half"), F.lit("from").alias("kind"), F.col("low").alias("at"))),
        F.when(starts & ~inner, F.struct(F.lit(1).alias("half"), F.lit("from").alias("kind"), F.col("low").alias("at"))),
        F.when(~starts, F.struct(F.lit(0).alias("half"), F.lit("to").alias("kind"), F.col("high").alias("at"))),
        F.when((F.col("high") >= F.col("middle")) & stops, F.struct(F.lit(1).alias("half"), F.lit("to").alias("kind"), F.col("high").alias("at"))),
    ), lambda x: x.isNotNull())
    best = F.struct("low", "range_id")
    marks = cut.select("scope", "level", "cell", F.explode(pieces).alias("p"), best.alias("best")).select("scope", "level", "cell", "p.half", "p.kind", "p.at", "best", F.lit(None).cast("long").alias("point_id"))
    # There are as many levels as bits at most.
    levels = sorted(r.level for r in cut.select("level").distinct().collect())
    if not levels:
        return points.select("point_id", F.lit(None).cast(ranges.schema["range_id"].dataType).alias("range_id"))
    asked = points.select("point_id", "scope", "at", F.explode(F.array(*map(F.lit, levels))).alias("level")).withColumn("cell", shifted("at", "level"))
    half = F.when(F.col("level") == 0, 1).otherwise(F.expr("shiftright(at, level - 1)") % 2)
    asked = asked.withColumn("half", F.pmod(half, F.lit(2)).cast("int"))
    both = asked.select("scope", "level", "cell", "half", F.explode(F.array(F.lit("from"), F.lit("to"))).alias("kind"), "at", F.lit(None).cast(marks.schema["best"].dataType).alias("best"), "point_id")
    # Starts are passed from the left, ends from the right; at one place marks come before points.
    line = F.when(F.col("kind") == "from", F.col("at")).otherwise(-F.col("at"))
    w = Window.partitionBy("scope", "level", "cell", "half", "kind").orderBy(line, F.col("point_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    held = marks.unionByName(both).withColumn("held", F.max("best").over(w)).where("point_id IS NOT NULL")
    found = held.groupBy("point_id").agg(F.max("held").alias("best"))
    return points.select("point_id").join(found, "point_id", "left").select("point_id", F.col("best.range_id").alias("range_id"))


def shifted(at: str, level: str) -> Column:
    """The cell of 2**level places that holds a place."""
    return F.expr(f"shiftright(CAST({at} AS BIGINT), {level})")


def co_change(baskets: DataFrame, **limits) -> DataFrame:
    """(a, b, count, ratio, band) of items that share baskets (basket, item) often enough.

    Only baskets of a bounded size form pairs, so pairs grow in proportion to the baskets.
    """
    p = CO_CHANGE | limits
    items = baskets.distinct()
    # Sizes are combined before the shuffle, so a huge basket is dropped without being gathered.
    fits = items.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size").between(p["least_basket"], p["most_basket"]))
    fit = items.join(fits, "basket", "left_semi")
    grouped = fit.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pairs = grouped.select(F.explode(F.flatten(F.transform("items", lambda x, i: F.transform(F.slice(F.col("items"), i + 2, p["most_basket"]), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("count")).where(F.col("count") >= p["least_count"])
    each = fit.groupBy("item").agg(F.count("*").alias("n"))
    rows = counts.join(each.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(each.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    ratio = F.col("count") / F.least("na", "nb")
    band = F.when((F.col("count") >= p["high_count"]) & (ratio >= p["high"]), "high").when(ratio >= p["medium"], "medium").otherwise("low")
    return rows.select("a", "b", "count", ratio.alias("ratio"), band.alias("band"))


def infer_references(fields: DataFrame, models: DataFrame, existing: DataFrame) -> DataFrame:
    """(src, dst, field) where a field's name, less its id suffix, names one other model.

    fields (model, field); models (id, name), names compared in PascalCase;
    pairs that are linked already in either direction (existing: src, dst) are left out.
    """
    base = F.when(F.col("field").rlike("^.+Id$"), F.regexp_extract("field", "^(.+)Id$", 1)).when(F.col("field").rlike("^.+_id$"), F.regexp_extract("field", "^(.+)_id$", 1)).when(F.col("field").rlike("^.+ID$"), F.regexp_extract("field", "^(.+)ID$", 1))
    unique = models.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("dst")).where("n = 1").select("name", "dst")
    found = fields.withColumn("name", pascal_case(base)).where("name <> ''").join(unique, "name").where("model <> dst")
    linked = existing.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    rows = found.select(F.col("model").alias("src"), "dst", "field").withColumns({"x": F.least("src", "dst"), "y": F.greatest("src", "dst")})
    return rows.join(linked, ["x", "y"], "left_anti").groupBy("src", "dst").agg(F.min("field").alias("field"))


def pascal_case(text: Column) -> Column:
    parts = F.filter(F.split(text, "[_-]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def associate(assocs: DataFrame, models: DataFrame) -> DataFrame:
    """(src, dst, kind, as) of associations (from_name, to_name, kind, as, ord) whose names are unique among models; the first of equal ones."""
    unique = models.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    rows = assocs.join(unique.select(F.col("name").alias("from_name"), F.col("id").alias("src")), "from_name").join(unique.select(F.col("name").alias("to_name"), F.col("id").alias("dst")), "to_name")
    return rows.groupBy("src", "dst", "kind", "as").agg(F.min("ord").alias("ord"))


def route_matches(calls: DataFrame, routes: DataFrame, least_relative: int = 2) -> DataFrame:
    """(call_id, route_id, score): the one route whose path's tail fits a call's best.

    calls (call_id, file, method, path, relative), routes (route_id, file, method, path).
    Segments are compared from the end over the shorter path; a `:` segment fits
    any. Calls are first reduced to distinct requests. They meet routes by the first literal
    from the end of either: where both have it at one place, the literals are equal; else what
    the one has at the other's place is that literal, a wildcard, or nothing.
    """
    tail = lambda c: F.reverse(path_segments(c))
    distinct = calls.select("method", "path", "file", "relative").distinct().withColumn("tail", tail(F.col("path"))).where(F.size("tail") > 0)
    known = routes.select("route_id", F.col("file").alias("route_file"), F.col("method").alias("route_method"), tail(F.col("path")).alias("route_tail")).where(F.size("route_tail") > 0)
    longest = max(df.agg(F.max(F.size(c)).alias("n")).first().n or 1 for df, c in ((distinct, "tail"), (known, "route_tail")))
    asked = distinct.withColumn("k", F.explode(meeting_keys(F.col("tail"), "call", "route", longest)))
    offered = known.withColumn("k", F.explode(meeting_keys(F.col("route_tail"), "route", "call", longest)))
    met = asked.join(offered, "k").where((F.col("file") != F.col("route_file")) & ((F.col("method") == F.col("route_method")) | (F.coalesce("method", F.lit("")) == "") | (F.coalesce("route_method", F.lit("")) == "")))
    n = F.least(F.size("tail"), F.size("route_tail"))
    fits = F.forall(F.zip_with(F.slice(F.col("tail"), 1, n), F.slice(F.col("route_tail"), 1, n), lambda x, y: (x == y) | x.startswith(":") | y.startswith(":")), lambda ok: ok)
    scored = met.where(fits).withColumn("score", n).where(~F.col("relative") | (F.col("score") >= least_relative))
    best = scored.groupBy("method", "path", "file", "relative").agg(F.max("score").alias("score"))
    top = scored.join(best, ["method", "path", "file", "relative", "score"]).groupBy("method", "path", "file", "relative", "score").agg(F.count_distinct("route_id").alias("n"), F.min("route_id").alias("route_id")).where("n = 1")
    keys = ["method", "path", "file", "relative"]
    return calls.join(top.withColumnsRenamed({k: f"t_{k}" for k in keys}), F.expr(" AND ".join(f"{k} <=> t_{k}" for k in keys))).select("call_id", "route_id", "score")


def meeting_keys(tail: Column, own: str, other: str, longest: int) -> Column:
    """Keys of a path's segments from the end, by which it meets all that may fit it, and each of these once.

    at: the place of its first literal, beyond the longest path if all are wildcards.
    """
    literal = F.transform(F.sequence(F.lit(1), F.size(tail)), lambda i: F.when(~F.element_at(tail, i.cast("int")).startswith(":"), i))
    at = F.coalesce(F.array_min(literal), F.lit(longest + 1))
    word = F.try_element_at(tail, at)
    seen = lambda i: F.when(i > F.size(tail), "/short").when(F.element_at(tail, F.least(i, F.size(tail)).cast("int")).startswith(":"), "/any").otherwise(F.element_at(tail, F.least(i, F.size(tail)).cast("int")))
    key = lambda first, a, b, x: F.concat_ws(" ", F.lit(first), a.cast("string"), b.cast("string"), x)
    same = F.array(key("both", at, at, F.coalesce(word, F.lit("/none"))))
    # The other's first literal is further on: what this one has there.
    later = F.transform(F.filter(F.sequence(F.lit(1), F.lit(longest + 1)), lambda i: i > at), lambda i: key(own, at, i, F.when(i > longest, "/none").otherwise(seen(i))))
    # This one's is further on: the other may have the same there, a wildcard, or nothing.
    before = F.filter(F.sequence(F.lit(1), F.lit(longest + 1)), lambda i: i < at)
    sooner = F.flatten(F.transform(before, lambda i: F.when(at > longest, F.array(key(other, i, at, F.lit("/none")))).otherwise(F.array(*[key(other, i, at, x) for x in (F.coalesce(word, F.lit("/none")), F.lit("/any"), F.lit("/short"))]))))
    return F.concat(same, later, sooner)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def mention_targets(tokens: DataFrame, files: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(doc, token, target, tier): what a document's token refers to.

    tokens (doc, token); files (id, path); names (id, name, rank): rank 0 for
    definitions, 1 for functions. Tiers: exact path, path suffix, name by rank;
    the first tier with a hit decides, and more than `most` targets are none.
    Suffixes are exploded and met by equality.
    """
    asked = tokens.distinct()
    exact = asked.join(files.select(F.col("path").alias("token"), F.col("id").alias("target")), "token").withColumn("tier", F.lit(0))
    parts = F.split("path", "/")
    suffixes = files.where(F.size(parts) > 1).select(F.col("id").alias("target"), F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1 << 20), "/"))).alias("token"))
    suffix = asked.where(F.col("token").rlike("[/.]")).join(suffixes, "token").withColumn("tier", F.lit(1))
    name = asked.where(~F.col("token").rlike("[/.]")).join(names.select(F.col("name").alias("token"), F.col("id").alias("target"), "rank"), "token").withColumn("tier", F.col("rank") + 2).drop("rank")
    found = exact.unionByName(suffix).unionByName(name)
    best = found.groupBy("doc", "token").agg(F.min("tier").alias("tier"))
    hits = found.join(best, ["doc", "token", "tier"]).distinct()
    few = hits.groupBy("doc", "token").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("doc", "token")
    return hits.join(few, ["doc", "token"]).select("doc", "token", "target", "tier")


def style_links(uses: DataFrame, defs: DataFrame, most: int = 3, width: int = 200) -> DataFrame:
    """(file, css, selectors): one link for each file and stylesheet that defines tokens it uses.

    uses and defs are (file, token); tokens with more than `most` stylesheets say nothing.
    """
    known = defs.distinct().groupBy("token").agg(F.count("*").alias("n"), F.collect_set("file").alias("css")).where(F.col("n") <= most)
    rows = uses.distinct().join(known.select("token", F.explode("css").alias("css")), "token").where("file <> css")
    return rows.groupBy("file", "css").agg(F.substring(F.array_join(F.array_sort(F.collect_set("token")), ","), 1, width).alias("selectors"))


def dispatch_links(registrations: DataFrame, triggers: DataFrame) -> DataFrame:
    """(caller_id, target): triggers (caller_id, key, ord) joined to the first registration (key, target, ord) of their key; not to themselves."""
    first = registrations.groupBy("key").agg(F.min_by("target", "ord").alias("target"))
    return triggers.join(first, "key").where("caller_id <> target").select("caller_id", "target", "ord")


def resolve_exports(exports: DataFrame, rounds: int = 5) -> DataFrame:
    """(file, name, target_file, target_name): what each exported name finally is.

    exports (file, name, source_file, source_name, star): a row without source is
    defined here; star passes on every name of its source. Names a file already
    has win over later rounds; the least target is taken of several in one round.
    """
    named = exports.where("NOT star AND source_file IS NOT NULL").select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.col("source_file").alias("file"), F.col("source_name").alias("name"))
    stars = exports.where("star").select(F.col("file").alias("to_file"), F.col("source_file").alias("file"))
    known = written(exports.where("NOT star AND source_file IS NULL").select("file", "name", F.col("file").alias("target_file"), F.col("name").alias("target_name")).distinct(), "exports")
    for _ in range(rounds):
        a = known.join(named, ["file", "name"]).select(F.col("to_file").alias("file"), F.col("to_name").alias("name"), "target_file", "target_name")
        b = known.join(stars, "file").select(F.col("to_file").alias("file"), "name", "target_file", "target_name")
        more = a.unionByName(b).groupBy("file", "name").agg(F.min(F.struct("target_file", "target_name")).alias("t"))
        more = written(more.join(known, ["file", "name"], "left_anti").select("file", "name", "t.target_file", "t.target_name"), "exports")
        if not more.limit(1).count():
            break
        known = known.unionByName(more)
    return known


def shared_state(accesses: DataFrame, most: int = 6) -> DataFrame:
    """(id, state, kind, n_others, others): of each function and state it touches, how many others read or write it, and the first of them.

    accesses (id, state, kind). A state and kind make a class; its size and its first members are
    found once and looked up by each member, so a state that all functions touch costs each of them one row.
    """
    every = accesses.distinct()
    w = Window.partitionBy("state", "kind").orderBy("id")
    sizes = every.groupBy("state", "kind").agg(F.count("*").alias("n"))
    first = every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most + 1).groupBy("state", "kind").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = sizes.join(first, ["state", "kind"])
    own = every.groupBy("id", "state").agg(F.collect_set("kind").alias("kinds"))
    rows = own.join(classes, "state").withColumn("n_others", F.col("n") - F.array_contains("kinds", F.col("kind")).cast("long")).where("n_others > 0")
    return rows.select("id", "state", "kind", "n_others", F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, most).alias("others"))


def sibling_copies(files: DataFrame) -> DataFrame:
    """(basename, hash, n, distinct_hashes): copies of each basename by content; identical ones share a hash.

    Returned by class instead of by pair: files of a class are copies of each
    other, those of other classes of the basename have diverged.
    """
    by = files.groupBy("basename", "hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    total = files.groupBy("basename").agg(F.count("*").alias("all_n"), F.count_distinct("hash").alias("distinct_hashes"))
    return by.join(total, "basename").where("all_n > 1").select("basename", "hash", "n", "first_id", (F.col("n") - 1).alias("identical"), (F.col("all_n") - F.col("n")).alias("diverged"))
