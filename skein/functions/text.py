"""Column functions for paths, stylesheets, markup and documentation tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Method names that are no symbols.
HTTP_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
#: Ends of generated files' names, and marks in their first 2048 bytes.
GENERATED_NAMES = (".pb.go", "_grpc.pb.go", ".gen.go", "_generated.go", ".generated.ts")
GENERATED_MARKS = ("DO NOT EDIT", "@generated")


def client_path(raw: Column) -> Column:
    """The path of a quoted request URL: holes become :param, scheme and host go.

    Text before the first quote is dropped, so an unquoted argument is empty.
    """
    s = F.regexp_replace(raw, "(?s)^[^\"'`]*", "")
    s = F.regexp_replace(s, "^[\"'`]+|[\"'`]+$", "")
    for hole in (r"(?s)\$\{.*?\}", r"(?s)\{.*?\}", r"(?s)\\\(.*?\)", r"\$[A-Za-z_]\w*", "%[sdvxf]"):
        s = F.regexp_replace(s, hole, ":param")
    at = F.locate("://", s)
    rest = F.substr(s, at + 3)
    slash = F.locate("/", rest)
    s = F.when((at >= 1) & (at <= 13), F.when(slash > 0, F.substr(rest, slash)).otherwise("/")).otherwise(s)
    return F.regexp_replace(s, "^:param/", "/")


def is_rooted_path(path: Column) -> Column:
    return path.startswith("/") & ~path.startswith("//") & (F.length(path) > 1) & ~path.rlike("[ \t\n]")


def is_client_path(path: Column, relative: bool = False) -> Column:
    """A rooted path; or, where relative ones are taken, two or more clean segments without a dot."""
    ok = is_rooted_path(path)
    return ok | path.rlike(r"^[A-Za-z0-9_:-]+(/[A-Za-z0-9_:-]+)+/?$") if relative else ok


def unquoted(x: Column) -> Column:
    return F.substr(x, F.lit(2), F.length(x) - 2)


def attributes(source: Column) -> Column:
    """(name, value) of everything of the form name="value", names in lower case."""
    form = F.lit(r"""([A-Za-z_][-\w:]*)\s*=\s*("[^"]*"|'[^']*')""")
    both = F.arrays_zip(F.regexp_extract_all(source, form, F.lit(1)).alias("name"), F.regexp_extract_all(source, form, F.lit(2)).alias("value"))
    return F.transform(both, lambda x: F.struct(F.lower(x["name"]).alias("name"), unquoted(x["value"]).alias("value")))


def quoted_calls(source: Column) -> Column:
    """(name, value) of calls whose first argument is a quoted string; name is the dotted path that is called."""
    form = F.lit(r"""([\w$.]+)\s*\(\s*("[^"\n]*"|'[^'\n]*')""")
    both = F.arrays_zip(F.regexp_extract_all(source, form, F.lit(1)).alias("name"), F.regexp_extract_all(source, form, F.lit(2)).alias("value"))
    return F.transform(both, lambda x: F.struct(x["name"].alias("name"), unquoted(x["value"]).alias("value")))


def is_symbol(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z_][-\w]*$")


def simple_selectors(prelude: Column) -> Column:
    """What a selector names: .class, #id, [data-x]; other parts of it are passed over."""
    form = F.lit(r"([.#\[])\s*([A-Za-z_][-\w]*)")
    both = F.arrays_zip(F.regexp_extract_all(prelude, form, F.lit(1)).alias("mark"), F.regexp_extract_all(prelude, form, F.lit(2)).alias("name"))
    named = F.filter(both, lambda x: (x["mark"] != "[") | x["name"].startswith("data-"))
    return F.transform(named, lambda x: F.concat(x["mark"], x["name"], F.when(x["mark"] == "[", "]").otherwise("")))


def css_selectors(css: Column) -> Column:
    """Sorted distinct tokens that a stylesheet defines: .class, #id, [data-x] in selectors, --variables in declarations.

    What stands before an opening brace, back to the brace or semicolon before it, is a
    selector; what starts with two hyphens behind one of these, up to a colon, declares a variable.
    """
    text = F.array_join(F.transform(F.split(css, r"/\*"), lambda x, i: F.when(i == 0, x).otherwise(F.substr(x, F.locate("*/", x) + F.when(F.locate("*/", x) > 0, 2).otherwise(F.length(x) + 1)))), " ")
    heads = F.transform(F.split(text, r"\{"), lambda x: F.element_at(F.split(x, "[;}]"), -1))
    selectors = F.flatten(F.transform(F.slice(heads, 1, F.size(heads) - 1), simple_selectors))
    declared = F.filter(F.transform(F.split(text, "[{};]"), F.trim), lambda x: x.rlike(r"^\s*--[A-Za-z][-\w]*\s*:"))
    variables = F.transform(declared, lambda x: F.regexp_replace(F.substring_index(x, ":", 1), r"\s+", ""))
    return F.array_sort(F.array_distinct(F.concat(selectors, variables)))


def style_uses(source: Column) -> Column:
    """Sorted distinct selector tokens that markup or code refers to.

    Of attributes: the words of class, id, the names of data-*, values that are #id. Of calls
    with a quoted argument: names of classes for classList's methods, ids, data-* attributes, selectors.
    Then members of dataset, and variables in var().
    """
    attrs, calls = attributes(source), quoted_calls(source)
    value = lambda xs: F.transform(xs, lambda x: x["value"])
    of = lambda xs, *names: value(F.filter(xs, lambda x: x["name"].isin(*names)))
    called = lambda end: value(F.filter(calls, lambda x: F.concat(F.lit("."), x["name"]).endswith("." + end)))
    lists = value(F.filter(calls, lambda x: x["name"].contains("classList.")))
    classes = F.filter(F.concat(F.flatten(F.transform(of(attrs, "class", "classname"), lambda x: F.split(x, r"\s+"))), lists), is_symbol)
    anchors = F.transform(F.filter(F.concat(value(attrs), value(calls)), lambda x: x.startswith("#")), lambda x: F.substr(x, F.lit(2)))
    ids = F.filter(F.concat(of(attrs, "id"), called("getElementById"), anchors), is_symbol)
    data = F.filter(F.concat(F.transform(attrs, lambda x: x["name"]), called("setAttribute")), lambda x: x.rlike("^data-[-a-z0-9_]+$"))
    members = F.transform(F.regexp_extract_all(source, F.lit(r"dataset\.([a-z]\w*)"), F.lit(1)), lambda x: F.concat(F.lit("data-"), F.lower(F.regexp_replace(x, "(?=[A-Z])", "-"))))
    chosen = F.flatten(F.transform(F.concat(called("querySelector"), called("querySelectorAll"), called("closest"), called("matches")), simple_selectors))
    variables = F.regexp_extract_all(source, F.lit(r"var\s*\(\s*(--[-\w]+)"), F.lit(1))
    mark = lambda xs, before, after="": F.transform(xs, lambda x: F.concat(F.lit(before), x, F.lit(after)))
    return F.array_sort(F.array_distinct(F.concat(mark(classes, "."), mark(ids, "#"), mark(F.concat(data, members), "[", "]"), chosen, variables)))


def script_bodies(html: Column) -> Column:
    """Bodies of the inline scripts of a page: none with src=, none of a type that isn't JavaScript."""
    rest = F.split(html, r"(?i)<script(?=[\s>/])")
    # Of what follows each opening: its attributes up to the bracket, and the text up to its end, if it has one.
    cut = F.transform(F.slice(rest, 2, 1 << 30), lambda x: F.struct(F.substring_index(x, ">", 1).alias("head"), F.split(F.substr(x, F.locate(">", x) + 1), r"(?i)</script\s*>", 2).alias("body")))
    kind = lambda x: F.coalesce(F.try_element_at(F.transform(F.filter(attributes(x["head"]), lambda y: y["name"] == "type"), lambda y: F.lower(y["value"])), F.lit(1)), F.lit(""))
    inline = F.filter(cut, lambda x: (F.size(x["body"]) > 1) & ~x["head"].rlike(r"(?i)(^|[\s\"'])src\s*=") & ((kind(x) == "") | (kind(x) == "module") | kind(x).contains("javascript")))
    return F.transform(inline, lambda x: F.element_at(x["body"], 1))


def attribute_links(html: Column, names: tuple[str, ...]) -> Column:
    """(name, value, line) of quoted attributes, in order; line counts from 1."""
    pattern = rf"(?i)\b({'|'.join(names)})\s*=\s*[\"']([^\"']*)[\"']"
    lines = F.split(html, "\n")
    per_line = lambda line, i: F.transform(
        F.arrays_zip(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(line, F.lit(pattern), F.lit(2)).alias("v")),
        lambda x: F.struct(F.lower(x["n"]).alias("name"), x["v"].alias("value"), (i + 1).alias("line")),
    )
    return F.flatten(F.transform(lines, per_line))


def doc_tokens(text: Column, mark: str = "`") -> Column:
    """Tokens between marks on one line that look like symbols; a trailing () goes."""
    found = F.regexp_extract_all(text, F.lit(f"{mark}([^{mark}\n]{{1,80}}){mark}"), F.lit(1))
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"\(\)$", ""))
    return F.filter(bare, lambda x: x.rlike(r"^[A-Za-z_][\w./-]*$") & ~x.endswith("/") & ~x.isin(*HTTP_VERBS) & ~(x.contains("_") & (x == F.upper(x))))


def is_generated(path: Column, content: Column) -> Column:
    """Whether a file's name or its first 2048 characters say that it is generated."""
    by_name = path.rlike("(" + "|".join(x.replace(".", r"\.") for x in GENERATED_NAMES) + ")$")
    head = F.substring(content, 1, 2048)
    return by_name | head.contains(GENERATED_MARKS[0]) | head.contains(GENERATED_MARKS[1])


def check_enums(ddl: Column) -> Column:
    """(column, values) of single-column CHECK (col IN (...)) constraints in a table's definition."""
    pattern = r"(?i)CHECK\s*\(\s*[\"`\[]?(\w+)[\"`\]]?\s+IN\s*\(([^)]*)\)\s*\)"
    both = F.arrays_zip(F.regexp_extract_all(ddl, F.lit(pattern), F.lit(1)).alias("c"), F.regexp_extract_all(ddl, F.lit(pattern), F.lit(2)).alias("v"))
    return F.transform(both, lambda x: F.struct(F.lower(x["c"]).alias("column"), F.array_join(F.transform(F.split(x["v"], ","), lambda v: F.regexp_replace(F.trim(v), "^['\"]|['\"]$", "")), ", ").alias("values")))


def join_capped(items: Column, most: int, separator: str = ", ") -> Column:
    """The first items of an array joined, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), separator), F.when(more > 0, F.concat(F.lit(" … +"), more.cast("string"), F.lit(" more"))).otherwise(""))
