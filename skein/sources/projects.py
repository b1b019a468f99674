"""Projects of a source tree, and the overlay files that people write for it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manifests that make a folder a project, the first one counts.
MANIFESTS = ("go.mod", "package.json", "pyproject.toml", "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts")


def detect_projects(files: DataFrame) -> DataFrame:
    """(folder, manifest) of the folders of (path) that hold one; the root is a project in any case."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*map(F.lit, MANIFESTS)), name)
    rank = F.when(rank > 0, rank).when(name.endswith(".csproj"), len(MANIFESTS) + 1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    found = files.select(folder.alias("folder"), name.alias("name"), rank.alias("rank")).where("rank IS NOT NULL")
    best = found.groupBy("folder").agg(F.min(F.struct("rank", "name")).alias("best")).select("folder", F.col("best.name").alias("manifest"))
    root = files.sparkSession.createDataFrame([("", "")], "folder string, manifest string")
    return best.unionByName(root.join(best.select("folder"), "folder", "left_anti"))


def nearest_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, folder): the project of the innermost folder around each file, met by equality of its folders."""
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"))
    found = above.join(projects.select("folder"), "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return found


def strip_jsonc(text: str) -> str:
    """JSON without // comments and trailing commas; strings stay as they are."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside:
            out.append(text[i : i + 2] if c == "\\" else c)
            inside = c != '"'
            i += 2 if c == "\\" else 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif c == "," and text[i + 1 :].lstrip()[:1] in ("}", "]"):
            i += 1
        else:
            inside = c == '"'
            out.append(c)
            i += 1
    return "".join(out)


def overlay(spark: SparkSession, definitions: str = "{}", relations: str = "{}") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the overlay texts: definitions as {name: text}, features as {name: [files]}, generates as {file: [files]}."""
    own, linked = json.loads(strip_jsonc(definitions)), json.loads(strip_jsonc(relations))
    nodes = [(f"def:{k}", "definition", k, {"doc": str(v)}) for k, v in sorted(own.items())]
    nodes += [(f"feature:{k}", "feature", k, {}) for k in sorted(linked.get("features", {}))]
    edges = [(f"feature:{k}", f"file:{f}", "IMPLEMENTED_BY") for k, v in sorted(linked.get("features", {}).items()) for f in v]
    edges += [(f"file:{k}", f"file:{f}", "GENERATES") for k, v in sorted(linked.get("generates", {}).items()) for f in v]
    rows = [(a, b, t, {}, i) for i, (a, b, t) in enumerate(edges)]
    return spark.createDataFrame(nodes, "id string, type string, name string, attrs map<string,string>"), spark.createDataFrame(rows, "src string, dst string, type string, attrs map<string,string>, ord bigint")
