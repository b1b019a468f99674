"""What git knows of a source tree: changed files, commits, last changes, and the tree at a reference.

git runs on the driver; what it lists is bounded by the tracked files, or by COMMITS.
"""

from __future__ import annotations

import os
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.shared import shared_dir

#: Commits that are read for co-change.
COMMITS = 2000


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root.removeprefix("file://"), "-c", "core.quotePath=false", *args], check=True, capture_output=True, text=True).stdout


def is_tree(root: str) -> bool:
    """Whether a folder that the driver sees is under git, with a commit at least."""
    place = root.removeprefix("file://")
    return os.path.exists(os.path.join(place, ".git")) and subprocess.run(["git", "-C", place, "rev-parse", "-q", "--verify", "HEAD"], capture_output=True).returncode == 0


def changed_files(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """(change, old_path, path) between a reference and the tree on disk; renames are found by content."""
    rows = []
    for line in git(root, "diff", "--name-status", "-M", ref).splitlines():
        kind, *names = line.split("\t")
        rows.append(({"A": "added", "D": "deleted", "R": "renamed"}.get(kind[0], "changed"), names[0], names[-1]))
    rows += [("added", x, x) for x in git(root, "ls-files", "--others", "--exclude-standard").splitlines()]
    return spark.createDataFrame(rows, "change string, old_path string, path string")


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files that git tracks or would take up."""
    return spark.createDataFrame([(x,) for x in git(root, "ls-files", "--cached", "--others", "--exclude-standard").splitlines()], "path string")


def commit_files(spark: SparkSession, root: str) -> DataFrame:
    """(basket, item): the files of each of the last COMMITS commits."""
    rows, now = [], None
    for line in git(root, "log", f"-n{COMMITS}", "--no-merges", "--name-only", "--format=%x00%H").splitlines():
        if line.startswith("\0"):
            now = line[1:]
        elif line:
            rows.append((now, line))
    return spark.createDataFrame(rows, "basket string, item string")


def last_commits(spark: SparkSession, root: str) -> DataFrame:
    """(path, at): seconds of the last commit that touched each path."""
    last: dict[str, int] = {}
    now = 0
    for line in git(root, "log", "--name-only", "--format=%x00%ct").splitlines():
        if line.startswith("\0"):
            now = int(line[1:])
        elif line:
            last.setdefault(line, now)
    return spark.createDataFrame(sorted(last.items()), "path string, at bigint")


def tree_at(spark: SparkSession, root: str, ref: str) -> str:
    """A folder in the shared folder with the tree at a reference, for executors to read."""
    folder = f"{shared_dir(spark)}/skein/tree-{uuid.uuid4().hex}"
    if not folder.startswith(("file:", "/")):
        raise ValueError("a tree at a reference needs a shared folder that git can write to")
    place = folder.removeprefix("file://")
    git(root, "worktree", "add", "--detach", "--force", place, ref)
    return folder


def drop_tree(root: str, folder: str) -> None:
    git(root, "worktree", "remove", "--force", folder.removeprefix("file://"))
