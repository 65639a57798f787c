"""Repositories on a file system as DataFrames: texts, listings, directories, commits.

Listings are made by one task a repository root; texts are read by as many tasks as
there are files, through Spark's ``binaryFile`` source or, for ignore rules, a walk.
"""

from __future__ import annotations

import fnmatch
import os
import subprocess
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scalar as S
from ..functions.lines import line_count


class IgnoreRules:
    """Rules of the .gitignore files from a root down: later rules win, a leading ! takes back, a trailing / means directories."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, str, bool, bool, bool]] = []

    def add(self, folder: str, text: str) -> None:
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            back, rule = line.startswith("!"), line.lstrip("!")
            only_dirs, rule = rule.endswith("/"), rule.rstrip("/")
            rooted = "/" in rule
            self.rules.append((folder, rule.lstrip("/"), back, only_dirs, rooted))

    @staticmethod
    def of(text: str) -> list[tuple[str, str, bool, bool, bool]]:
        """The rules of a text that counts from the root."""
        own = IgnoreRules()
        own.add("", text)
        return own.rules

    def ignored(self, path: str, is_dir: bool) -> bool:
        out = False
        for folder, rule, back, only_dirs, rooted in self.rules:
            if only_dirs and not is_dir or folder and not path.startswith(folder + "/"):
                continue
            inner = path[len(folder) + 1 :] if folder else path
            names = [inner] if rooted else [inner, inner.rsplit("/", 1)[-1]]
            pattern = rule.replace("**/", "*")
            if any(fnmatch.fnmatchcase(n, pattern) or fnmatch.fnmatchcase(n, rule) for n in names):
                out = not back
        return out


def _shared_ignores(root: str) -> list[str]:
    """Ignore files outside the tree, the stronger first: the clone's own, then the user's."""
    named = subprocess.run(["git", "-C", root, "config", "--path", "core.excludesFile"], capture_output=True, text=True, check=False).stdout.strip()
    user = named or os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")
    return [p for p in (os.path.join(root, ".git", "info", "exclude"), user) if os.path.isfile(p)]


def walk(root: str) -> Iterator[tuple[str, bool, int, float, int]]:
    """(relative path, is directory, bytes, modified, depth) below ``root``; hidden entries are listed at their place but only entered for files to be left out later."""
    rules = IgnoreRules()
    stack = [("", 0)]
    while stack:
        folder, depth = stack.pop()
        full = os.path.join(root, folder) if folder else root
        try:
            entries = sorted(os.scandir(full), key=lambda e: e.name)
        except OSError:
            continue
        own = next((e for e in entries if e.name == ".gitignore" and e.is_file()), None)
        if own is not None:
            with open(own.path, encoding="utf-8", errors="replace") as f:
                rules.add(folder, f.read())
        if not folder:
            for shared in _shared_ignores(root):
                with open(shared, encoding="utf-8", errors="replace") as f:
                    rules.rules[:0] = IgnoreRules.of(f.read())
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            # Links, sockets and the like are no files of the repository.
            if not is_dir and not e.is_file(follow_symlinks=False) or rules.ignored(path, is_dir):
                continue
            info = e.stat(follow_symlinks=False)
            yield path, is_dir, 0 if is_dir else info.st_size, info.st_mtime, depth + 1
            if is_dir and not e.name.startswith("."):
                stack.append((path, depth + 1))


def listing(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(repo_id, root, path, is_dir, size_bytes, modified, depth) of everything below each root (repo_id -> folder), .gitignore honoured."""
    kind = "repo_id string, root string, path string, is_dir boolean, size_bytes long, modified timestamp, depth int"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = [(r["repo_id"], r["root"], p, d, n, datetime.fromtimestamp(t, UTC), k) for p, d, n, t, k in walk(r["root"])]
                for i in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[i : i + 10_000], strict=True))
                    types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["repo_id", "root", "path", "is_dir", "size_bytes", "modified", "depth"])

    base = spark.createDataFrame(sorted(roots.items()), "repo_id string, root string")
    return base.repartition(max(1, len(roots))).mapInArrow(run, kind)


def read_texts(entries: DataFrame) -> DataFrame:
    """``entries`` (repo_id, root, path) with their content; files that can't be read or aren't UTF-8 drop out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                try:
                    with open(os.path.join(r["root"], r["path"]), "rb") as f:
                        text = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    continue
                yield pa.RecordBatch.from_pydict({"repo_id": [r["repo_id"]], "path": [r["path"]], "content": [text]})

    return entries.select("repo_id", "root", "path").mapInArrow(run, "repo_id string, path string, content string")


def files(entries: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """The base relation of a listing: path tests run before any text is read."""
    visible = ~F.exists(F.split("path", "/"), lambda p: p.startswith("."))
    wanted = entries.where(~F.col("is_dir") & visible & ~S.path_ignored(F.col("path"), ignore or []) & (S.language(F.col("path")) != L.UNKNOWN))
    texts = read_texts(wanted.repartition("repo_id", "path"))
    return texts.select("repo_id", "path", S.language(F.col("path")).alias("language"), F.octet_length("content").cast("bigint").alias("size_bytes"), line_count(F.col("content")).cast("int").alias("line_count"), "content")


def binary_files(spark: SparkSession, folder: str, repo_id: str, ignore: list[str] | None = None) -> DataFrame:
    """The base relation of one folder on any Hadoop file system, by the ``binaryFile`` source; no ignore files are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace(F.split(F.col("path"), F.lit(folder.split(":")[-1].rstrip("/") + "/"), 2)[1], "^/+", "")
    named = raw.select(path.alias("path"), "content").where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".")) & ~S.path_ignored(F.col("path"), ignore or []))
    named = named.withColumn("language", S.language(F.col("path"))).where(F.col("language") != L.UNKNOWN).where(F.is_valid_utf8(F.col("content").cast("string")))
    text = F.decode("content", "UTF-8")
    return named.select(F.lit(repo_id).alias("repo_id"), "path", "language", F.octet_length("content").cast("bigint").alias("size_bytes"), line_count(text).cast("int").alias("line_count"), text.alias("content"))


def _commit_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.timestamp("us", "UTC")), pa.array(cols[3])], ["repo_id", "commit_id", "ts", "path"])


def commits(spark: SparkSession, roots: dict[str, str], days: int | None = None) -> DataFrame:
    """(repo_id, commit_id, ts, path) of each root's whole history, or of that many days, by ``git log``, read as it comes; folders without one give no rows."""
    kind = "repo_id string, commit_id string, ts timestamp, path string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                command = ["git", "-C", r["root"], "log", *([f"--since={days} days ago"] if days else []), "--name-only", "--diff-filter=ACMR", "--format=%x01%H %at"]
                rows, commit, when = [], None, None
                with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as log:
                    for line in log.stdout:
                        line = line.rstrip("\n")
                        if line.startswith("\x01"):
                            commit, stamp = line[1:].split(" ")
                            when = datetime.fromtimestamp(int(stamp), UTC)
                        elif line.strip():
                            rows.append((r["repo_id"], commit, when, line.strip()))
                            if len(rows) == 10_000:
                                yield _commit_rows(rows)
                                rows = []
                if rows:
                    yield _commit_rows(rows)

    base = spark.createDataFrame(sorted(roots.items()), "repo_id string, root string")
    return base.repartition(max(1, len(roots))).mapInArrow(run, kind)
