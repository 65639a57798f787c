"""Duplicate chunks: windows of eight lines that are equal after identifiers and strings are blanked.

Chunks are cut and normalised in Arrow batches (regular expressions over strings
that the JVM's array functions take several times as long for); grouping,
thresholds and similarity are DataFrame operations. A chunk travels as the SHA-256 of
its normal form and its place; texts are cut again for files of clusters only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lookups as L
from ..plans.cut import cut

_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
_KEYWORDS = frozenset(L.DUP_KEYWORDS)
_NOT_LINES = ("//", "#")
#: Words whose normal forms a worker keeps, and their longest.
_KEPT_WORDS, _KEPT_LETTERS = 100_000, 40
#: Files with a place in a cluster up to which their names go to every task; beyond it the same join runs shuffled.
BROADCAST_FILES = 1_000_000


def normalize(chunk: str) -> str:
    """Quoted spans as "_", identifiers but keywords as _ID_, white space as single spaces."""
    named = _NAME.sub(lambda m: m.group() if m.group() in _KEYWORDS else "_ID_", _QUOTED.sub('"_"', chunk))
    return " ".join(named.split())


class _Words(dict):
    """Normal forms of words without quoted spans."""

    def __missing__(self, word: str) -> str:
        plain = _NAME.sub(lambda m: m.group() if m.group() in _KEYWORDS else "_ID_", word)
        if len(word) <= _KEPT_LETTERS and len(self) < _KEPT_WORDS:
            self[word] = plain
        return plain


_WORDS = _Words()


def _normal_line(line: str) -> tuple[str, int] | None:
    """Normal form of a line and its keywords, the same in whatever chunk; None if a quote that it doesn't close makes it depend on other lines."""
    if '"' in line or "'" in line:
        rest = _QUOTED.sub("", line)
        if '"' in rest or "'" in rest:
            return None
        line = _QUOTED.sub('"_"', line)
    words = line.split()
    return " ".join(map(_WORDS.__getitem__, words)), sum(map(_KEYWORDS.__contains__, words))


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def lines_of(content: str) -> list[str]:
    lines = content.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def chunks_of(content: str) -> Iterator[tuple[int, str, str]]:
    """(recorded line, raw chunk, normalised chunk) of the windows that pass the thresholds. The line recorded is that after the step, as readers of such reports expect."""
    lines = lines_of(content)
    step = 4 if len(lines) > 2000 else 2 if len(lines) > 500 else 1
    if len(lines) < L.CHUNK_LINES:
        return
    kept = [x if (x := line.strip()) and not x.startswith(_NOT_LINES) else None for line in lines]
    # A line stands in eight windows: it is normalised once, and sums up to each line tell what passes.
    normal = [_normal_line(x) if x else None for x in kept]
    n_raw, n_plain, n_words, n_open = ([0, *accumulate(x)] for x in (
        [_bytes(x) + 1 if x else 0 for x in kept], [_bytes(x[0]) + 1 if x else 0 for x in normal], [x[1] if x else 0 for x in normal], [x is not None and y is None for x, y in zip(kept, normal, strict=True)],
    ))
    for start in range(0, len(lines) - L.CHUNK_LINES + 1, step):
        end = start + L.CHUNK_LINES
        if n_raw[end] - n_raw[start] - 1 < L.CHUNK_BYTES:
            continue
        whole = n_open[end] == n_open[start]
        if whole and (n_plain[end] - n_plain[start] - 1 < L.CHUNK_NORMAL_BYTES or n_words[end] - n_words[start] < L.CHUNK_KEYWORDS):
            continue
        raw = "\n".join([x for x in kept[start:end] if x])
        if whole:
            yield start + step, raw, " ".join([x[0] for x in normal[start:end] if x])
            continue
        plain = normalize(raw)
        if len(plain.encode()) >= L.CHUNK_NORMAL_BYTES and sum(t in _KEYWORDS for t in plain.split()) >= L.CHUNK_KEYWORDS:
            yield start + step, raw, plain


def chunks(files: DataFrame, raw: bool = False) -> DataFrame:
    """(repo_id, path, line, cluster) of every chunk that passes the thresholds, with its ``raw`` text if asked for."""
    kind = "repo_id string, path string, line int, cluster string" + ", raw string" * raw
    schema = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("cluster", pa.string())] + [("raw", pa.string())] * raw)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                got = list(chunks_of(r["content"]))
                for i in range(0, len(got), 5000):
                    line, text, plain = zip(*got[i : i + 5000], strict=True)
                    n = len(line)
                    cols = [[r["repo_id"]] * n, [r["path"]] * n, line, [hashlib.sha256(x.encode()).hexdigest() for x in plain]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, text] if raw else cols, schema, strict=True)], schema=schema)

    return files.select(F.col("repo_id").cast("string"), "path", "content").mapInArrow(run, kind)



def clusters(files: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """(repo_id, cluster, n_locations, n_files, first_path, first_line, line_count) of chunks in two files or more.

    ``cluster`` is the SHA-256 of the normalised chunk; given ``keyed``, chunks aren't cut anew. Counts are combined before the shuffle, so a
    chunk that stands everywhere moves one row a partition.
    """
    keyed = chunks(files) if keyed is None else keyed
    by_file = keyed.groupBy("repo_id", "cluster", "path").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    first = F.min(F.struct("path", "line"))
    return (
        by_file.groupBy("repo_id", "cluster").agg(F.sum("n").alias("n_locations"), F.count(F.lit(1)).alias("n_files"), first.alias("f")).where("n_files >= 2")
        .select("repo_id", "cluster", "n_locations", "n_files", F.col("f.path").alias("first_path"), F.col("f.line").alias("first_line"), F.lit(L.CHUNK_LINES).alias("line_count"))
    )


def locations(files: DataFrame) -> DataFrame:
    """(repo_id, cluster, path, line) of every place of every cluster."""
    keyed = cut(chunks(files))
    return keyed.join(clusters(files, keyed).select("repo_id", "cluster"), ["repo_id", "cluster"], "left_semi").select("repo_id", "cluster", "path", "line")


def similarity(files: DataFrame) -> DataFrame:
    """(repo_id, cluster, similarity): least Jaccard of the word sets of a cluster's first chunk (by path and line) and any other."""
    keyed = cut(chunks(files.repartition("path")))
    found = cut(clusters(files, keyed))
    named = found.select("repo_id", "cluster")
    # Only files that have a place in a cluster are moved and cut again, and only chunks of clusters become word sets.
    owners = cut(keyed.join(named, ["repo_id", "cluster"], "left_semi").select("repo_id", "path").distinct())
    again = files.join(F.broadcast(owners) if owners.count() <= BROADCAST_FILES else owners, ["repo_id", "path"], "left_semi").repartition("path")
    at_first = (F.col("path") == F.col("first_path")) & (F.col("line") == F.col("first_line"))
    # Chunks travel as text, a third of the size of their word sets.
    raw = cut(chunks(again, True).join(found.select("repo_id", "cluster", "first_path", "first_line"), ["repo_id", "cluster"]).select("repo_id", "cluster", at_first.alias("at_first"), "raw"))
    words = F.array_distinct(F.filter(F.split("raw", r"\s+"), lambda w: w != ""))
    first = raw.where("at_first").select("repo_id", "cluster", words.alias("w0"))
    both = raw.select("repo_id", "cluster", "raw").join(first, ["repo_id", "cluster"]).select("repo_id", "cluster", "w0", words.alias("words"))
    both = both.select("repo_id", "cluster", (F.size("w0") + F.size("words")).alias("n"), F.size(F.array_intersect("w0", "words")).alias("shared"))
    share = F.when(F.col("n") == 0, 1.0).otherwise(F.col("shared") / (F.col("n") - F.col("shared")))
    return both.groupBy("repo_id", "cluster").agg(F.min(share).alias("similarity"))


def duplicate_totals(found: DataFrame) -> DataFrame:
    """(repo_id, cluster_count, duplicate_lines)."""
    return found.groupBy("repo_id").agg(F.count(F.lit(1)).alias("cluster_count"), (F.sum("n_locations") * L.CHUNK_LINES).cast("bigint").alias("duplicate_lines"))
