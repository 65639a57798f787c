"""Documents' token counts from flat, unindexed token files, by a scan for end-of-document ids.

Files are cut into blocks of a fixed number of ids. Each block is searched with
one vectorised comparison; a prefix scan over the blocks' summaries (separators so
far, place of the last one) then stitches documents that cross block bounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowmap import slices
from .encoders import byte_level
from .storage import as_text, new_path, stash
from .tokenfile import _fs

#: Ids of a block: 2 MB of 16-bit ids.
BLOCK_IDS = 1_000_000


def write_flat(documents: DataFrame, folder: str, vocabulary: str, end_id: int, dtype: str) -> DataFrame:
    """Flat files of ids, ``end_id`` after each document, one file a partition and nothing else; returns what stands where: (file, ordinal, doc_id).

    Every task writes under a name of its own, so one that runs twice leaves a
    file that nobody names. A special token's string inside a text is encoded as
    ordinary text; ids that hold ``end_id`` all the same are an error.
    """
    fs, name = _fs(folder)
    fs.create_dir(name, recursive=True)

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file, at = byte_level(vocabulary, literal=True), uuid.uuid4().hex, 0
        fs, name = _fs(f"{folder}/{file}.ids")
        out = None
        for batch in batches:
            for part in slices(batch, "text"):
                out = out or fs.open_output_stream(name)
                ids, _ = code.encode_flat(part.column("text"), end_id)
                if np.count_nonzero(ids == end_id) != part.num_rows:
                    raise ValueError(f"a document's ids hold the end id {end_id}")
                out.write(ids.astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([file] * part.num_rows, pa.string()), pa.array(range(at, at + part.num_rows), pa.int64()), part.column("doc_id").cast(pa.int64())], ["file", "ordinal", "doc_id"])
                at += part.num_rows
        if out is not None:
            out.close()

    return stash(as_text(documents).mapInArrow(save, "file string, ordinal long, doc_id long"), "order")


def blocks(spark: SparkSession, folder: str, files: DataFrame, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, first, n) of every block of the named ``files``; sizes are asked of the file system, in tasks."""
    width = np.dtype(dtype).itemsize

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                fs, name = _fs(f"{folder}/{file}.ids")
                total = fs.get_file_info(name).size // width
                firsts = np.arange(0, total, block_ids, dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(firsts), pa.string()), pa.array(np.arange(len(firsts), dtype="<i8")), pa.array(firsts), pa.array(np.minimum(block_ids, total - firsts))], ["file", "block", "first", "n"])

    return files.select("file").distinct().mapInArrow(cut, "file string, block long, first long, n long")


def scan(folder: str, cut: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """Per document: file, ordinal, start, n_tokens (ids before its separator), ended (false for ids after a file's last separator).

    Empty documents count 0; a file without separators holds one unended
    document; an empty file none.
    """
    width = np.dtype(dtype).itemsize

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, name = _fs(f"{folder}/{r['file']}.ids")
                with fs.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(r["n"] * width, r["first"] * width), dtype)
                at = np.flatnonzero(ids == end_id) + r["first"]
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]]), pa.array([r["block"]]), pa.array([r["first"] + r["n"]]), pa.array([at], pa.list_(pa.int64()))], ["file", "block", "stop", "at"])

    found = stash(cut.repartition("file", "block").mapInArrow(search, "file string, block long, stop long, at array<long>"), "separators")
    summary = found.select("file", "block", "stop", F.size("at").cast("long").alias("n"), F.element_at(F.when(F.size("at") > 0, F.col("at")), -1).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = summary.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seen"), F.coalesce(F.last("last", ignorenulls=True).over(before) + 1, F.lit(0)).alias("open"))
    places = found.join(stitched, ["file", "block"]).select("file", "seen", "open", "at", F.posexplode("at").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.get("at", F.col("i") - 1) + 1)
    ended = places.select("file", (F.col("seen") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = (
        summary.groupBy("file").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"), F.max("stop").alias("stop"))
        .where("stop > start").select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    )
    return ended.unionByName(tail)


def width_of(vocabulary: str, end_id: int) -> str:
    """The narrowest of 16 and 32 bits that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size() - 1, end_id) <= 0xFFFF else "<u4"


def token_counts(documents: DataFrame, vocabulary: str, end_id: int, dtype: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write ``documents`` (doc_id, text) as flat files, scan those for ``end_id``: doc_id, file, ordinal, start, n_tokens.

    Counts come from the files alone; the order in which documents were written
    only names them, and a file with more or fewer separators than documents is an
    error. Null texts are empty (0 tokens); repeated rows and ids, null
    ones too, keep a row each; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    folder, dtype = new_path(spark, "flat"), dtype or width_of(vocabulary, end_id)
    order = write_flat(documents, folder, vocabulary, end_id, dtype)
    counts = scan(folder, blocks(spark, folder, order, dtype, block_ids), end_id, dtype)
    whole = F.col("ended") & F.col("written")
    checked = F.when(whole, F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("separators and documents differ in number: "), "file")).cast("long"))
    both = counts.join(order.withColumn("written", F.lit(True)), ["file", "ordinal"], "full")
    return both.select("doc_id", "file", "ordinal", "start", checked.alias("n_tokens"))


__all__ = ["write_flat", "blocks", "scan", "token_counts"]
