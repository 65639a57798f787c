"""Token-id files: one zstandard frame a document, all of them on one shared dictionary, with an offset index.

A folder holds ``dictionary.zstd`` and, per range of document ids, a pair

* ``shard-NNNNN.tok``: magic ``GTOK1``, one byte of id width (2 or 4), the 32-byte
  SHA-256 of the dictionary, then the frames;
* ``shard-NNNNN.idx``: the same hash, the number of rows without an id (uint64), then
  three little-endian arrays of equal length: ids (int64), ends of frames (uint64),
  numbers of tokens (uint64).

Documents stand in ascending id order, in a shard and from shard to shard, those
without an id first. A short document is reached by a binary search in the index
file, down to one block of ids, and one read of its frame.
Files appear under their names only when whole (written aside, then renamed), so a
task that is run again leaves the same files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import map_slices
from .encoders import byte_level
from .ordering import LEAST, id_bounds
from .storage import as_text, new_path

#: The dictionary is trained on at most so many documents, cut into stretches of so many ids, of which at most so many are taken, those of least hashes; and its bytes.
SAMPLE_DOCS, STRETCH, SAMPLE_STRETCHES, DICTIONARY_BYTES = 2000, 8192, 4000, 112_640
LEVEL = 3
_MAGIC = b"GTOK1"
_HEAD = len(_MAGIC) + 1 + 32
_INDEX_HEAD = 32 + 8
#: Ids of an index that are read at once in a search.
_BLOCK = 4096


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def write_whole(path: str, parts: Iterable[bytes]) -> None:
    """A file that is there as a whole or not at all."""
    fs, name = _fs(path)
    aside = f"{name}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(aside) as out:
        for p in parts:
            out.write(p)
    fs.move(aside, name)


def read_whole(path: str) -> bytes:
    fs, name = _fs(path)
    with fs.open_input_stream(name) as f:
        return f.read()


def train_dictionary(documents: DataFrame, vocabulary: str, end_id: int, dtype: str) -> bytes:
    """A dictionary from a sample of stretches of whole documents; b'' where they are too few to train one."""
    import zstandard

    docs = as_text(documents)
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    picked = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")

    def make():
        code = byte_level(vocabulary)

        def work(part):
            ids, bounds = code.encode_flat(part.column("text"), end_id)
            own = [ids[i : min(i + STRETCH, b)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for i in range(a, b, STRETCH)]
            return {"ids": [x.astype(dtype).tobytes() for x in own]}

        return work

    stretches = map_slices(picked, "text", make, "ids binary").orderBy(F.xxhash64("ids"), "ids").limit(SAMPLE_STRETCHES)
    samples = sorted(bytes(r["ids"]) for r in stretches.collect())
    if len(samples) < 100:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write(documents: DataFrame, folder: str, vocabulary: str, end_id: int = 0, shards: int | None = None) -> list[dict]:
    """Encode ``documents`` (doc_id, text) into ``folder``; returns the shards: k, docs, tokens.

    Null texts are empty: they hold ``end_id`` alone. Rows of one id keep a frame
    each, ordered by their bytes; null ids come first. An empty table leaves a
    folder without shards.
    """
    import zstandard
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id) <= 0xFFFF else "<u4"
    trained = train_dictionary(documents, vocabulary, end_id, dtype)
    digest = hashlib.sha256(trained).digest()
    fs, name = _fs(folder)
    fs.create_dir(name, recursive=True)
    write_whole(f"{folder}/dictionary.zstd", [trained])
    bounds = id_bounds(documents, shards)

    def make():
        code, press = byte_level(vocabulary), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(trained))
        starts = np.array(bounds, np.int64)

        def work(part):
            ids, at = code.encode_flat(part.column("text"), end_id)
            data, width, at = memoryview(ids.astype(dtype)).cast("B"), np.dtype(dtype).itemsize, at.tolist()
            shard = np.searchsorted(starts, part.column("doc_id").fill_null(LEAST).to_numpy(zero_copy_only=False), "right") - 1
            frames = [press.compress(data[width * a : width * b]) for a, b in zip(at, at[1:])]
            return {"doc_id": part.column("doc_id"), "shard": pa.array(shard, pa.int32()), "n": np.diff(at), "frame": frames}

        return work

    framed = (
        map_slices(as_text(documents.select(F.col("doc_id").cast("long"), "text")), "text", make, "doc_id long, shard int, n long, frame binary")
        .repartitionById(len(bounds), "shard")
        .sortWithinPartitions("doc_id", "frame")
    )

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, ids, ends, counts, at, nulls = None, [], [], [], 0, 0

        def frames() -> Iterator[bytes]:
            nonlocal k, at, nulls
            yield _MAGIC + bytes([np.dtype(dtype).itemsize]) + digest
            for b in batches:
                if b.num_rows:
                    k = b.column("shard")[0].as_py()
                    nulls += b.column("doc_id").null_count
                    ids.append(b.column("doc_id").fill_null(LEAST).to_numpy(zero_copy_only=False))
                    counts.append(b.column("n").to_numpy(zero_copy_only=False))
                    data = b.column("frame").to_pylist()
                    ends.append(at + np.cumsum([len(x) for x in data]))
                    at = int(ends[-1][-1])
                    yield b"".join(data)

        # The shard's number is known with its first rows only, so the file is written aside under a name of its own.
        aside = f"{folder}/{uuid.uuid4().hex}.new"
        write_whole(aside, frames())
        fs, name = _fs(aside)
        if k is None:
            fs.delete_file(name)
            return
        n = np.concatenate(counts).astype("<u8")
        index = [digest, nulls.to_bytes(8, "little"), np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(ends).astype("<u8").tobytes(), n.tobytes()]
        write_whole(f"{folder}/shard-{k:05d}.idx", index)
        fs.move(name, _fs(f"{folder}/shard-{k:05d}.tok")[1])
        yield pa.RecordBatch.from_pydict({"k": [k], "docs": [len(n)], "tokens": [int(n.sum())]}, pa.schema([("k", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    made = [r.asDict() for r in framed.mapInArrow(save, "k int, docs long, tokens long").collect()]
    made.sort(key=lambda r: r["k"])
    write_whole(f"{folder}/manifest.json", [json.dumps({"width": np.dtype(dtype).itemsize, "dictionary_sha256": digest.hex(), "shards": made}).encode()])
    return made


class Shard:
    """One pair of files, opened for reading."""

    def __init__(self, folder: str, k: int, dictionary: bytes | None = None):
        import zstandard

        dictionary = read_whole(f"{folder}/dictionary.zstd") if dictionary is None else dictionary
        fs, name = _fs(f"{folder}/shard-{k:05d}.idx")
        self.index = fs.open_input_file(name)
        self.rows = (self.index.size() - _INDEX_HEAD) // 24
        own = self.index.read_at(_INDEX_HEAD, 0)
        #: Rows without an id, which come first.
        self.nulls = int.from_bytes(own[32:], "little")
        fs, name = _fs(f"{folder}/shard-{k:05d}.tok")
        self.file = fs.open_input_file(name)
        head = self.file.read_at(_HEAD, 0)
        if head[: len(_MAGIC)] != _MAGIC or head[len(_MAGIC) + 1 :] != hashlib.sha256(dictionary).digest() or own[:32] != head[len(_MAGIC) + 1 :]:
            raise ValueError(f"shard {k} wasn't written with this dictionary")
        self.dtype = {2: "<u2", 4: "<u4"}[head[len(_MAGIC)]]
        self.press = zstandard.ZstdDecompressor(dict_data=_dict(dictionary))

    def _column(self, which: int, kind: str, first: int = 0, n: int | None = None) -> np.ndarray:
        n = self.rows - first if n is None else n
        return np.frombuffer(self.index.read_at(8 * n, _INDEX_HEAD + 8 * (which * self.rows + first)), kind)

    def ids(self, first: int = 0, n: int | None = None) -> np.ndarray:
        return self._column(0, "<i8", first, n)

    def ends(self, first: int = 0, n: int | None = None) -> np.ndarray:
        return self._column(1, "<u8", first, n)

    def counts(self) -> np.ndarray:
        return self._column(2, "<u8")

    def frame(self, start: int, end: int) -> np.ndarray:
        """The ids of the frame at these bytes."""
        return np.frombuffer(self.press.decompress(self.file.read_at(end - start, _HEAD + start)), self.dtype)

    def _first(self, doc_id: int, low: int) -> int:
        """The first row from ``low`` on with this id or a greater one."""
        high = self.rows
        while high - low > _BLOCK:
            mid = (low + high) // 2
            if self.ids(mid, 1)[0] < doc_id:
                low = mid + 1
            else:
                high = mid
        return low + int(np.searchsorted(self.ids(low, high - low), doc_id))

    def document(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays of all rows of ``doc_id``; reads some ids of the index, then those rows."""
        if doc_id is None:
            first, stop = 0, self.nulls
        else:
            first = self._first(doc_id, self.nulls)
            stop = self.rows if doc_id == 2**63 - 1 else self._first(doc_id + 1, first)
        if first == stop:
            return []
        ends = np.concatenate([[0] if first == 0 else [], self.ends(max(0, first - 1), stop - max(0, first - 1))]).astype(np.int64).tolist()
        return [self.frame(a, b) for a, b in zip(ends, ends[1:])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of ``folder``'s files: doc_id, start (ids before it), n_tokens, ids (as written)."""
    return _read(spark, folder, True)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read``, with the CRC-32 of the ids as little-endian 32-bit integers in place of the ids."""
    return _read(spark, folder, False)


def _read(spark: SparkSession, folder: str, with_ids: bool) -> DataFrame:
    shards = json.loads(read_whole(f"{folder}/manifest.json"))["shards"]
    rows, before = [], 0
    for s in shards:
        rows.append((len(rows), s["k"], before))
        before += s["tokens"]
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())) if with_ids else ("ids_crc32", pa.int64())])

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = read_whole(f"{folder}/dictionary.zstd")
        for b in batches:
            for k, at in zip(b.column("k").to_pylist(), b.column("before").to_pylist(), strict=True):
                shard = Shard(folder, k, dictionary)
                ids, n, ends = shard.ids(), shard.counts().astype(np.int64), np.concatenate([[0], shard.ends().astype(np.int64)]).tolist()
                starts, null = at + np.cumsum(n) - n, np.arange(len(ids)) < shard.nulls
                for i in range(0, len(ids), 2000):
                    j = min(i + 2000, len(ids))
                    arrays = [shard.frame(a, b) for a, b in zip(ends[i:j], ends[i + 1 : j + 1], strict=True)]
                    last = pa.array([a.astype("<i8") for a in arrays], pa.list_(pa.int64())) if with_ids else pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in arrays], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], mask=null[i:j]), pa.array(starts[i:j]), pa.array([len(a) for a in arrays], pa.int64()), last], schema=kind)

    work = spark.createDataFrame(rows, "place int, k int, before long").repartitionById(max(1, len(rows)), "place")
    return work.mapInArrow(load, "doc_id long, start long, n_tokens long, " + ("ids array<long>" if with_ids else "ids_crc32 long"))


def round_trip(documents: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write ``documents`` into a new shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""
    folder = new_path(documents.sparkSession, "tokens")
    write(documents, folder, vocabulary, end_id)
    return digests(documents.sparkSession, folder)
