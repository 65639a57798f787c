"""Arrow-batched maps over (id, text) rows in small slices, so that long texts don't pile up in a worker."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text that are handled at once; one longer text makes a slice of its own.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``limit`` bytes of ``column`` each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system, as a worker is kept for the tasks of later stages; does nothing where the C library can't."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_slices(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``make()`` runs once a task and returns a function from a slice to columns of ``schema``; its attribute ``done``, if it has one, is called at the task's end."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                got = work(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)
        if done := getattr(work, "done", None):
            done()
        give_back()

    return df.mapInArrow(run, kind)
