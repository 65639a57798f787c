"""Ranges of document ids, for results in ascending order without one task that sees all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Null ids come first.
LEAST = -(2**63)
#: Rows of a range, about, where the table has more than this for each shuffle partition.
RANGE_ROWS = 250_000


def order_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(LEAST)).cast("long")


def _literal(values: list, kind: str) -> Column:
    """One array literal, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def id_bounds(docs: DataFrame, shards: int | None = None, column: str = "doc_id") -> list[int]:
    """Ascending ids, the first the least of all; each starts a range with about as many rows as the others. Reads the id column alone.

    There are at most ``shards`` ranges; where that is None their number follows
    the rows. The list is the driver's: 8 bytes for RANGE_ROWS rows.
    """
    keys = docs.select(order_key(column).alias("o"))
    if shards is None:
        shards = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys.count() // RANGE_ROWS)
    least = F.min("o").alias("least")
    if shards == 1:
        got = keys.agg(least).first()
        return [LEAST if got["least"] is None else got["least"]]
    shares = _literal([i / shards for i in range(1, shards)], "double")
    got = keys.agg(least, F.percentile_approx("o", shares, max(10_000, 20 * shards)).alias("cuts")).first()
    return [LEAST] if got["least"] is None else sorted({got["least"], *got["cuts"]})


def shard_of(order: Column, bounds: list[int]) -> Column:
    """Index of the last bound that is not above ``order``, by binary search in one literal array."""
    if len(bounds) == 1:
        return F.lit(0)
    steps = [2**k for k in reversed(range((len(bounds) - 1).bit_length()))]
    at = _literal(bounds, "bigint")
    return F.aggregate(_literal(steps, "int"), F.lit(0), lambda low, step: F.when(F.get(at, low + step) <= order, low + step).otherwise(low))


def is_bound(order: Column, bounds: list[int]) -> Column:
    """Whether ``order`` is one of the bounds but the first."""
    return (order != bounds[0]) & (F.get(_literal(bounds, "bigint"), shard_of(order, bounds)) == order)
