"""Canonical exact digest of texts: Unicode normalisation, case and white-space folding, 128 bits of xxhash.

Everything here is DataFrame expressions; ICU's normaliser and case folding,
which Spark ships, are reached through the SQL function ``reflect``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import id_bounds, is_bound, order_key, shard_of
from .storage import as_text, bounded_broadcast, stash

#: Copies are looked up by a broadcast id list up to so many ids (16 bytes each), by a shuffled join beyond.
BROADCAST_IDS = 500_000
#: White space but the plain space, as left by NFKC.
_SPACES = r"\t\n\x0B\f\r\x1C-\x1F\u0085\u1680\u2028\u2029"


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white-space runs as one space, trimmed. ASCII texts take a shorter way to the same result."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    plain = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(ascii_only, plain).otherwise(nfkc(fold(nfkc(text))))
    return F.trim(F.regexp_replace(folded, rf"(?: (?=[{_SPACES} ])|[{_SPACES}])[{_SPACES} ]*", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits: two xxhash64 lanes of different seeds."""
    lane = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(lane(canon), lane(F.lit("second lane"), canon))


def collisions(keys: DataFrame, texts: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Different canonical texts that share a wide hash: (h, canon, nth), nth from 0 in byte order; empty but for real collisions.

    ``keys`` has (id_column, h) for every row. Only texts of buckets with several
    rows are read again; their least and greatest texts, which are pre-aggregated
    before the shuffle, tell whether all bytes are equal, so a bucket that holds
    a third of all rows sends two texts a partition.
    """
    many = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    ids = stash(keys.join(many, "h", "left_semi").select(F.col(id_column).alias("id")).distinct(), "copies")
    again = (
        as_text(texts, id_column=id_column)
        .join(bounded_broadcast(ids, ids.count(), BROADCAST_IDS), F.col(id_column).eqNullSafe(F.col("id")), "left_semi")
        .select(canonical(F.col("text")).alias("canon"))
        .select(wide_hash(F.col("canon")).alias("h"), "canon")
    )
    unequal = again.groupBy("h").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least != most").select("h")
    nth = F.row_number().over(Window.partitionBy("h").orderBy("canon")) - 1
    return again.join(unequal, "h", "left_semi").distinct().select("h", "canon", nth.alias("nth"))


def with_next(docs: DataFrame, payload: list[str], shards: int | None = None) -> DataFrame:
    """Each row with the ``payload`` of the row that follows in ascending (doc_id, text), as next_*; the first follows the last.

    Null ids come first. Rows are cut into ranges of ids; the rows at a bound also
    go to the range before, as ghosts, so one shuffle suffices and no range is
    bounded to one task's memory (window sorts spill).
    """
    order = order_key()
    bounds = id_bounds(docs, shards)
    last = len(bounds) - 1
    own = F.struct(shard_of(order, bounds).alias("shard"), F.lit(0).alias("wrap"), F.lit(False).alias("ghost"))
    before = F.struct((shard_of(order, bounds) - 1).alias("shard"), F.lit(0).alias("wrap"), F.lit(True).alias("ghost"))
    round_ = F.struct(F.lit(last).alias("shard"), F.lit(1).alias("wrap"), F.lit(True).alias("ghost"))
    places = F.when(order == bounds[0], F.array(own, round_))
    if last:
        places = places.when(is_bound(order, bounds), F.array(own, before))
    w = Window.partitionBy("shard").orderBy("wrap", "o", "text")
    return (
        docs.withColumn("o", order)
        .withColumn("place", F.explode(places.otherwise(F.array(own))))
        .select("*", "place.*")
        .drop("place")
        .withColumns({f"next_{c}": F.lead(c).over(w) for c in payload})
        .where(~F.col("ghost"))
        .drop("ghost", "wrap", "shard", "o")
    )


def fingerprints(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its digest, that of an edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has its last quarter of code points
    replaced by the start of the next document. A digest is alike or not: likeness
    is 1.0 for equal canonical bytes, else 0.0. Null text counts as empty; an
    empty text has the digest of no bytes. Repeated rows and ids keep a row each;
    ties in doc_id are ordered by text, null ids come first. An empty table gives
    an empty result. Other columns are ignored.
    """
    base = as_text(docs)
    hashed = base.withColumn("canon", canonical(F.col("text"))).select("doc_id", "text", wide_hash(F.col("canon")).alias("h"))
    rows = with_next(hashed, ["text", "h"], shards)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    same = lambda a, b: (canonical(a) == canonical(b)).cast("double")
    keys = stash(
        rows.withColumn("edited", edited)
        .withColumn("canon", canonical(F.col("edited")))
        .withColumn("eh", wide_hash(F.col("canon")))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            "h",
            "eh",
            F.when(F.col("h") == F.col("eh"), same(F.col("text"), F.col("edited"))).otherwise(0.0).alias("near_edited"),
            F.when(F.col("h") == F.col("next_h"), same(F.col("text"), F.col("next_text"))).otherwise(0.0).alias("near_next"),
        ),
        "digests",
    )
    clash = stash(collisions(keys.select("doc_id", "h"), docs), "collisions")
    if clash.isEmpty():
        return keys.select("doc_id", "n_chars", "edited_sha256", F.col("h").alias("fingerprint"), F.col("eh").alias("edited_fingerprint"), "near_edited", "near_next")
    # A collision of 128 bits was found: rows of such buckets are told apart by their bytes' place in the bucket.
    nth = clash.select(F.col("h").alias("ch"), "canon", "nth")
    texts = rows.withColumn("edited", edited).withColumn("eh", wide_hash(canonical(F.col("edited"))))
    own = nth.select(F.col("ch").alias("h"), F.col("canon").alias("c1"), F.col("nth").alias("n1"))
    oth = nth.select(F.col("ch").alias("eh"), F.col("canon").alias("c2"), F.col("nth").alias("n2"))
    mark = lambda h, k: F.when(k > 0, F.concat(h, F.lit("-"), k.cast("string"))).otherwise(h)
    return (
        texts.withColumn("c1", canonical(F.col("text")))
        .withColumn("c2", canonical(F.col("edited")))
        .join(own, ["h", "c1"], "left")
        .join(oth, ["eh", "c2"], "left")
        .select(
            "doc_id",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            mark(F.col("h"), F.col("n1")).alias("fingerprint"),
            mark(F.col("eh"), F.col("n2")).alias("edited_fingerprint"),
            (F.col("c1") == F.col("c2")).cast("double").alias("near_edited"),
            (F.col("c1") == canonical(F.col("next_text"))).cast("double").alias("near_next"),
        )
    )


def copy_groups(docs: DataFrame) -> DataFrame:
    """Per distinct canonical text: fingerprint, rows that have it, and the smallest doc_id among them."""
    return fingerprints(docs).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


__all__ = ["canonical", "wide_hash", "collisions", "with_next", "fingerprints", "copy_groups"]
