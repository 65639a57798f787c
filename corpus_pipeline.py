"""A corpus cleaned for training: quality, near-duplicates, benchmark passages, personal data, then ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; ``run`` writes every stage's rows as Parquet in the shared folder and reads
them again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritmeter.llm import decontam, minhash, pieces, pii, quality
from gritmeter.llm.queries import tokenizer
from gritmeter.llm.storage import bounded_broadcast, new_path, stash

#: Ids of removed documents that are broadcast at most; beyond, the anti-join is a shuffled one.
BROADCAST_IDS = 1_000_000


def _own_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells every row from all others, and its name: doc_id, but a number above all of them for rows whose doc_id is null or repeated."""
    name = "_own"
    while name in docs.columns:
        name += "_"
    often = stash(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("again")), "repeated")
    n = often.count()
    if not n:
        return docs.withColumn(name, F.col("doc_id")), name
    top = docs.agg(F.max("doc_id")).first()[0]
    row = F.monotonically_increasing_id()
    new = F.lit((top or 0) + 1) + row if (top or 0) < 2**62 else F.lit(1 - 2**63) + row
    again = bounded_broadcast(often.withColumn("_twice", F.lit(True)), n, BROADCAST_IDS)
    marked = docs.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left")
    # Written once, so that a row has one number.
    return stash(marked.select(*docs.columns, F.when(F.col("_twice"), new).otherwise(F.col("doc_id")).alias(name)), "numbered"), name


def _without(docs: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose column ``name`` isn't a doc_id of ``found``; without that column."""
    gone = stash(found.select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(bounded_broadcast(gone, gone.count(), BROADCAST_IDS), F.col(name) == F.col("gone"), "left_anti").drop(name)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored as one empty passage, repeated rows alike, long
    texts whole; an empty table stays empty, and no column's name matters but doc_id and text.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of least id.

    Texts that are null or have no words are in no group and stay. Every row is
    judged by its own text: rows of null or repeated ids are told apart, and lose to
    others of their group. Ties don't occur, as ids are made distinct; an empty
    table stays empty; further columns are kept as they are.
    """
    docs, own = _own_ids(docs)
    found = minhash.near_duplicates(docs.select(F.col(own).alias("doc_id"), "text"))
    return _without(docs, own, found.where("not kept"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts have no words and stay. Every row is judged by its own
    whole text, also where its id is null or repeated; an empty table or benchmark
    removes nothing; further columns are kept as they are.
    """
    docs, own = _own_ids(docs)
    found = decontam.contamination(docs.select(F.col(own).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, own, found.where("contaminated"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows.

    Null texts stay null, empty ones empty; repeated rows are masked alike; of
    spans that overlap the first stands for all; further columns are kept.
    """
    return pii.mask(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless and ids of every document.

    A null text has no ids, like an empty one; repeated rows have equal ids; an
    empty table gives an empty result; other columns are left behind.
    """
    return pieces.with_ids(docs, tokenizer("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("MinHash near-dedup", distinct),
    ("benchmark decontamination", uncontaminated),
    ("PII", masked),
    ("SentencePiece encoding and decoding", encoded),
]

#: The classifier, the masking model and the encoder have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
