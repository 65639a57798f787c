"""Continuous scanning: texts that arrive in a landing folder are examined as they come.

Per-line and per-file findings keep no state; totals by repository are aggregates that
Structured Streaming updates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patterns
from ..operators import scan as scanning

SCHEMA = "repo_id string, path string, content string"


def texts(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of rows (repo_id, path, content) from Parquet files that land in ``folder``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def findings(stream: DataFrame) -> DataFrame:
    """Anti-pattern rows of a stream of texts."""
    return patterns.anti_patterns(scanning.source_files(scanning.files_from(stream, F.col("repo_id"), F.col("path"), F.col("content"))))


def running_totals(stream: DataFrame) -> DataFrame:
    """(repo_id, language, file_count, total_lines, total_bytes) so far; write in update or complete mode."""
    return scanning.language_breakdown(scanning.files_from(stream, F.col("repo_id"), F.col("path"), F.col("content")))
