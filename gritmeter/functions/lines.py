"""Lines of a text as most compilers count them: LF ends a line, a CR before it belongs to it, a last empty line is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_count(content: Column) -> Column:
    return F.when(content == "", 0).otherwise(F.size(F.split(content, "\n", -1)) - F.when(content.endswith("\n"), 1).otherwise(0))


def lines_of(content: Column) -> Column:
    """Array of lines."""
    parts = F.split(content, "\n", -1)
    whole = F.when(content == "", F.array().cast("array<string>")).when(content.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda x: F.regexp_replace(x, "\r$", ""))


def explode_lines(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, text) with lines from 1."""
    parts = F.posexplode(F.split("content", "\n", -1)).alias("i", "raw")
    return (
        files.where("content != ''")
        .select("repo_id", "path", F.size(F.split("content", "\n", -1)).alias("n"), parts)
        .where((F.col("raw") != "") | (F.col("i") < F.col("n") - 1))
        .select("repo_id", "path", (F.col("i") + 1).alias("line"), F.regexp_replace("raw", "\r$", "").alias("text"))
    )


def trim_space(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
