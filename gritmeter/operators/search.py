"""How findable names are: repeated file names, functions of one name in many files, generic names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scalar as S


def _worst(df: DataFrame, name: str, count: str, prefix: str) -> DataFrame:
    """Rows a repository and the worst of them; ties go to the name first in order."""
    worst = F.min_by(F.struct(F.col(name), F.col(count)), F.struct(-F.col(count), F.col(name)))
    return df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(f"{prefix}_count"), worst.alias("w")).select("repo_id", f"{prefix}_count", F.col(f"w.{name}").alias(f"{prefix}_worst"), F.col(f"w.{count}").alias(f"{prefix}_worst_count"))


def duplicate_filenames(files: DataFrame) -> DataFrame:
    """(repo_id, name, files) of file names that occur more than once."""
    return files.groupBy("repo_id", S.basename(F.col("path")).alias("name")).agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def name_collisions(functions: DataFrame, least: int = 3) -> DataFrame:
    """(repo_id, name, files) of function names that stand in ``least`` files or more; anonymous and structural ones aside."""
    return functions.where(~F.col("name").isin("<anonymous>", *L.STRUCTURAL_NAMES)).groupBy("repo_id", "name").agg(F.count_distinct("path").alias("files")).where(F.col("files") >= least)


def generic_names(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, generic_count): files with a generic stem and functions with a generic name."""
    one = files.where(S.stem(F.col("path")).isin(*L.GENERIC_NAMES)).select("repo_id")
    two = functions.where(F.col("name").isin(*L.GENERIC_NAMES)).select("repo_id")
    return one.unionAll(two).groupBy("repo_id").agg(F.count(F.lit(1)).alias("generic_count"))


def searchability(files: DataFrame, functions: DataFrame) -> DataFrame:
    """All three a repository, zeros where there is nothing."""
    dup = _worst(duplicate_filenames(files), "name", "files", "dup")
    coll = _worst(name_collisions(functions), "name", "files", "coll")
    zero = {"dup_count": 0, "coll_count": 0, "generic_count": 0}
    return files.select("repo_id").distinct().join(dup, "repo_id", "left").join(coll, "repo_id", "left").join(generic_names(files, functions), "repo_id", "left").fillna(zero)
