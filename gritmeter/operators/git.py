"""Activity of files in a window of commits (repo_id, commit_id, ts, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def parse_log(logs: DataFrame) -> DataFrame:
    """(repo_id, path, commit_count) from raw name-only logs (repo_id, log): every non-blank line is one mention."""
    line = F.explode(F.split("log", "\n"))
    return logs.select("repo_id", line.alias("l")).select("repo_id", F.regexp_replace("l", r"^\s+|\s+$", "").alias("path")).where("path != ''").groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("commit_count"))


def window(commits: DataFrame, now: Column, months: int = 1) -> DataFrame:
    """(repo_id, age_days, window_days, window_label, total_commits) as of ``now``."""
    age = F.datediff(now, F.min("ts"))
    base = commits.groupBy("repo_id").agg(age.cast("int").alias("age_days"))
    base = base.withColumn("window_days", S.auto_window(F.col("age_days"), months)).withColumn("window_label", S.window_label(F.col("window_days")))
    inside = commits.join(base, "repo_id").where(F.col("ts") >= now - F.make_dt_interval(F.col("window_days"))).groupBy("repo_id").agg(F.count_distinct("commit_id").alias("total_commits"))
    return base.join(inside, "repo_id", "left").fillna({"total_commits": 0})


def frequency(commits: DataFrame, windows: DataFrame, now: Column) -> DataFrame:
    """(repo_id, path, commit_count) within each repository's window."""
    days = windows.select("repo_id", "window_days")
    return commits.join(days, "repo_id").where(F.col("ts") >= now - F.make_dt_interval(F.col("window_days"))).groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("commit_count"))


def activity(files: DataFrame, counts: DataFrame) -> DataFrame:
    """(repo_id, active_files, active_lines, active_bytes, frozen_files, frozen_bytes): files with and without a commit in the window."""
    joined = files.select("repo_id", "path", "line_count", "size_bytes").join(counts, ["repo_id", "path"], "left")
    on = F.col("commit_count").isNotNull()
    total = lambda what, cond: F.coalesce(F.sum(F.when(cond, F.col(what))), F.lit(0)).cast("bigint")
    return joined.groupBy("repo_id").agg(
        F.count_if(on).alias("active_files"), total("line_count", on).alias("active_lines"), total("size_bytes", on).alias("active_bytes"), F.count_if(~on).alias("frozen_files"), total("size_bytes", ~on).alias("frozen_bytes")
    )


def hot_files(files: DataFrame, counts: DataFrame, top: int = 10) -> DataFrame:
    """(repo_id, rank, path, commit_count, lines) of the most changed files; ties by path."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("commit_count"), "path"))
    joined = files.select("repo_id", "path", F.col("line_count").alias("lines")).join(counts, ["repo_id", "path"])
    return joined.withColumn("rank", rank).where(F.col("rank") <= top).select("repo_id", "rank", "path", "commit_count", "lines")


def hot_complex(hot: DataFrame, functions: DataFrame, over: int = 50) -> DataFrame:
    """(repo_id, hot_complex): hot files whose functions' complexities sum to more than ``over``."""
    own = functions.join(hot.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    summed = own.groupBy("repo_id", "path").agg(F.sum("complexity").alias("c")).where(F.col("c") > over)
    return hot.join(summed, ["repo_id", "path"]).groupBy("repo_id").agg(F.count(F.lit(1)).alias("hot_complex"))
