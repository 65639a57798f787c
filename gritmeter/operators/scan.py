"""File relation and what is summed up from it: languages, totals, configuration kinds, quality signals, directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scalar as S
from ..functions.lines import line_count


def files_from(df: DataFrame, repo: Column, path: Column, content: Column, keep_unknown: bool = False) -> DataFrame:
    """The base relation (repo_id, path, language, size_bytes, line_count, content) from any rows with a path and a text."""
    base = df.select(repo.alias("repo_id"), path.alias("path"), content.alias("content")).where("path is not null and content is not null").withColumn("language", S.language(F.col("path")))
    base = base if keep_unknown else base.where(F.col("language") != L.UNKNOWN)
    return base.select("repo_id", "path", "language", F.octet_length("content").cast("bigint").alias("size_bytes"), line_count(F.col("content")).cast("int").alias("line_count"), "content")


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("file_count"), F.sum("line_count").cast("bigint").alias("total_lines"), F.sum("size_bytes").cast("bigint").alias("total_bytes"))


def totals(files: DataFrame) -> DataFrame:
    """One row a repository: files, lines, bytes, longest and average file, tests, sources, large and generated files."""
    n = F.count(F.lit(1))
    tests = F.count_if(S.is_test_file(F.col("path")))
    return files.groupBy("repo_id").agg(
        n.alias("total_files"),
        F.sum("line_count").cast("bigint").alias("total_lines"),
        F.sum("size_bytes").cast("bigint").alias("total_bytes"),
        F.max("line_count").alias("max_file_lines"),
        F.floor(F.sum("line_count") / n).cast("bigint").alias("avg_file_lines"),
        tests.alias("test_files"),
        (n - tests).alias("source_files"),
        F.count_if(F.col("line_count") > 500).alias("large_files"),
        F.coalesce(F.bool_or(S.is_generated(F.col("path"))), F.lit(False)).alias("has_generated"),
    )


def source_files(files: DataFrame) -> DataFrame:
    return files.where(S.is_source(F.col("language")) & ~S.is_minified(F.col("line_count"), F.col("size_bytes")))


def parsed_files(files: DataFrame) -> DataFrame:
    return source_files(files).where(S.is_parsed(F.col("language")))


def configs(listing: DataFrame) -> DataFrame:
    """(repo_id, kind, path) of the configuration entries of a listing (repo_id, path, depth): files and directories down to depth 3."""
    spark = listing.sparkSession
    names = spark.createDataFrame([(n, k) for k, ns in L.CONFIG_NAMES.items() for n in ns], "name string, kind string")
    inside = ~F.exists(F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/"), lambda d: d.startswith(".") | d.isin("node_modules", "target", "vendor"))
    return (
        listing.where((F.col("depth") <= 3) & inside).withColumn("name", S.basename(F.col("path"))).join(F.broadcast(names), "name").select("repo_id", "kind", "path").distinct()
    )


def pyproject_kinds(files: DataFrame) -> DataFrame:
    """(repo_id, kind, path): kinds that a pyproject.toml's sections stand for."""
    found = F.array_compact(F.array(*[F.when(F.contains("content", F.lit(mark)), F.lit(kind)) for mark, kind in sorted(L.PYPROJECT.items())]))
    return files.where(S.basename(F.col("path")) == "pyproject.toml").select("repo_id", F.explode(F.array_distinct(found)).alias("kind"), "path")


def config_flags(found: DataFrame) -> DataFrame:
    """One row a repository: has_<Kind> for each of the kinds."""
    return found.groupBy("repo_id").agg(*[F.bool_or(F.col("kind") == k).alias(f"has_{k}") for k in L.CONFIG_KINDS])


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def readme_signals(texts: DataFrame) -> DataFrame:
    """(repo_id, readme_bytes, readme_has_setup) of texts (repo_id, path, content); of several READMEs the last by path."""
    low = F.lower("content")
    signal = F.struct(F.octet_length("content").cast("bigint").alias("readme_bytes"), (_contains_any(low, L.SETUP_HINTS) | _contains_any(low, L.RUN_HINTS)).alias("readme_has_setup"))
    return texts.where(S.basename(F.col("path")).isin(*L.CONFIG_NAMES["Readme"])).groupBy("repo_id").agg(F.max_by(signal, "path").alias("s")).select("repo_id", "s.*")


def build_signals(texts: DataFrame) -> DataFrame:
    """(repo_id, build_targets, build_has_standard): standard targets that any build script names."""
    targets = F.array_intersect(F.regexp_extract_all(F.lower("content"), F.lit(r"(?m)^([\w-]+)\s*:"), 1), F.array(*[F.lit(t) for t in L.BUILD_TARGETS]))
    return (
        texts.where(S.basename(F.col("path")).isin(*L.CONFIG_NAMES["BuildScript"]))
        .groupBy("repo_id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(targets)))).alias("build_targets"))
        .withColumn("build_has_standard", F.size("build_targets") > 0)
    )


def docker_signals(texts: DataFrame) -> DataFrame:
    """(repo_id, docker_useful): a compose file, or a Dockerfile that builds and runs something; the last by path decides."""
    name, up = F.lower(S.basename(F.col("path"))), F.upper("content")
    useful = F.contains(name, F.lit("compose")) | (up.rlike(r"(?m)^\s*FROM ") & up.rlike(r"(?m)^\s*(?:CMD|ENTRYPOINT|RUN) "))
    return texts.where(S.basename(F.col("path")).isin(*L.CONFIG_NAMES["Docker"])).groupBy("repo_id").agg(F.max_by(useful, "path").alias("docker_useful"))


def lockfile_fresh(listing: DataFrame) -> DataFrame:
    """(repo_id, lockfile_fresh) of a listing (repo_id, path, modified): the newest lock is no older than the newest manifest."""
    name = S.basename(F.col("path"))
    lock = F.max(F.when(name.isin(*L.CONFIG_NAMES["Lockfile"]), F.col("modified")))
    manifest = F.max(F.when(name.isin(*L.CONFIG_NAMES["DependencyManager"]), F.col("modified")))
    return listing.groupBy("repo_id").agg(F.coalesce(lock >= manifest, F.lit(False)).alias("lockfile_fresh"))


def build_seconds(breakdown: DataFrame) -> DataFrame:
    """(repo_id, build_seconds): all lines at the rate of the language with most of them; ties go to the name first in order."""
    first = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("total_lines"), "language"))
    main = breakdown.withColumn("r", first).where("r = 1").select("repo_id", F.col("language").alias("dominant_language"))
    lines = breakdown.groupBy("repo_id").agg(F.sum("total_lines").alias("lines"))
    return lines.join(main, "repo_id").select("repo_id", "dominant_language", (F.col("lines") / 1000 * S.build_factor(F.col("dominant_language"))).alias("build_seconds"))


def main_language(breakdown: DataFrame) -> DataFrame:
    """(repo_id, main_language, main_chars_per_token): the language of most files; ties go to the name first in order."""
    first = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("file_count"), "language"))
    return breakdown.withColumn("r", first).where("r = 1").select("repo_id", F.col("language").alias("main_language"), S.chars_per_token(F.col("language")).alias("main_chars_per_token"))


def directory_stats(directories: DataFrame) -> DataFrame:
    """(repo_id, max_depth, top_level_dirs) of directories (repo_id, path relative to the root, '' for it).

    Hidden directories, node_modules and target aren't entered for the depth, which
    stops at 21; only hidden ones don't count at the top.
    """
    parts = F.split("path", "/")
    closed = F.exists(parts, lambda p: p.startswith(".") | p.isin("node_modules", "target"))
    depth = F.when(F.col("path") == "", 0).otherwise(F.least(F.size(parts), F.lit(21)))
    top = F.when((F.size(parts) == 1) & (F.col("path") != "") & ~F.col("path").startswith("."), F.col("path"))
    return directories.groupBy("repo_id").agg(F.coalesce(F.max(F.when(~closed, depth)), F.lit(0)).cast("int").alias("max_depth"), F.count_distinct(top).alias("top_level_dirs"))
