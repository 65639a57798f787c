"""scan -> analyze -> score -> recommend: lazy relations for one repository or many in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import deadcode, duplication, git, graph, parsing, patterns, scan as scanning, search
from .plans import score as scoring
from .plans.cut import cut
from .sources import files as sources


@dataclass
class Scan:
    """Relations of the scanned repositories, each with repo_id."""

    files: DataFrame
    configs: DataFrame
    texts: DataFrame
    listing: DataFrame | None = None
    commits: DataFrame | None = None
    now: Column | None = None
    months: int = 1


@dataclass
class Analysis:
    functions: DataFrame
    imports: DataFrame
    hazards: DataFrame
    anti_patterns: DataFrame
    global_mutables: DataFrame
    clusters: DataFrame
    wide: DataFrame


@dataclass
class Score:
    index: DataFrame
    dimensions: DataFrame
    budget: DataFrame


def scan(spark: SparkSession, roots: dict[str, str], ignore: list[str] | None = None, use_git: bool = True, months: int = 1) -> Scan:
    """Scan folders (repo_id -> root)."""
    listed = cut(sources.listing(spark, roots))
    found = cut(sources.files(listed, ignore))
    named = scanning.configs(listed)
    wanted = listed.join(named.select("repo_id", "path"), ["repo_id", "path"], "left_semi").where("not is_dir")
    texts = cut(sources.read_texts(wanted))
    configs = cut(named.unionByName(scanning.pyproject_kinds(texts)))
    commits = cut(sources.commits(spark, roots)) if use_git else None
    return Scan(found, configs, texts, listed, commits, F.current_timestamp(), months)


def scan_rows(files: DataFrame, commits: DataFrame | None = None, now: Column | None = None, months: int = 1) -> Scan:
    """Scan rows (repo_id, path, content): any table of texts with paths."""
    found = cut(scanning.files_from(files, F.col("repo_id"), F.col("path"), F.col("content")))
    texts = files.select("repo_id", "path", "content")
    folders = texts.select("repo_id", "path").select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))).alias("path")).distinct()
    listed = folders.withColumn("depth", F.size(F.split("path", "/")))
    configs = cut(scanning.configs(listed).unionByName(scanning.pyproject_kinds(texts)))
    return Scan(found, configs, texts, None, commits, now if now is not None else F.current_timestamp(), months)


def _directories(s: Scan) -> DataFrame:
    roots = s.files.select("repo_id").distinct().select("repo_id", F.lit("").alias("path"))
    if s.listing is not None:
        return s.listing.where("is_dir").select("repo_id", "path").unionByName(roots)
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return s.files.select("repo_id", F.explode(up).alias("path")).distinct().unionByName(roots).distinct()


def _activity(s: Scan, functions: DataFrame) -> list[DataFrame]:
    if s.commits is None:
        return []
    windows = git.window(s.commits, s.now, s.months)
    counts = git.frequency(s.commits, windows, s.now)
    hot = cut(git.hot_files(s.files, counts))
    names = hot.where("rank <= 3").groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", S.basename(F.col("path")).alias("name")))), lambda x: x["name"]), ", ").alias("hot_names"))
    return [git.activity(s.files, counts), windows.drop("age_days").withColumn("is_git", F.lit(True)), names, git.hot_complex(hot, functions)]


def _wide(parts: list[DataFrame]) -> DataFrame:
    """One row a repository with the columns of all ``parts``, each of which has a row a repository at most; one shuffle, whatever their number."""
    every, names = None, []
    for part in parts:
        own = [c for c in part.columns if c in scoring.DEFAULTS]
        names += own
        part = part.select("repo_id", F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("string"))]).alias("m"))
        every = part if every is None else every.unionAll(part)
    return every.groupBy("repo_id").agg(*[F.max(F.try_element_at("m", F.lit(c))).alias(c) for c in dict.fromkeys(names)])


def analyze(s: Scan, strict_compat: bool = False) -> Analysis:
    """All derived relations, and one wide row a repository."""
    files = s.files
    code = scanning.source_files(files)
    parsed = cut(parsing.parse(scanning.parsed_files(files), strict_compat))
    functions, imports, hazards = parsing.functions(parsed), parsing.imports(parsed), parsing.hazards(parsed)
    found = patterns.anti_patterns(code)
    mutables = patterns.global_mutables(code)
    clusters = cut(duplication.clusters(code))
    breakdown = cut(scanning.language_breakdown(files))
    large = parsing.complex_large_files(files, functions)
    main = scanning.main_language(breakdown).select("repo_id", "main_chars_per_token")
    tokens = breakdown.groupBy("repo_id").agg(F.sum(F.ceil(F.col("total_bytes") / S.chars_per_token(F.col("language")))).alias("total_tokens"))
    count = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    stats = graph.import_stats(imports, files).withColumn("largest_members", F.array_join(F.transform(F.slice("largest_members", 1, 5), lambda m: S.basename(m)), " -> "))
    parts = [
        scanning.directory_stats(_directories(s)),
        scanning.config_flags(s.configs),
        scanning.readme_signals(s.texts),
        scanning.build_signals(s.texts).select("repo_id", "build_has_standard"),
        scanning.docker_signals(s.texts),
        scanning.build_seconds(breakdown).select("repo_id", "build_seconds"),
        main,
        tokens,
        parsing.function_stats(functions),
        count(large, "complex_large"),
        patterns.pattern_counts(found),
        count(mutables, "global_mutables"),
        count(hazards, "hazards"),
        patterns.naming(functions).select("repo_id", "dominant_ratio"),
        stats,
        graph.layers(imports, files).select("repo_id", "layer_violations", "god_modules"),
        search.searchability(files, functions),
        deadcode.dead_code(functions, imports, files),
        duplication.duplicate_totals(clusters).select("repo_id", F.col("cluster_count")),
        *([scanning.lockfile_fresh(s.listing)] if s.listing is not None else []),
        *_activity(s, functions),
    ]
    return Analysis(functions, imports, hazards, found, mutables, clusters, cut(scoring.complete(_wide([scanning.totals(files), *parts]))))


def score(analysis: Analysis) -> Score:
    return Score(scoring.index(analysis.wide), scoring.dimensions(analysis.wide), scoring.budget(analysis.wide))


def recommend(s: Scan, analysis: Analysis, top: int = 10) -> DataFrame:
    large = parsing.complex_large_files(s.files, analysis.functions)
    return scoring.recommendations(analysis.wide, large, scoring.worst_function(analysis.functions), top)
