"""Regular-expression findings on lines, and naming styles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scalar as S
from ..functions.lines import explode_lines


def anti_patterns(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, pattern), one row for each pattern that a line matches; all patterns are tried in one pass over the lines."""
    exempt = S.is_output_context(F.col("path"))
    hits = [F.when((F.lit(not ctx) | ~F.col("exempt")) & F.col("text").rlike(rx), F.lit(name)) for name, (rx, ctx) in sorted(L.ANTI_PATTERNS.items())]
    return explode_lines(files).withColumn("exempt", exempt).select("repo_id", "path", "line", F.explode(F.array_compact(F.array(*hits))).alias("pattern"))


def pattern_counts(found: DataFrame) -> DataFrame:
    side = F.col("pattern").isin("bare_except", "debug_print")
    return found.groupBy("repo_id").agg(F.count(F.lit(1)).alias("anti_patterns"), F.count_if(side).alias("side_effects"))


def global_mutables(files: DataFrame) -> DataFrame:
    """(repo_id, path, line) of lines that declare mutable globals, outside of tests."""
    t = F.col("text")
    plain = ~t.rlike(r"^(#|//|\s|$)")
    return explode_lines(files.where(~S.is_test_context(F.col("path")))).where(plain & (t.rlike(L.GLOBAL_VAR) | t.rlike(L.GLOBAL_OTHER))).select("repo_id", "path", "line")


def naming(functions: DataFrame) -> DataFrame:
    """(repo_id, snake, camel, pascal, screaming, mixed, dominant_ratio) of named functions."""
    named = functions.where("name != '' and name != '<anonymous>'").withColumn("style", S.naming_style(F.col("name")))
    styles = ("snake", "camel", "pascal", "screaming")
    got = named.groupBy("repo_id").agg(*[F.count_if(F.col("style") == s).alias(s) for s in (*styles, "mixed")])
    return got.withColumn("dominant_ratio", S.dominant_ratio(*[F.col(s) for s in styles], mixed=F.col("mixed")))
