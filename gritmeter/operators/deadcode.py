"""Functions that nothing else seems to use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scalar as S

#: Characters of a stem, at most, and of a name by which they are joined with what may hold them.
_MODULE_GRAM, _NAME_GRAM = 4, 8


def _grams(text: Column, sizes: Iterable[int]) -> Column:
    """Distinct sub-strings of these sizes."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    own = [F.when(F.length(text) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in sizes]
    return F.array_distinct(F.concat(*own))


def _words(files: DataFrame) -> DataFrame:
    """(repo_id, by, word): distinct identifiers of each text."""
    return files.select("repo_id", F.col("path").alias("by"), F.explode(F.array_distinct(F.split("content", "[^A-Za-z0-9_]+"))).alias("word")).where("word != ''")


def candidates(functions: DataFrame) -> DataFrame:
    """First function of each long enough, unhooked name, in order of path, line and place."""
    low = F.lower("name")
    hooked = F.lit(False)
    for p in L.FRAMEWORK_PREFIXES:
        hooked = hooked | low.startswith(p)
    fit = ~F.col("name").startswith("test") & ~F.col("name").startswith("Test") & ~F.col("name").startswith("__") & (F.col("name") != "<anonymous>") & (F.col("line_count") >= 15) & (F.octet_length("name") >= 8) & ~hooked
    first = F.row_number().over(Window.partitionBy("repo_id", "name").orderBy("path", "start_line", "line_count"))
    return functions.where(fit).withColumn("r", first).where("r = 1").drop("r")


def connected(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo_id, path) of files that another file imports, their stem being part of the module string, or whose stem of four bytes or more another file has as a word.

    Both are equi-joins followed by the exact test.
    """
    stems = files.select("repo_id", "path", S.stem(F.col("path")).alias("stem")).where("stem != ''")
    modules = imports.select("repo_id", F.col("path").alias("by"), "module_path").distinct()
    # A stem that is part of a module string starts with one of its grams: an equi-join on those, then the test.
    keyed = stems.withColumn("gram", F.substring("stem", 1, _MODULE_GRAM))
    grams = modules.withColumn("gram", F.explode(_grams(F.col("module_path"), range(1, _MODULE_GRAM + 1)))).join(keyed.select("repo_id", "gram").distinct(), ["repo_id", "gram"], "left_semi")
    by_import = keyed.join(grams, ["repo_id", "gram"]).where(F.contains("module_path", F.col("stem")) & (F.col("by") != F.col("path"))).select("repo_id", "path")
    long = stems.where(F.octet_length("stem") >= 4)
    plain = long.where(F.col("stem").rlike("^[A-Za-z0-9_]+$"))
    words = _words(files).withColumnRenamed("word", "stem")
    by_word = plain.join(words.join(plain.select("repo_id", "stem").distinct(), ["repo_id", "stem"], "left_semi"), ["repo_id", "stem"]).where("by != path").select("repo_id", "path")
    odd = long.where(~F.col("stem").rlike("^[A-Za-z0-9_]+$"))
    # Other stems are looked for where their first run of identifier characters is a word; few have none.
    runs = odd.withColumn("word", F.regexp_extract("stem", "[A-Za-z0-9_]+", 0))
    texts = files.select("repo_id", F.col("path").alias("by"), "content")
    met = runs.where("word != ''").join(words.withColumnRenamed("stem", "word"), ["repo_id", "word"]).select("repo_id", "path", "stem", "by").join(texts, ["repo_id", "by"])
    met = met.unionByName(runs.where("word = ''").drop("word").join(texts, "repo_id"))
    by_odd = met.where((F.col("by") != F.col("path")) & S.has_word(F.col("content"), F.col("stem"))).select("repo_id", "path")
    return by_import.unionByName(by_word).unionByName(by_odd).distinct()


def unreferenced(functions: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, name, path, line_count) of candidates in unconnected files whose name is no part of an import and no part of another file's text."""
    left = candidates(functions).join(connected(files, imports), ["repo_id", "path"], "left_anti")
    parts = imports.select("repo_id", F.explode(F.split("module_path", r"[/.:\\, ]")).alias("name")).where("name != ''").distinct()
    left = left.join(parts, ["repo_id", "name"], "left_anti").select("repo_id", "name", "path", "line_count")
    plain = left.where(F.col("name").rlike("^[A-Za-z0-9_]+$")).withColumn("gram", F.substring("name", 1, _NAME_GRAM))
    # A name of identifier characters stands inside a word of theirs: words are joined by the name's first characters, then tested.
    words = _words(files).where(F.length("word") >= _NAME_GRAM)
    grams = words.select("repo_id", "word").distinct().withColumn("gram", F.explode(_grams(F.col("word"), [_NAME_GRAM])))
    near = plain.join(grams, ["repo_id", "gram"]).where(F.contains("word", F.col("name"))).select("repo_id", "name", "path", "word")
    used = near.join(words, ["repo_id", "word"]).where("by != path").select("repo_id", "name")
    odd = left.where(~F.col("name").rlike("^[A-Za-z0-9_]+$"))
    texts = files.select("repo_id", F.col("path").alias("by"), "content")
    by_odd = odd.join(texts, "repo_id").where((F.col("by") != F.col("path")) & F.contains("content", F.col("name"))).select("repo_id", "name")
    return left.join(used.unionByName(by_odd).distinct(), ["repo_id", "name"], "left_anti")


def dead_code(functions: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, unreferenced_functions, unreferenced_lines)."""
    found = unreferenced(functions, imports, files).groupBy("repo_id").agg(F.count(F.lit(1)).alias("unreferenced_functions"), F.sum("line_count").cast("bigint").alias("unreferenced_lines"))
    return files.select("repo_id").distinct().join(found, "repo_id", "left").fillna({"unreferenced_functions": 0, "unreferenced_lines": 0})
