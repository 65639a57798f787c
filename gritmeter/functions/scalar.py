"""Column functions over paths, languages and counts. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lookups as L


def _map(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a dot at its start begins no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    """Name of the directory that holds the file, '' at the root."""
    return F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(1)), F.lit(""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Language by lower-cased extension, then by bare file name, else Unknown."""
    return F.coalesce(_map(L.EXTENSIONS, extension(path)), _map(L.BARE_NAMES, F.lower(basename(path))), F.lit(L.UNKNOWN))


def is_source(language: Column) -> Column:
    return ~language.isin(*L.NOT_SOURCE)


def is_parsed(language: Column) -> Column:
    return language.isin(*L.PARSED)


def config_label(kind: Column) -> Column:
    return _map(L.CONFIG_LABELS, kind)


def _test_stem(path: Column) -> Column:
    s = F.lower(stem(path))
    return s.startswith("test_") | s.rlike(r"(?:_test|_spec|\.test|\.spec)$") | (s == "conftest")


def is_test_file(path: Column) -> Column:
    """A test by any directory of the path, or by its name."""
    return F.lower(path).rlike(r"/(?:__tests__|specs?|tests?)/") | _test_stem(path)


def is_test_context(path: Column) -> Column:
    """A test by its own directory alone, or by its name."""
    return _test_stem(path) | F.lower(parent_name(path)).isin(*L.TEST_DIRS)


def is_output_context(path: Column) -> Column:
    """Tests and files whose trade is printing: debug prints don't count there."""
    return is_test_context(path) | F.lower(stem(path)).isin(*L.OUTPUT_STEMS) | F.lower(parent_name(path)).isin(*L.OUTPUT_DIRS)


def is_minified(line_count: Column, size_bytes: Column) -> Column:
    return (line_count > 0) & (((line_count <= 3) & (size_bytes > 1024)) | (size_bytes / F.when(line_count > 0, line_count) > 200))


def is_app_shell(path: Column) -> Column:
    return basename(path).isin(*L.APP_SHELLS)


def is_vendor(path: Column) -> Column:
    low = F.lower(path)
    found = F.lit(False)
    for mark in L.VENDOR_MARKS:
        found = found | F.contains(low, F.lit(mark))
    return found


def is_generated(path: Column) -> Column:
    found = F.lit(False)
    for mark in L.GENERATED_MARKS:
        found = found | F.contains(path, F.lit(mark))
    return found


def layer_group(path: Column) -> Column:
    """Directory group of a repository-relative path: its first two parts if it has over two, else its first; null for a bare name.

    A leading ``.`` counts as a part but never names a group; an absolute path's
    root does both.
    """
    rooted = F.when(path.startswith("/"), F.concat(F.lit("\\/"), path.substr(F.lit(2), F.length(path)))).otherwise(path)
    parts = F.filter(F.split(F.regexp_replace(rooted, r"^\\/", "\u0001/"), "/"), lambda p: p != "")
    # Inner and trailing single dots vanish; only a leading one is a part.
    parts = F.filter(parts, lambda p, i: (p != ".") | (i == 0))
    named = F.transform(F.filter(parts, lambda p: ~p.isin(".", "..")), lambda p: F.when(p == "\u0001", F.lit("/")).otherwise(p))
    two = F.when(F.size(parts) > 2, F.concat_ws("/", F.get(named, F.lit(0)), F.get(named, F.lit(1)))).otherwise(F.get(named, F.lit(0)))
    return F.when(F.size(parts) >= 2, F.when(F.size(named) >= 2, two).otherwise(F.array_join(named, "/")))


def auto_window(age_days: Column, months: int | Column = 1) -> Column:
    """Days of the activity window: a third of the repository's age, within 7 and ``months`` times 30. Months below 1 count as 1."""
    most = F.greatest(F.lit(months) if isinstance(months, int) else months, F.lit(1)) * 30
    return F.least(F.greatest(F.floor(age_days / 3).cast("int"), F.lit(7)), most).cast("int")


def window_label(days: Column) -> Column:
    return (
        F.when(days < 14, F.concat(days.cast("string"), F.lit(" days")))
        .when(days < 60, F.concat(F.floor(days / 7).cast("string"), F.lit(" weeks")))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months")))
    )


def short_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fk", n / 1_000)).otherwise(n.cast("bigint").cast("string"))


def rating_bar(rating: Column) -> Column:
    return F.concat(F.lit("["), F.repeat(F.lit("#"), rating.cast("int")), F.repeat(F.lit("-"), (5 - rating).cast("int")), F.lit("]"))


def chars_per_token(language: Column) -> Column:
    return F.coalesce(_map(L.CHARS_PER_TOKEN, language), F.lit(3.5))


def content_tokens(content: Column, language: Column) -> Column:
    """Tokens of a text: its word characters by the language's ratio, each other visible character one."""
    word = F.char_length(F.regexp_replace(content, r"(?U)[^\p{Alnum}_]", ""))
    sign = F.char_length(F.regexp_replace(content, r"(?U)[\p{Alnum}_\s]", ""))
    return (F.ceil(word / chars_per_token(language)) + sign).cast("bigint")


def build_factor(language: Column) -> Column:
    return F.coalesce(_map(L.BUILD_FACTORS, language), F.lit(0.1))


def size_multiplier(total_bytes: Column, active_bytes: Column) -> Column:
    """Shrinks the index of what fits a model's context; active bytes count if there are any known."""
    return F.least(F.pow(F.coalesce(active_bytes, total_bytes) / 3.5 / L.USABLE_CONTEXT, F.lit(1.5)), F.lit(1.0))


def verdict(index: Column) -> Column:
    return F.when(index <= 20, "CLEAN").when(index <= 40, "ACCEPTABLE").when(index <= 60, "MESSY").when(index <= 80, "SLOPPY").otherwise("DISASTER")


def dominant_ratio(*styles: Column, mixed: Column) -> Column:
    """Share of the most frequent of the named styles; 1 of no names."""
    total = mixed
    for s in styles:
        total = total + s
    return F.when(total == 0, 1.0).otherwise(F.greatest(*styles) / F.when(total > 0, total))


def naming_style(name: Column) -> Column:
    return (
        F.when(name.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), "snake")
        .when(name.rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"), "screaming")
        .when(name.rlike(r"^[A-Z][0-9A-Za-z]*$"), "pascal")
        .when(name.rlike(r"^[a-z][0-9A-Za-z]*$"), "camel")
        .otherwise("mixed")
    )


def path_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path is left out: a user pattern, its outer stars then slashes stripped, is part of it, or a component is a skipped directory."""
    out = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in L.SKIPPED_PARTS]))
    for p in patterns:
        out = out | F.contains(path, F.lit(p.strip("*").strip("/")))
    return out


def has_word(text: Column, word: Column) -> Column:
    """Whether ``word`` stands in ``text`` with no ASCII letter, digit or underscore beside it."""
    return F.rlike(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), word, F.lit(r"\E(?![A-Za-z0-9_])")))


def half_away(value: float) -> int:
    return math.floor(abs(value) + 0.5) * (1 if value >= 0 else -1)
