"""Registered queries over the driver's tables, and the SQL that gives the same rows elsewhere."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions import scalar as S
from ..operators import deadcode, duplication, git, graph, parsing, patterns, search
from ..operators import scan as scanning
from ..streaming import landing
from . import fixtures as X
from . import score
from .cut import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_EXTENSIONS = [".py", ".js", ".rs", ".md", ".txt"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rows(df: DataFrame) -> DataFrame:
    """documents as texts with paths."""
    ext = F.get(F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("doc_id") % len(_EXTENSIONS)).cast("int"))
    return df.select(F.col("source").alias("repo_id"), F.concat(F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("text").alias("content"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return scanning.files_from(_rows(_read(spark, d, "documents")), F.col("repo_id"), F.col("path"), F.col("content"))


_LINES = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, chr(10))) - CASE WHEN {0} LIKE '%' || chr(10) THEN 1 ELSE 0 END END"
_FILES = (
    "files AS (SELECT source AS repo_id, lang || '/doc' || doc_id || (['.py', '.js', '.rs', '.md', '.txt'])[doc_id % 5 + 1] AS path, "
    "(['Python', 'JavaScript', 'Rust', 'Markdown', 'Unknown'])[doc_id % 5 + 1] AS language, strlen(text) AS size_bytes, " + _LINES.format("text") + " AS line_count, text AS content "
    "FROM documents WHERE doc_id % 5 <> 4)"
)


@query(f"WITH {_FILES} SELECT repo_id, language, count(*) AS file_count, CAST(sum(line_count) AS BIGINT) AS total_lines, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM files GROUP BY 1, 2")
def lang_breakdown(spark, d):
    return scanning.language_breakdown(_files(spark, d))


@query(
    f"WITH {_FILES} SELECT repo_id, count(*) AS total_files, CAST(sum(line_count) AS BIGINT) AS total_lines, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, max(line_count) AS max_file_lines, "
    "CAST(sum(line_count) // count(*) AS BIGINT) AS avg_file_lines, CAST(0 AS BIGINT) AS test_files, count(*) AS source_files, count(*) FILTER (line_count > 500) AS large_files, false AS has_generated FROM files GROUP BY 1"
)
def file_totals(spark, d):
    return scanning.totals(_files(spark, d))


@query(
    "WITH f AS (SELECT page_id, strlen(html) AS b, " + _LINES.format("html") + " AS n FROM pages WHERE html IS NOT NULL) "
    "SELECT page_id, n > 0 AND ((n <= 3 AND b > 1024) OR b > 200 * n) AS minified FROM f"
)
def minified_files(spark, d):
    from ..functions.lines import line_count

    p = _read(spark, d, "pages").where("html is not null")
    return p.select("page_id", S.is_minified(line_count(F.col("html")), F.octet_length("html")).alias("minified"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Odd paths, and one of them for each document below a folder of its language."""
    more = X.by_document(spark, _read(spark, d, "documents").select("doc_id", "lang"), "path string", X.PATHS)
    return X.table(spark, "path string", X.PATHS).unionAll(more.select(F.concat("lang", F.lit("/"), "path").alias("path")))


_P = X.numbered("p0", "path", X.PATHS) + f", p AS (SELECT path FROM p0 UNION ALL SELECT lang || '/' || path FROM documents JOIN p0 ON doc_id % {len(X.PATHS)} = k)"
_BASE = "regexp_extract(path, '[^/]*$')"

_STEM = f"(CASE WHEN regexp_matches({_BASE}, '^.+[.][^.]*$') THEN regexp_replace({_BASE}, '[.][^.]*$', '') ELSE {_BASE} END)"
_PARENT = "coalesce(string_split(path, '/')[-2], '')"
_TESTSTEM = f"(lower({_STEM}) LIKE 'test\\_%' ESCAPE '\\' OR regexp_matches(lower({_STEM}), '(_test|_spec|[.]test|[.]spec)$') OR lower({_STEM}) = 'conftest')"


def _list_sql(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


@query(
    f"WITH {_P}, {X.values('e', 'ext, language', sorted(L.EXTENSIONS.items()))}, {X.values('b', 'name, language', sorted(L.BARE_NAMES.items()))}, "
    f"k AS (SELECT path, coalesce(e.language, b.language, 'Unknown') AS language FROM p LEFT JOIN e ON e.ext = lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) LEFT JOIN b ON b.name = lower({_BASE})) "
    f"SELECT path, language, language NOT IN {_list_sql(L.NOT_SOURCE)} AS source, language IN {_list_sql(L.PARSED)} AS parsed FROM k"
)
def language_detect(spark, d):
    return _paths(spark, d).withColumn("language", S.language(F.col("path"))).select("path", "language", S.is_source(F.col("language")).alias("source"), S.is_parsed(F.col("language")).alias("parsed"))


@query(f"WITH {_P} SELECT path, regexp_matches(lower(path), '/(test|tests|spec|specs|__tests__)/') OR {_TESTSTEM} AS test FROM p")
def test_files(spark, d):
    return _paths(spark, d).select("path", S.is_test_file(F.col("path")).alias("test"))


@query(
    f"WITH {_P}, t AS (SELECT path, {_TESTSTEM} OR lower({_PARENT}) IN {_list_sql(L.TEST_DIRS)} AS test FROM p) "
    f"SELECT path, test, test OR lower({_STEM}) IN {_list_sql(L.OUTPUT_STEMS)} OR lower({_PARENT}) IN {_list_sql(L.OUTPUT_DIRS)} AS output FROM t"
)
def test_context(spark, d):
    return _paths(spark, d).select("path", S.is_test_context(F.col("path")).alias("test"), S.is_output_context(F.col("path")).alias("output"))


@query(f"WITH {_P} SELECT path, len(list_intersect(string_split(path, '/'), {'[' + _list_sql(L.SKIPPED_PARTS)[1:-1] + ']'})) > 0 OR contains(path, 'third_party') OR contains(path, 'z/deep') AS skipped FROM p")
def path_skip(spark, d):
    return _paths(spark, d).select("path", S.path_ignored(F.col("path"), ["*third_party/*", "z/deep*"]).alias("skipped"))


@query(
    f"WITH {_P}, q AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS a FROM p), "
    "r AS (SELECT path, len(a) AS n, list_filter(a, lambda x: x NOT IN ('.', '..')) AS g FROM q) "
    "SELECT path, CASE WHEN n < 2 THEN NULL WHEN len(g) >= 2 AND n > 2 THEN g[1] || '/' || g[2] WHEN len(g) >= 2 THEN g[1] ELSE array_to_string(g, '/') END AS grp FROM r"
)
def layer_groups(spark, d):
    return _paths(spark, d).select("path", S.layer_group(F.col("path")).alias("grp"))


_NAMES = X.values("n", "name, kind", [(x, k) for k, xs in L.CONFIG_NAMES.items() for x in xs])
_LISTED = X.numbered("l0", "repo_id, path, depth", X.LISTING) + f", l AS (SELECT repo_id, path, depth FROM l0 UNION ALL SELECT source, 'm' || doc_id || '/' || path, depth + 1 FROM documents JOIN l0 ON doc_id % {len(X.LISTING)} = k)"
_CONFIGS = f"{_LISTED}, {_NAMES}, c AS (SELECT DISTINCT repo_id, kind, path FROM l JOIN n ON n.name = {_BASE} WHERE depth <= 3 AND NOT regexp_matches(path, '(^|/)([.][^/]*|node_modules|target|vendor)/'))"


@query(f"WITH {_CONFIGS} SELECT * FROM c")
def config_kinds(spark, d):
    kind = "repo_id string, path string, depth int"
    more = X.by_document(spark, _read(spark, d, "documents").select("doc_id", "source"), kind, X.LISTING)
    return scanning.configs(X.table(spark, kind, X.LISTING).unionByName(more.select(F.col("source").alias("repo_id"), _moved(), (F.col("depth") + 1).alias("depth"))))


@query(f"WITH {_CONFIGS} SELECT repo_id, " + ", ".join(f"bool_or(kind = '{k}') AS has_{k}" for k in L.CONFIG_KINDS) + " FROM c GROUP BY 1")
def config_flags(spark, d):
    return scanning.config_flags(config_kinds(spark, d))


_TEXTS = X.numbered("t0", "repo_id, path, content", X.CONFIG_TEXTS) + f", t AS (SELECT repo_id, path, content FROM t0 UNION ALL SELECT source, 'm' || doc_id || '/' || path, content FROM documents JOIN t0 ON doc_id % {len(X.CONFIG_TEXTS)} = k)"
_TEXT_ROWS = "repo_id string, path string, content string"


def _moved() -> Column:
    return F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit("/"), "path").alias("path")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Configuration texts, and one of them for each document in the repository of its source."""
    more = X.by_document(spark, _read(spark, d, "documents").select("doc_id", "source"), _TEXT_ROWS, X.CONFIG_TEXTS)
    return X.table(spark, _TEXT_ROWS, X.CONFIG_TEXTS).unionByName(more.select(F.col("source").alias("repo_id"), _moved(), "content"))


@query(f"WITH {_TEXTS}, {X.values('m', 'mark, kind', sorted(L.PYPROJECT.items()))} SELECT DISTINCT repo_id, kind, path FROM t JOIN m ON contains(content, mark) WHERE {_BASE} = 'pyproject.toml'")
def pyproject_kinds(spark, d):
    return scanning.pyproject_kinds(_texts(spark, d))


@query(
    f"WITH {_TEXTS}, {X.values('h', 'hint', [*L.SETUP_HINTS, *L.RUN_HINTS])}, r AS (SELECT repo_id, path, content FROM t WHERE {_BASE} IN {_list_sql(L.CONFIG_NAMES['Readme'])} QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path DESC) = 1) "
    "SELECT repo_id, strlen(content) AS readme_bytes, EXISTS (SELECT 1 FROM h WHERE contains(lower(content), hint)) AS readme_has_setup FROM r"
)
def readme_signals(spark, d):
    return scanning.readme_signals(_texts(spark, d))


@query(
    f"WITH {_TEXTS}, s AS (SELECT repo_id, content FROM t WHERE {_BASE} IN {_list_sql(L.CONFIG_NAMES['BuildScript'])}), k AS (SELECT repo_id, unnest(regexp_extract_all(lower(content), '(?m)^([\\w-]+)\\s*:', 1)) AS x FROM s), "
    f"g AS (SELECT repo_id, count(DISTINCT x) FILTER (x IN {_list_sql(L.BUILD_TARGETS)}) AS n FROM k GROUP BY 1) SELECT DISTINCT s.repo_id, CAST(coalesce(n, 0) AS BIGINT) AS targets, coalesce(n, 0) > 0 AS build_has_standard FROM s LEFT JOIN g USING (repo_id)"
)
def build_targets(spark, d):
    return scanning.build_signals(_texts(spark, d)).select("repo_id", F.size("build_targets").cast("bigint").alias("targets"), "build_has_standard")


@query(
    f"WITH {_TEXTS}, k AS (SELECT repo_id, content, lower({_BASE}) AS name FROM t WHERE {_BASE} IN {_list_sql(L.CONFIG_NAMES['Docker'])} QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path DESC) = 1) "
    "SELECT repo_id, contains(name, 'compose') OR (regexp_matches(upper(content), '(?m)^\\s*FROM ') AND regexp_matches(upper(content), '(?m)^\\s*(RUN|CMD|ENTRYPOINT) ')) AS docker_useful FROM k"
)
def docker_signals(spark, d):
    return scanning.docker_signals(_texts(spark, d))


@query(
    "WITH p AS (SELECT source AS repo_id, lang, doc_id, ['', lang, lang || '/' || (doc_id % 7), lang || '/.hide/' || (doc_id % 3), 'target/x/y/z', lang || '/a/b/' || (doc_id % 2)][doc_id % 6 + 1] AS path FROM documents), "
    "q AS (SELECT DISTINCT repo_id, path, string_split(path, '/') AS a FROM p) "
    "SELECT repo_id, CAST(coalesce(max(CASE WHEN path = '' THEN 0 ELSE len(a) END) FILTER (len(list_filter(a, lambda x: x LIKE '.%' OR x IN ('node_modules', 'target'))) = 0), 0) AS INT) AS max_depth, "
    "count(DISTINCT CASE WHEN len(a) = 1 AND path <> '' AND path NOT LIKE '.%' THEN path END) AS top_level_dirs FROM q GROUP BY 1"
)
def dir_depth(spark, d):
    k, lang = F.col("doc_id"), F.col("lang")
    paths = F.array(F.lit(""), lang, F.concat(lang, F.lit("/"), (k % 7).cast("string")), F.concat(lang, F.lit("/.hide/"), (k % 3).cast("string")), F.lit("target/x/y/z"), F.concat(lang, F.lit("/a/b/"), (k % 2).cast("string")))
    return scanning.directory_stats(_read(spark, d, "documents").select(F.col("source").alias("repo_id"), F.get(paths, (k % 6).cast("int")).alias("path")).distinct())


_CODE = X.numbered("code0", "repo_id, path, content", X.CODE) + f", code AS (SELECT repo_id, path, content FROM code0 UNION ALL SELECT source, 'm' || doc_id || '/' || path, content || text FROM documents JOIN code0 ON doc_id % {len(X.CODE)} = k WHERE text IS NOT NULL)"
_CODELINES = f"{_CODE}, cl AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM code), cx AS (SELECT *, ({_TESTSTEM} OR lower({_PARENT}) IN {_list_sql(L.TEST_DIRS)}) AS test, ({_TESTSTEM} OR lower({_PARENT}) IN {_list_sql(L.TEST_DIRS)} OR lower({_STEM}) IN {_list_sql(L.OUTPUT_STEMS)} OR lower({_PARENT}) IN {_list_sql(L.OUTPUT_DIRS)}) AS exempt FROM cl)"
_PATTERNS = X.values("rx", "pattern, regex, ctx", [(k, r, c) for k, (r, c) in sorted(L.ANTI_PATTERNS.items())])
_HITS = f"{_CODELINES}, {_PATTERNS}, hits AS (SELECT repo_id, path, line, pattern FROM cx, rx WHERE regexp_matches(text, regex) AND NOT (ctx AND exempt))"


def _code(spark: SparkSession, d: str) -> DataFrame:
    """Code, and every document behind one of its texts."""
    more = X.by_document(spark, _read(spark, d, "documents").where("text is not null").select("doc_id", "source", "text"), _TEXT_ROWS, X.CODE)
    rows = X.table(spark, _TEXT_ROWS, X.CODE).unionByName(more.select(F.col("source").alias("repo_id"), _moved(), F.concat("content", "text").alias("content")))
    return scanning.files_from(rows, F.col("repo_id"), F.col("path"), F.col("content"))


@query(f"WITH {_HITS} SELECT repo_id, path, CAST(line AS INT) AS line, pattern FROM hits")
def anti_patterns(spark, d):
    return patterns.anti_patterns(_code(spark, d))


@query(f"WITH {_HITS} SELECT repo_id, count(*) AS anti_patterns, count(*) FILTER (pattern IN ('debug_print', 'bare_except')) AS side_effects FROM hits GROUP BY 1")
def anti_pattern_counts(spark, d):
    return patterns.pattern_counts(patterns.anti_patterns(_code(spark, d)))


@query(
    f"WITH {_FILES}, {_PATTERNS}, ln AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS text FROM files WHERE language <> 'Markdown') SELECT repo_id, pattern, count(*) AS n FROM ln, rx WHERE regexp_matches(text, regex) GROUP BY 1, 2"
)
def document_patterns(spark, d):
    return patterns.anti_patterns(_files(spark, d).where(S.is_source(F.col("language")))).groupBy("repo_id", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_CODELINES} SELECT repo_id, path, CAST(line AS INT) AS line FROM cx WHERE NOT test AND text <> '' AND NOT regexp_matches(text, '^(//|#|[ \\t])') "
    "AND (regexp_matches(text, '^var\\s+\\w+\\s*=') OR regexp_matches(text, '^[A-Z_]{2,}\\s*=\\s*\\[') OR regexp_matches(text, '^[A-Z_]{2,}\\s*=\\s*\\{') OR regexp_matches(text, '^static\\s+mut\\s'))"
)
def global_mutables(spark, d):
    return patterns.global_mutables(_code(spark, d))


_STYLES = (
    "CASE WHEN regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)*') THEN 'snake' WHEN regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*') THEN 'screaming' "
    "WHEN regexp_full_match(name, '[A-Z][a-zA-Z0-9]*') THEN 'pascal' WHEN regexp_full_match(name, '[a-z][a-zA-Z0-9]*') THEN 'camel' ELSE 'mixed' END"
)
_PART = (
    "fn AS (SELECT p_brand AS repo_id, p_type AS path, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN upper(replace(p_name, ' ', '_')) WHEN 2 THEN replace(p_name, ' ', 'X') WHEN 3 THEN 'Q' || replace(p_name, ' ', 'x') ELSE p_name END AS name FROM part)"
)


def _part_functions(spark: SparkSession, d: str) -> DataFrame:
    k, joined = F.col("p_partkey") % 5, lambda by: F.replace(F.col("p_name"), F.lit(" "), F.lit(by))
    name = F.when(k == 0, joined("_")).when(k == 1, F.upper(joined("_"))).when(k == 2, joined("X")).when(k == 3, F.concat(F.lit("Q"), joined("x"))).otherwise(F.col("p_name"))
    return _read(spark, d, "part").select(F.col("p_brand").alias("repo_id"), F.col("p_type").alias("path"), name.alias("name"))


@query(
    f"WITH {_PART}, s AS (SELECT repo_id, {_STYLES} AS style FROM fn), c AS (SELECT repo_id, count(*) FILTER (style = 'snake') AS snake, count(*) FILTER (style = 'camel') AS camel, count(*) FILTER (style = 'pascal') AS pascal, "
    "count(*) FILTER (style = 'screaming') AS screaming, count(*) FILTER (style = 'mixed') AS mixed FROM s GROUP BY 1) SELECT *, greatest(snake, camel, pascal, screaming) / (snake + camel + pascal + screaming + mixed) AS dominant_ratio FROM c"
)
def naming_styles(spark, d):
    return patterns.naming(_part_functions(spark, d))


_PAGEFILES = "pf AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS repo_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/?', '') AS path FROM pages WHERE url IS NOT NULL)"


def _page_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*/?", "")
    return _read(spark, d, "pages").where("url is not null").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("repo_id"), path.alias("path"))


@query(f"WITH {_PAGEFILES} SELECT repo_id, {_BASE} AS name, count(*) AS files FROM pf GROUP BY 1, 2 HAVING count(*) > 1")
def dup_filenames(spark, d):
    return search.duplicate_filenames(_page_files(spark, d))


_WORDFN = "fn AS (SELECT lang AS repo_id, source AS path, CASE doc_id % 9 WHEN 0 THEN 'init' WHEN 1 THEN '<anonymous>' ELSE word END AS name FROM (SELECT lang, source, doc_id, unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL))"


def _word_functions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 9
    name = F.when(k == 0, "init").when(k == 1, "<anonymous>").otherwise(F.col("word"))
    words = _read(spark, d, "documents").where("text is not null").select("lang", "source", "doc_id", F.explode(F.split("text", " ")).alias("word"))
    return words.select(F.col("lang").alias("repo_id"), F.col("source").alias("path"), name.alias("name"))


@query(f"WITH {_WORDFN} SELECT repo_id, name, count(DISTINCT path) AS files FROM fn WHERE name NOT IN {_list_sql(['<anonymous>', *L.STRUCTURAL_NAMES])} GROUP BY 1, 2 HAVING count(DISTINCT path) >= 3")
def name_collisions(spark, d):
    return search.name_collisions(_word_functions(spark, d))


@query(
    f"WITH {_WORDFN}, {_P}, g AS (SELECT repo_id FROM fn WHERE name IN {_list_sql(L.GENERIC_NAMES)} UNION ALL SELECT 'en' FROM p WHERE {_STEM} IN {_list_sql(L.GENERIC_NAMES)}) SELECT repo_id, count(*) AS generic_count FROM g GROUP BY 1"
)
def generic_names(spark, d):
    return search.generic_names(_paths(spark, d).withColumn("repo_id", F.lit("en")), _word_functions(spark, d))


_DUPFILES = "df AS (SELECT lang AS repo_id, CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents WHERE text IS NOT NULL)"

_KW = "[" + _list_sql(L.DUP_KEYWORDS)[1:-1] + "]"
_CHUNKS = (
    f"{_DUPFILES}, la AS (SELECT repo_id, path, CASE WHEN content LIKE '%' || chr(10) THEN list_slice(string_split(content, chr(10)), 1, -2) ELSE string_split(content, chr(10)) END AS a FROM df WHERE content <> ''), "
    "st AS (SELECT repo_id, path, a, CASE WHEN len(a) > 2000 THEN 4 WHEN len(a) > 500 THEN 2 ELSE 1 END AS stride FROM la WHERE len(a) >= 8), "
    "ws AS (SELECT repo_id, path, stride, a, unnest(range(0, len(a) - 7, stride)) AS start FROM st), "
    "rw AS (SELECT repo_id, path, start + stride AS line, array_to_string(list_filter(list_transform(list_slice(a, start + 1, start + 8), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND x NOT LIKE '//%' AND x NOT LIKE '#%'), chr(10)) AS raw FROM ws), "
    "nm AS (SELECT repo_id, path, line, raw, trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(regexp_replace(raw, '\"[^\"]*\"|''[^'']*''', '\"_\"', 'g'), '[a-zA-Z_][a-zA-Z0-9_]*|[^a-zA-Z_]+'), "
    f"lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z_]') AND NOT list_contains({_KW}, x) THEN '_ID_' ELSE x END), ''), '\\s+', ' ', 'g')) AS normal FROM rw WHERE strlen(raw) >= 60), "
    f"ch AS (SELECT repo_id, path, CAST(line AS INT) AS line, raw, sha256(normal) AS cluster FROM nm WHERE strlen(normal) >= 30 AND len(list_filter(string_split(normal, ' '), lambda x: list_contains({_KW}, x))) >= 2), "
    "cs AS (SELECT repo_id, cluster, count(*) AS n_locations, count(DISTINCT path) AS n_files, min(struct_pack(path := path, line := line)) AS f FROM ch GROUP BY 1, 2 HAVING count(DISTINCT path) >= 2)"
)


def _dup_files(spark: SparkSession, d: str, spread: bool = True) -> DataFrame:
    rows = _read(spark, d, "documents").where("text is not null").select(F.col("lang").alias("repo_id"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return rows.repartition("path") if spread else rows


@query(f"WITH {_CHUNKS} SELECT repo_id, cluster, n_locations, n_files, f.path AS first_path, f.line AS first_line, 8 AS line_count FROM cs")
def dup_chunks(spark, d):
    return duplication.clusters(_dup_files(spark, d)).withColumn("n_locations", F.col("n_locations").cast("bigint"))


@query(f"WITH {_CHUNKS} SELECT ch.repo_id, ch.cluster, path, line FROM ch JOIN cs USING (repo_id, cluster)")
def dup_locations(spark, d):
    return duplication.locations(_dup_files(spark, d)).select("repo_id", "cluster", "path", "line")


@query(
    f"WITH {_CHUNKS}, wd AS (SELECT repo_id, cluster, path, line, list_distinct(list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> '')) AS w FROM ch JOIN cs USING (repo_id, cluster)), "
    "w0 AS (SELECT wd.repo_id, wd.cluster, wd.w AS w0 FROM wd JOIN cs ON wd.repo_id = cs.repo_id AND wd.cluster = cs.cluster AND wd.path = cs.f.path AND wd.line = cs.f.line) "
    "SELECT repo_id, cluster, min(len(list_intersect(w0, w)) / len(list_distinct(list_concat(w0, w)))) AS similarity FROM wd JOIN w0 USING (repo_id, cluster) GROUP BY 1, 2"
)
def dup_similarity(spark, d):
    return duplication.similarity(_dup_files(spark, d, spread=False))


@query(f"WITH {_CHUNKS} SELECT repo_id, count(*) AS cluster_count, CAST(8 * sum(n_locations) AS BIGINT) AS duplicate_lines FROM cs GROUP BY 1")
def dup_totals(spark, d):
    return duplication.duplicate_totals(duplication.clusters(_dup_files(spark, d)))


@query(
    f"WITH {X.values('lg', 'repo_id, log', X.LOGS)}, x AS (SELECT n_name || '/' || repo_id AS repo_id, regexp_replace(unnest(string_split(log, chr(10))), '^\\s+|\\s+$', '', 'g') AS path FROM lg, nation) SELECT repo_id, path, count(*) AS commit_count FROM x WHERE path <> '' GROUP BY 1, 2"
)
def file_frequency(spark, d):
    return git.parse_log(X.by_nation(spark, _read(spark, d, "nation"), "repo_id string, log string", X.LOGS))


def _order_commits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, object]:
    """orders as commits to customers, one repository a nation; the last order's time is now."""
    customer, orders = _read(spark, d, "customer"), _read(spark, d, "orders")
    files = customer.select(F.col("c_nationkey").cast("string").alias("repo_id"), F.col("c_custkey").cast("string").alias("path"), F.col("c_nationkey").alias("line_count"), F.floor(F.abs("c_acctbal")).cast("bigint").alias("size_bytes"))
    commits = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("repo_id"), F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").cast("string").alias("path"))
    now = F.lit(orders.agg(F.max("o_orderdate")).first()[0])
    return files, commits, now


_GIT = (
    "nw AS (SELECT max(o_orderdate) AS t FROM orders), cm AS (SELECT CAST(c_nationkey AS VARCHAR) AS repo_id, o_orderkey AS commit_id, o_orderdate AS ts, CAST(o_custkey AS VARCHAR) AS path FROM orders JOIN customer ON o_custkey = c_custkey), "
    "ag AS (SELECT repo_id, CAST(date_diff('day', min(ts), (SELECT t FROM nw)) AS INT) AS age_days FROM cm GROUP BY 1), wi AS (SELECT *, least(greatest(age_days // 3, 7), 90) AS window_days FROM ag), "
    "fr AS (SELECT cm.repo_id, path, commit_id FROM cm JOIN wi USING (repo_id), nw WHERE ts >= t - to_days(CAST(window_days AS INT))), fq AS (SELECT repo_id, path, count(*) AS commit_count FROM fr GROUP BY 1, 2), "
    "fi AS (SELECT CAST(c_nationkey AS VARCHAR) AS repo_id, CAST(c_custkey AS VARCHAR) AS path, c_nationkey AS line_count, CAST(floor(abs(c_acctbal)) AS BIGINT) AS size_bytes FROM customer)"
)


@query(
    f"WITH {_GIT} SELECT repo_id, age_days, CAST(window_days AS INT) AS window_days, CASE WHEN window_days < 14 THEN window_days || ' days' WHEN window_days < 60 THEN (window_days // 7) || ' weeks' ELSE (window_days // 30) || ' months' END AS window_label, "
    "CAST(coalesce((SELECT count(DISTINCT commit_id) FROM fr WHERE fr.repo_id = wi.repo_id), 0) AS BIGINT) AS total_commits FROM wi"
)
def git_window(spark, d):
    _, commits, now = _order_commits(spark, d)
    return git.window(commits, now, 3)


@query(
    f"WITH {_GIT}, j AS (SELECT fi.*, commit_count IS NOT NULL AS act FROM fi LEFT JOIN fq USING (repo_id, path)) SELECT repo_id, count(*) FILTER (act) AS active_files, CAST(coalesce(sum(line_count) FILTER (act), 0) AS BIGINT) AS active_lines, "
    "CAST(coalesce(sum(size_bytes) FILTER (act), 0) AS BIGINT) AS active_bytes, count(*) FILTER (NOT act) AS frozen_files, CAST(coalesce(sum(size_bytes) FILTER (NOT act), 0) AS BIGINT) AS frozen_bytes FROM j GROUP BY 1"
)
def active_frozen(spark, d):
    files, commits, now = _order_commits(spark, d)
    return git.activity(files, git.frequency(commits, git.window(commits, now, 3), now))


_HOT = f"{_GIT}, ht AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY commit_count DESC, path) AS rank, path, commit_count, line_count AS lines FROM fi JOIN fq USING (repo_id, path) QUALIFY rank <= 10)"


@query(f"WITH {_HOT} SELECT repo_id, CAST(rank AS INT) AS rank, path, commit_count, lines FROM ht")
def hot_files(spark, d):
    files, commits, now = _order_commits(spark, d)
    return git.hot_files(files, git.frequency(commits, git.window(commits, now, 3), now))


_ITEMFN = (
    "lf AS (SELECT CAST(c_nationkey AS VARCHAR) AS repo_id, CAST(o_custkey AS VARCHAR) AS path, CAST(l_quantity AS INT) AS line_count, CAST(l_linenumber AS INT) AS nesting, CAST(l_quantity / 2 AS INT) AS complexity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
)


def _item_functions(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer = _read(spark, d, "lineitem"), _read(spark, d, "orders"), _read(spark, d, "customer")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_nationkey").cast("string").alias("repo_id"), F.col("o_custkey").cast("string").alias("path"), F.col("l_quantity").cast("int").alias("line_count"), F.col("l_linenumber").cast("int").alias("nesting"), F.rint(F.col("l_quantity") / 2).cast("int").alias("complexity"))


@query(f"WITH {_HOT}, {_ITEMFN}, cx AS (SELECT repo_id, path FROM lf GROUP BY 1, 2 HAVING sum(complexity) > 50) SELECT repo_id, count(*) AS hot_complex FROM ht JOIN cx USING (repo_id, path) GROUP BY 1")
def hot_complex(spark, d):
    return git.hot_complex(hot_files(spark, d), _item_functions(spark, d))


@query(
    f"WITH {_ITEMFN} SELECT repo_id, count(*) AS functions, CAST(sum(line_count) // count(*) AS BIGINT) AS avg_function_lines, max(line_count) AS max_function_lines, max(nesting) AS max_nesting, avg(complexity) AS avg_complexity FROM lf GROUP BY 1"
)
def function_stats(spark, d):
    return parsing.function_stats(_item_functions(spark, d))


@query(
    f"WITH {_ITEMFN}, n AS (SELECT repo_id, path, count(*) AS functions FROM lf GROUP BY 1, 2), f AS (SELECT CAST(c_nationkey AS VARCHAR) AS repo_id, CAST(c_custkey AS VARCHAR) AS path, CAST(floor(abs(c_acctbal) * 3) AS INT) AS line_count, 'Python' AS language FROM customer) "
    "SELECT repo_id, path, line_count, language, functions FROM f JOIN n USING (repo_id, path) WHERE line_count > 500 AND functions / line_count > 0.002"
)
def complex_large_files(spark, d):
    files = _read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("repo_id"), F.col("c_custkey").cast("string").alias("path"), F.floor(F.abs("c_acctbal") * 3).cast("int").alias("line_count"), F.lit("Python").alias("language"))
    return parsing.complex_large_files(files, _item_functions(spark, d))


_LINKS = "im AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS repo_id, url AS path, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS module_path FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "pages").where("url is not null and html is not null")
    return p.select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("repo_id"), F.col("url").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("module_path"))


def _fan_sql(key: str, name: str) -> str:
    return (
        f"WITH {_LINKS}, c AS (SELECT repo_id, {key} AS k, count(*) AS n FROM im GROUP BY 1, 2) SELECT repo_id, avg(n) AS avg_{name}, max(n) AS max_{name}, (SELECT k FROM c c2 WHERE c2.repo_id = c.repo_id ORDER BY n DESC, k LIMIT 1) AS max_{name}_name FROM c GROUP BY 1"
    )


@query(_fan_sql("path", "fan_out"))
def fan_out(spark, d):
    return graph.fan_out(_links(spark, d))


@query(_fan_sql("module_path", "fan_in"))
def fan_in(spark, d):
    return graph.fan_in(_links(spark, d))


_NATIONS = (
    "ec AS (SELECT cn.n_name AS src, sn.n_name AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2), ed AS (SELECT 'w' AS repo_id, src, dst FROM ec QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) <= 2)"
)


def _nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """From each nation to the two that it buys most from."""
    nation = _read(spark, d, "nation").select("n_nationkey", "n_name")
    joined = _read(spark, d, "lineitem").join(_read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = joined.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(nation.toDF("ck", "src"), F.col("c_nationkey") == F.col("ck")).join(nation.toDF("sk", "dst"), F.col("s_nationkey") == F.col("sk"))
    most = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return named.withColumn("r", most).where("r <= 2").select(F.lit("w").alias("repo_id"), "src", "dst")


_SCC = (
    f"WITH RECURSIVE {_NATIONS}, rc(a, b) AS (SELECT src, dst FROM ed UNION SELECT rc.a, ed.dst FROM rc JOIN ed ON rc.b = ed.src), "
    "mu AS (SELECT x.a AS node, list_sort(list_distinct(list_append(list(y.a), x.a))) AS members FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY 1), sc AS (SELECT DISTINCT 'w' AS repo_id, members, CAST(len(members) AS INT) AS size FROM mu WHERE len(members) > 1)"
)


@query(f"{_SCC} SELECT repo_id, array_to_string(members, ',') AS members, size FROM sc")
def scc(spark, d):
    return graph.cycles(_nation_edges(spark, d)).withColumn("members", F.array_join("members", ","))


@query(f"{_SCC} SELECT repo_id, count(*) AS cycle_count, max(size) AS largest_cycle, (SELECT array_to_string(members, ',') FROM sc ORDER BY size DESC, members LIMIT 1) AS largest_members FROM sc GROUP BY 1")
def cycle_stats(spark, d):
    return graph.cycle_stats(graph.cycles(_nation_edges(spark, d))).withColumn("largest_members", F.array_join("largest_members", ","))


_LAYERS = (
    f"{_NATIONS}, gp AS (SELECT n_name AS path, r_name || '/' || n_name AS grp, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), im AS (SELECT src, dst, g.r_name AS dr FROM ed JOIN gp g ON g.path = ed.dst), "
    "tg AS (SELECT gp.grp AS src, (SELECT min(g2.grp) FROM gp g2 WHERE g2.r_name = im.dr) AS dst FROM im JOIN gp ON gp.path = im.src), le AS (SELECT DISTINCT 'w' AS repo_id, src, dst FROM tg WHERE src <> dst)"
)


def _layered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as files of the group region/nation; an import names the other nation's region first."""
    regions = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    grouped = regions.select(F.lit("w").alias("repo_id"), F.col("n_name").alias("path"), F.concat_ws("/", "r_name", "n_name").alias("grp"))
    to = regions.select(F.col("n_name").alias("dst"), F.concat(F.lit(":"), F.col("r_name"), F.lit("."), F.col("n_name")).alias("module_path"))
    imports = _nation_edges(spark, d).join(to, "dst").select("repo_id", F.col("src").alias("path"), "module_path")
    return graph.layer_edges(imports, grouped), grouped.groupBy("repo_id").agg(F.count_distinct("grp").alias("groups"))


@query(f"WITH {_LAYERS} SELECT * FROM le")
def layer_edges(spark, d):
    return _layered(spark, d)[0]


@query(f"WITH {_LAYERS} SELECT x.repo_id, x.src AS a, x.dst AS b FROM le x JOIN le y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def bidirectional(spark, d):
    return graph.bidirectional(_layered(spark, d)[0])


@query(f"WITH {_LAYERS}, nd AS (SELECT repo_id, dst AS grp, count(*) AS in_degree FROM le GROUP BY 1, 2) SELECT repo_id, grp, in_degree FROM nd WHERE in_degree >= ceil(0.6 * (SELECT count(DISTINCT grp) FROM gp))")
def god_modules(spark, d):
    return graph.god_modules(*_layered(spark, d))


@query(f"WITH {_LAYERS}, pr AS (SELECT repo_id, least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM le GROUP BY 1, 2, 3) SELECT repo_id, count(*) FILTER (n = 1) / count(*) AS layering_score FROM pr GROUP BY 1")
def layering_score(spark, d):
    return graph.layering(_layered(spark, d)[0])


_DEAD = (
    f"{X.values('fn0', 'repo_id, name, path, start_line, line_count', X.DEAD_FUNCTIONS)}, {X.values('fl0', 'repo_id, path, content', X.DEAD_FILES)}, {X.values('im0', 'repo_id, path, module_path', X.DEAD_IMPORTS)}, "
    "fn AS (SELECT n_name || '/' || fn0.repo_id AS repo_id, name, path, start_line, line_count FROM fn0, nation), fl AS (SELECT n_name || '/' || fl0.repo_id AS repo_id, path, content FROM fl0, nation), im AS (SELECT n_name || '/' || im0.repo_id AS repo_id, path, module_path FROM im0, nation), "
    f"sm AS (SELECT repo_id, path, {_STEM} AS stem FROM fl), co AS (SELECT DISTINCT sm.repo_id, sm.path FROM sm WHERE EXISTS (SELECT 1 FROM im WHERE im.repo_id = sm.repo_id AND im.path <> sm.path AND contains(module_path, stem)) "
    "OR (strlen(stem) >= 4 AND EXISTS (SELECT 1 FROM fl WHERE fl.repo_id = sm.repo_id AND fl.path <> sm.path AND list_contains(regexp_split_to_array(content, '[^A-Za-z0-9_]+'), stem)))), "
    f"{X.values('hk', 'prefix', list(L.FRAMEWORK_PREFIXES))}, ca AS (SELECT * FROM fn WHERE name <> '<anonymous>' AND NOT starts_with(name, 'test') AND NOT starts_with(name, 'Test') AND NOT starts_with(name, '__') AND line_count >= 15 AND strlen(name) >= 8 "
    "AND NOT EXISTS (SELECT 1 FROM hk WHERE starts_with(lower(name), prefix)) QUALIFY row_number() OVER (PARTITION BY repo_id, name ORDER BY path, start_line) = 1), "
    "un AS (SELECT ca.* FROM ca WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.repo_id = ca.repo_id AND co.path = ca.path) AND NOT EXISTS (SELECT 1 FROM im WHERE im.repo_id = ca.repo_id AND list_contains(regexp_split_to_array(module_path, '[/.:\\\\, ]'), ca.name)) "
    "AND NOT EXISTS (SELECT 1 FROM fl WHERE fl.repo_id = ca.repo_id AND fl.path <> ca.path AND contains(content, ca.name)))"
)


def _dead(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = lambda schema, of: X.by_nation(spark, _read(spark, d, "nation"), schema, of)
    return (
        rows("repo_id string, name string, path string, start_line int, line_count int", X.DEAD_FUNCTIONS),
        rows("repo_id string, path string, module_path string", X.DEAD_IMPORTS),
        rows("repo_id string, path string, content string", X.DEAD_FILES),
    )


@query(f"WITH {_DEAD} SELECT repo_id, path FROM co")
def connected_files(spark, d):
    _, imports, files = _dead(spark, d)
    return deadcode.connected(files, imports)


@query(f"WITH {_DEAD} SELECT repo_id, name, path, line_count FROM un")
def dead_functions(spark, d):
    return deadcode.unreferenced(*_dead(spark, d))


@query(f"WITH {_DEAD} SELECT r.repo_id, count(un.name) AS unreferenced_functions, CAST(coalesce(sum(un.line_count), 0) AS BIGINT) AS unreferenced_lines FROM (SELECT DISTINCT repo_id FROM fl) r LEFT JOIN un USING (repo_id) GROUP BY 1")
def dead_code(spark, d):
    return deadcode.dead_code(*_dead(spark, d))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """What is parsed from code, and from one of its texts for each document."""
    rows = X.CODE + X.TRICKY
    more = X.by_document(spark, _read(spark, d, "documents").select("doc_id", "source"), _TEXT_ROWS, rows)
    every = X.table(spark, _TEXT_ROWS, rows).unionByName(more.select(F.col("source").alias("repo_id"), _moved(), "content"))
    return parsing.parse(scanning.files_from(every, F.col("repo_id"), F.col("path"), F.col("content")))


def _parsed_sql(columns: str, found: dict[str, list[tuple]]) -> str:
    """The rows that each text is known to give, for the texts themselves and for each document that has one."""
    rows = [(k, repo, path, *x) for k, (repo, path, _) in enumerate(X.CODE + X.TRICKY) for x in found.get(path, [])]
    return f"WITH {X.values('ex', 'k, repo_id, path, ' + columns, rows)} SELECT repo_id, path, {columns} FROM ex UNION ALL SELECT source, 'm' || doc_id || '/' || path, {columns} FROM documents JOIN ex ON doc_id % {len(X.CODE + X.TRICKY)} = k"


@query(_parsed_sql("name, start_line, line_count, complexity, nesting", X.FUNCTIONS))
def functions(spark, d):
    return parsing.functions(_parsed(spark, d))


@query(_parsed_sql("module_path, line", X.IMPORTS))
def imports(spark, d):
    return parsing.imports(_parsed(spark, d))


@query(_parsed_sql("kind, line", X.HAZARDS))
def hazards(spark, d):
    return parsing.hazards(_parsed(spark, d))


_CPT = "CASE language WHEN 'Rust' THEN 3.2 WHEN 'JavaScript' THEN 3.8 ELSE 3.5 END"


@query(f"WITH {_FILES}, b AS (SELECT repo_id, language, sum(size_bytes) AS n FROM files GROUP BY 1, 2) SELECT repo_id, CAST(sum(ceil(n / CAST({_CPT} AS DOUBLE))) AS BIGINT) AS total_tokens FROM b GROUP BY 1")
def token_totals(spark, d):
    b = scanning.language_breakdown(_files(spark, d))
    return b.groupBy("repo_id").agg(F.sum(F.ceil(F.col("total_bytes") / S.chars_per_token(F.col("language")))).alias("total_tokens"))


@query(
    f"WITH {_FILES} SELECT repo_id, path, CAST(ceil(length(regexp_replace(content, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) / CAST({_CPT} AS DOUBLE)) + length(regexp_replace(content, '[\\p{{L}}\\p{{N}}_\\s]', '', 'g')) AS BIGINT) AS tokens FROM files"
)
def content_tokens(spark, d):
    return _files(spark, d).select("repo_id", "path", S.content_tokens(F.col("content"), F.col("language")).alias("tokens"))


@query(
    f"WITH {_FILES}, b AS (SELECT repo_id, language, sum(line_count) AS n FROM files GROUP BY 1, 2), m AS (SELECT repo_id, language FROM b QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) = 1) "
    "SELECT m.repo_id, m.language AS dominant_language, sum(b.n) / 1000 * CASE m.language WHEN 'Rust' THEN 0.8::DOUBLE WHEN 'JavaScript' THEN 0.05::DOUBLE WHEN 'Python' THEN 0.02::DOUBLE ELSE 0.1::DOUBLE END AS build_seconds FROM m JOIN b USING (repo_id) GROUP BY 1, 2"
)
def build_seconds(spark, d):
    return scanning.build_seconds(scanning.language_breakdown(_files(spark, d)))


@query("SELECT c_custkey, least(power(abs(c_acctbal) * 1000 / 3.5::DOUBLE / 176000, 1.5), 1.0) AS size_multiplier FROM customer")
def size_multiplier(spark, d):
    c = _read(spark, d, "customer")
    return c.select("c_custkey", S.size_multiplier(F.abs("c_acctbal") * 1000, F.lit(None).cast("double")).alias("size_multiplier"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return X.score_table(spark, _read(spark, d, "customer"))


_EFFECTIVE = "CASE WHEN is_git AND active_files > 0 THEN active_bytes ELSE total_bytes END"
_RATED = f"""{X.score_values()}, e AS (
  SELECT *, {_EFFECTIVE} AS eb, CASE WHEN source_files > 0 THEN test_files / source_files ELSE 0.0 END AS tr FROM w
), f AS (
  SELECT *, floor(total_tokens * (eb / greatest(total_bytes, 1))) AS toks, least(power(eb / 3.5::DOUBLE / 176000, 1.5), 1.0) AS mult FROM e
), rt AS (
  SELECT *,
    5 - has_DependencyManager::INT - has_Lockfile::INT - (has_Docker AND docker_useful)::INT - (has_BuildScript AND build_has_standard)::INT - has_GitIgnore::INT AS r0,
    least(5, CASE WHEN max_depth > 8 THEN 2 WHEN max_depth > 5 THEN 1 ELSE 0 END + (complex_large > 3)::INT + (total_files > 500)::INT + (layer_violations > 0)::INT + (god_modules > 0)::INT + (dup_count > 10)::INT + (coll_count > 15)::INT) AS r1,
    least(5, CASE WHEN avg_fan_out > 15 THEN 2 WHEN avg_fan_out > 8 THEN 1 ELSE 0 END + (max_fan_out > 30 AND regexp_extract(max_fan_out_name, '[^/]*$') NOT IN {_list_sql(L.APP_SHELLS)})::INT + CASE WHEN cycle_count > 5 THEN 2 WHEN cycle_count > 0 THEN 1 ELSE 0 END) AS r2,
    least(5, greatest(3 - 2 * has_Formatter::INT - has_Linter::INT, 0) + CASE WHEN dominant_ratio < 0.6 THEN 2 WHEN dominant_ratio < 0.8 THEN 1 ELSE 0 END) AS r3,
    5 - CASE WHEN tr > 0.5 THEN 2 WHEN tr > 0.2 THEN 1 ELSE 0 END - has_TestFramework::INT - (test_files > 0)::INT AS r4,
    least(5, CASE WHEN global_mutables > 20 THEN 2 WHEN global_mutables > 0 THEN 1 ELSE 0 END + (side_effects > 5)::INT + CASE WHEN hazards > 10 THEN 2 WHEN hazards > 3 THEN 1 ELSE 0 END) AS r5,
    least(5, CASE WHEN build_seconds > 120 THEN 3 WHEN build_seconds > 30 THEN 2 WHEN build_seconds > 5 THEN 1 ELSE 0 END + (NOT has_TestFramework)::INT + (NOT has_CI AND NOT has_BuildScript)::INT) AS r6,
    greatest(0, 5 - CASE WHEN has_Readme AND readme_has_setup AND total_bytes > 0 AND readme_bytes / total_bytes > 0.005 THEN 2 WHEN has_Readme AND readme_bytes > 200 THEN 1 ELSE 0 END - 2 * has_ArchitectureDocs::INT - has_Contributing::INT) AS r7,
    3 - has_GitIgnore::INT - has_generated::INT - has_Lockfile::INT AS r8,
    least(5, CASE WHEN toks > 500000 THEN 2 WHEN toks > 100000 THEN 1 ELSE 0 END + CASE WHEN max_function_lines > 300 THEN 2 WHEN max_function_lines > 100 THEN 1 ELSE 0 END + (max_nesting > 8)::INT + (hot_complex > 3)::INT) AS r9
  FROM f
), {X.values("dm", "ordinal, name, weight", [(i, n, w) for i, (n, w) in enumerate(L.DIMENSIONS)])}, sc AS (
  SELECT repo_id, ordinal, name, weight, mult, CAST(([r0, r1, r2, r3, r4, r5, r6, r7, r8, r9])[ordinal + 1] AS INT) AS rating FROM rt, dm
), ix AS (
  SELECT repo_id, sum(weight * rating / 5.0::DOUBLE) AS raw_score, any_value(mult) AS size_multiplier, CAST(least(round(sum(weight * rating / 5.0::DOUBLE) * any_value(mult)), 100) AS INT) AS friction_index FROM sc GROUP BY 1
)"""


@query(f"WITH {_RATED} SELECT repo_id, ordinal, name, weight, rating FROM sc")
def dimension_scores(spark, d):
    return score.dimensions(_scores(spark, d)).drop("evidence")


@query(
    f"WITH {_RATED} SELECT repo_id, raw_score, size_multiplier, friction_index, CASE WHEN friction_index <= 20 THEN 'CLEAN' WHEN friction_index <= 40 THEN 'ACCEPTABLE' WHEN friction_index <= 60 THEN 'MESSY' WHEN friction_index <= 80 THEN 'SLOPPY' ELSE 'DISASTER' END AS verdict FROM ix"
)
def friction_index(spark, d):
    return score.index(_scores(spark, d))


@query(
    f"WITH {_RATED} SELECT repo_id, name, p.proposed, CAST(CASE WHEN p.proposed >= rating THEN 0 ELSE greatest(round(weight * (rating - p.proposed) / 5.0::DOUBLE * mult), 1) END AS INT) AS reduction FROM sc, (VALUES (0), (2), (4)) p(proposed)"
)
def simulate_reduction(spark, d):
    dims = score.dimensions(_scores(spark, d)).join(score.index(_scores(spark, d)).select("repo_id", "size_multiplier"), "repo_id")
    dims = dims.withColumn("proposed", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4))))
    return dims.select("repo_id", "name", "proposed", score.reduction(F.col("weight"), F.col("rating"), F.col("proposed"), F.col("size_multiplier")).cast("int").alias("reduction"))


@query(
    f"""WITH {_RATED}, b AS (SELECT repo_id,
  CAST(3 * ceil(least(20, total_files) * CASE WHEN dup_count > 20 THEN 1.5 WHEN dup_count > 5 THEN 1.25 ELSE 1.0 END) * 15 + 30 * coll_count AS BIGINT) AS discovery,
  CAST(least(7, total_files) * ceil(avg_file_lines * 35 / main_chars_per_token::DOUBLE) AS BIGINT) AS reading, CAST(100 * floor(avg_fan_out) AS BIGINT) AS tracing,
  CAST(CASE WHEN avg_complexity > 10 THEN 2000 WHEN avg_complexity > 5 THEN 1000 ELSE 500 END + CASE WHEN max_nesting > 6 THEN 1500 WHEN max_nesting > 4 THEN 800 ELSE 300 END
    + CASE WHEN cluster_count = 0 THEN 0 ELSE floor(least(50, cluster_count) * 100 + ln(greatest(cluster_count, 1)) * 500) END AS BIGINT) AS comprehension FROM w)
SELECT *, discovery + reading + tracing + comprehension AS total_navigation, CAST(176000 AS BIGINT) AS usable_context, (discovery + reading + tracing + comprehension) / 176000 * 100 AS navigation_pct,
  CAST(greatest(176000 - (discovery + reading + tracing + comprehension), 0) AS BIGINT) AS remaining FROM b"""
)
def context_budget(spark, d):
    return score.budget(_scores(spark, d))


_LARGE = [("heavy", f"src/m{i}.py", 600 + i, 30, "Python") for i in range(9)] + [("heavy", "src/vendor/v.py", 9000, 90, "Python"), ("active", "src/big.ts", 800, 12, "TypeScript")]
_WORST = [("heavy", "twist", "src/m3.py", 17, 44, 210, 9, 12), ("active", "bend", "src/big.ts", 5, 18, 60, 4, 2)]


def _fixable(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    large = X.table(spark, "repo_id string, path string, line_count int, functions bigint, language string", _LARGE)
    worst = X.table(spark, "repo_id string, name string, path string, start_line int, complexity int, line_count int, nesting int, n_complex bigint", _WORST)
    return _scores(spark, d), large, worst


def _recommended(spark: SparkSession, d: str) -> DataFrame:
    return score.recommendations(*_fixable(spark, d))


_RULES = f"""WITH {_RATED}, {X.values("lg", "repo_id, path, line_count, functions, language", _LARGE)}, {X.values("wf", "repo_id, name, path, start_line, complexity, line_count, nesting, n_complex", _WORST)},
ls AS (SELECT *, count(*) OVER (PARTITION BY repo_id) AS nl, row_number() OVER (PARTITION BY repo_id ORDER BY line_count DESC, path) AS nth FROM lg WHERE NOT contains(lower(path), '/vendor/')),
c AS (
  SELECT repo_id, 1 AS rule, nth, 1 AS dim, CASE WHEN greatest(nl - 3, 0) > 10 THEN 2 WHEN greatest(nl - 3, 0) > 3 THEN 1 ELSE 0 END AS prop, path AS target FROM ls WHERE nth <= 3
  UNION ALL SELECT repo_id, 2, 0, 4, CASE WHEN tr < 0.05 THEN 1 ELSE 2 END, 'project-wide' FROM rt WHERE tr < 0.2
  UNION ALL SELECT repo_id, 3, 0, 3, CASE WHEN has_Linter THEN 1 ELSE 2 END, 'project config' FROM rt WHERE NOT has_Formatter
  UNION ALL SELECT repo_id, 4, 0, 3, CASE WHEN has_Formatter THEN 1 ELSE 2 END, 'project config' FROM rt WHERE NOT has_Linter
  UNION ALL SELECT repo_id, 5, 0, 7, CASE WHEN has_ArchitectureDocs THEN 2 ELSE 3 END, 'project root' FROM rt WHERE NOT has_Readme
  UNION ALL SELECT repo_id, 6, 0, 7, CASE WHEN has_Readme THEN 2 ELSE 3 END, 'project root' FROM rt WHERE NOT has_ArchitectureDocs AND top_level_dirs > 5
  UNION ALL SELECT wf.repo_id, 7, 0, 9, greatest(r9 - 1, 0), path || ':' || start_line FROM wf JOIN rt ON rt.repo_id = wf.repo_id
  UNION ALL SELECT repo_id, 8, 0, 2, greatest(r2 - CASE WHEN cycle_count > 5 THEN 2 ELSE 1 END, 0), 'import graph' FROM rt WHERE cycle_count > 0
  UNION ALL SELECT repo_id, 9, 0, 5, greatest(r5 - 1, 0), 'project-wide' FROM rt WHERE anti_patterns > 10
  UNION ALL SELECT repo_id, 10, 0, 0, greatest(r0 - 1, 0), 'project config' FROM rt WHERE NOT has_TypeChecker AND source_files > 10
  UNION ALL SELECT repo_id, 11, 0, 6, greatest(r6 - 1, 0), 'project config' FROM rt WHERE NOT has_CI
  UNION ALL SELECT repo_id, 12, 0, 5, greatest(r5 - 1, 0), 'project-wide' FROM rt WHERE global_mutables > 10
  UNION ALL SELECT repo_id, 13, 0, 9, greatest(r9 - CASE WHEN active_files / total_files > 0.85 THEN 2 ELSE 1 END, 0), 'project architecture' FROM rt WHERE is_git AND active_files > 0 AND total_files >= 50 AND active_files / total_files >= 0.6
  UNION ALL SELECT repo_id, 14, 0, 1, greatest(r1 - (layer_violations > 0)::INT - (god_modules > 0)::INT, 0), 'project architecture' FROM rt WHERE layer_violations > 0 OR god_modules > 0
  UNION ALL SELECT repo_id, 15, 0, 1, greatest(r1 - (dup_count > 10)::INT - (coll_count > 15)::INT, 0), 'project-wide' FROM rt WHERE dup_count > 5 OR coll_count > 10
  UNION ALL SELECT repo_id, 16, 0, 9, greatest(r9 - 1, 0), 'project-wide' FROM rt WHERE unreferenced_functions >= 10
), rd AS (
  SELECT c.repo_id, rule, nth, target, CAST(CASE WHEN prop >= rating THEN 0 ELSE greatest(round(weight * (rating - prop) / 5.0::DOUBLE * mult), 1) END AS INT) AS red FROM c JOIN sc ON sc.repo_id = c.repo_id AND sc.ordinal = c.dim
), rk AS (
  SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY red DESC, rule, nth) AS INT) AS priority, red AS estimated_reduction, target FROM rd QUALIFY priority <= 10
)"""


@query(f"{_RULES} SELECT repo_id, priority, estimated_reduction, target FROM rk")
def recommendations(spark, d):
    return _recommended(spark, d).select("repo_id", "priority", "estimated_reduction", "target")


@query(f"{_RULES} SELECT repo_id, priority, CAST(greatest(friction_index - sum(estimated_reduction) OVER (PARTITION BY repo_id ORDER BY priority), 0) AS INT) AS index_after FROM rk JOIN ix USING (repo_id)")
def running_index(spark, d):
    return score.running_index(*_fixable(spark, d))


@query()
def report_json(spark, d):
    return derived._reports(spark, d)


@query(ORACLES["lang_breakdown"])
def stream_totals(spark, d):
    """Totals kept by a stream that reads the documents as they land."""
    schema = _read(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{d}/documents*")
    out = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows")
    done = landing.running_totals(_rows(stream)).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(keep).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


from . import derived  # noqa: E402, F401
