"""Registered queries over texts that the plans make: evidence, titles and actions, reports; and over what they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from .. import lookups as L
from ..functions import scalar as S
from ..operators import scan as scanning
from ..operators import search
from . import fixtures as X
from . import queries as Q
from . import report, score
from .cut import cut

query = Q.query


def _num(value: str, places: int) -> str:
    """SQL of a number with so many places, exact halves away from zero."""
    ten = 10**places
    return f"printf('%.{places}f', {value} + CASE WHEN {value} * {ten} - floor({value} * {ten}) = 0.5 THEN 0.01 / {ten} ELSE 0 END)"


def _short(n: str) -> str:
    return f"CASE WHEN {n} >= 1000000 THEN {_num(f'({n} / 1000000)', 1)} || 'M' WHEN {n} >= 1000 THEN {_num(f'({n} / 1000)', 1)} || 'k' ELSE CAST(CAST({n} AS BIGINT) AS VARCHAR) END"


def _joined(*parts: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), ', ')"


def _if(cond: str, text: str, other: str = "NULL") -> str:
    return f"CASE WHEN {cond} THEN {text} ELSE {other} END"


_FILE = "regexp_extract({}, '[^/]*$')"
_EVIDENCE = [
    _joined(
        _if("NOT has_DependencyManager", "'no dependency manager'"), _if("NOT has_Lockfile", "'no lockfile'"),
        "CASE WHEN NOT has_Docker THEN 'no Docker config' WHEN docker_useful THEN 'Docker with build/run commands' ELSE 'Docker present but incomplete' END", _if("has_BuildScript AND NOT build_has_standard", "'build script missing standard targets'"),
    ),
    _joined(
        "total_files || ' files'", "'max depth ' || max_depth", "complex_large || ' complex files >500 lines (' || large_files || ' total >500 lines, largest: ' || max_file_lines || ' lines)'",
        _if("layer_violations > 0", "layer_violations || ' bidirectional layer deps'"), _if("god_modules > 0", "god_modules || ' god modules (imported by >60% of groups)'"),
        _if("dup_count > 0", "dup_count || ' duplicate filenames (worst: ' || dup_worst || ' x' || dup_worst_count || ')'"), _if("coll_count > 0", "coll_count || ' function name collisions (worst: ' || coll_worst || ' in ' || coll_worst_count || ' files)'"),
    ),
    _joined(
        f"'avg fan-out: ' || {_num('avg_fan_out', 1)}", f"'max fan-out: ' || max_fan_out || {_if(_FILE.format('max_fan_out_name') + ' = ' + repr(''), repr(''), repr(' (') + ' || ' + _FILE.format('max_fan_out_name') + ' || ' + repr(')'))}",
        f"'avg fan-in: ' || {_num('avg_fan_in', 1)}", f"'max fan-in: ' || max_fan_in || {_if('max_fan_in_name = ' + repr(''), repr(''), repr(' (') + ' || max_fan_in_name || ' + repr(')'))}",
        _if("largest_cycle > 0", "cycle_count || ' circular deps (largest: ' || largest_cycle || ' modules)'", "'0 circular deps'"),
    ),
    _joined("CASE WHEN has_Formatter AND has_Linter THEN 'formatter + linter configured' WHEN has_Formatter THEN 'formatter configured' WHEN has_Linter THEN 'linter configured' ELSE 'no formatter/linter' END", f"'naming consistency: ' || {_num('(dominant_ratio * 100)', 0)} || '%'"),
    _joined(f"'test ratio: ' || {_num('tr', 2)} || ' (' || test_files || ' test files / ' || source_files || ' source files)'", _if("has_TestFramework", "'test framework configured'", "'no test framework config'")),
    _joined("global_mutables || ' global mutable patterns'", "side_effects || ' side-effect anti-patterns'", _if("hazards > 0", "hazards || ' runtime hazards (singletons, module-level calls, event listeners)'")),
    _joined(f"'estimated build: ~' || CASE WHEN build_seconds > 60 THEN {_num('(build_seconds / 60)', 0)} || 'min' ELSE {_num('build_seconds', 0)} || 's' END", _if("has_TestFramework", "'test runner configured'", "'no test runner'"), _if("has_CI", "'CI configured'")),
    _joined(
        "CASE WHEN NOT has_Readme THEN 'no README' WHEN readme_has_setup THEN 'README with setup instructions (' || readme_bytes || ' bytes)' WHEN readme_bytes > 200 THEN 'README present but no setup instructions (' || readme_bytes || ' bytes)' ELSE 'README too sparse (' || readme_bytes || ' bytes)' END",
        _if("has_ArchitectureDocs", "'architecture docs present'", "'no architecture docs'"),
    ),
    _joined(_if("has_GitIgnore", "'.gitignore present'", "'no .gitignore'"), _if("has_generated", "'vendor/generated dirs separated'"), "CASE WHEN NOT has_Lockfile THEN 'no lockfile' WHEN lockfile_fresh THEN 'lockfile present and fresh' ELSE 'lockfile present but may be stale' END"),
    _joined(
        f"CASE WHEN eb < total_bytes THEN '~' || {_short('toks')} || ' active tokens (~' || {_short('total_tokens')} || ' total)' ELSE '~' || {_short('total_tokens')} || ' estimated tokens' END", "'avg function ' || avg_function_lines || ' lines'",
        "'max function ' || max_function_lines || ' lines'", "'max nesting depth ' || max_nesting", _if("hot_complex > 0", "hot_complex || ' hot+complex files (frequently changed AND high complexity)'"),
        _if("unreferenced_functions > 0", "'~' || unreferenced_functions || ' potentially unused functions (~' || unreferenced_lines || ' lines)'"),
    ),
]


@query(f"WITH {Q._RATED} SELECT repo_id, name, ([{', '.join(_EVIDENCE)}])[ordinal + 1] AS evidence FROM rt, dm")
def evidence(spark, d):
    return score.dimensions(Q._scores(spark, d)).select("repo_id", "name", "evidence")


_SHARE = "(active_files / total_files * 100)"
#: By rule: title, action and evidence; ls and wf are the large files and the worst function.
_WORDS = {
    2: (f"'Add tests (' || test_files || ' test files for ' || source_files || ' source files, ratio ' || {_num('tr', 2)} || ')'", "tests", f"'test ratio: ' || {_num('tr', 2)}"),
    3: ("'Configure a code formatter'", "formatter", "'no formatter configuration found'"),
    4: ("'Configure a linter'", "linter", "'no linter configuration found'"),
    5: ("'Add a README'", "readme", "'no README found'"),
    6: ("'Add architecture documentation (' || top_level_dirs || ' top-level directories)'", "docs", "top_level_dirs || ' top-level directories with no architecture guide'"),
    8: ("'Resolve ' || cycle_count || ' circular dependency cycles (largest: ' || largest_cycle || ' modules)'", "cycles", "cycle_count || ' SCCs with cycles detected, largest involves ' || largest_cycle || ' modules'"),
    9: ("'Clean up ' || anti_patterns || ' anti-patterns'", "patterns", "anti_patterns || ' anti-pattern matches across the codebase'"),
    10: ("'Add type checking'", "types", "'no type checker configuration found'"),
    11: ("'Set up CI pipeline'", "ci", "'no CI configuration found'"),
    12: ("'Reduce global mutable state (' || global_mutables || ' instances)'", "globals", "global_mutables || ' global mutable patterns detected'"),
    13: (f"'Extract libraries to shrink active surface (' || {_num(_SHARE, 0)} || '% of files changed in last ' || window_label || ')'", "libraries", f"active_files || ' active files (' || {_num(_SHARE, 0)} || '%), ' || frozen_files || ' frozen files, hottest: ' || CASE WHEN hot_names = '' THEN 'n/a' ELSE hot_names END"),
    14: ("'Enforce module layering (' || (layer_violations + god_modules) || ' violations)'", "layering", _joined(_if("layer_violations > 0", "layer_violations || ' bidirectional dependencies between module groups'"), _if("god_modules > 0", "god_modules || ' god modules imported by >60% of other groups'"))),
    15: ("CASE WHEN dup_count > 5 AND coll_count > 10 THEN 'Improve searchability (' || dup_count || ' duplicate filenames, ' || coll_count || ' function collisions)' WHEN dup_count > 5 THEN 'Reduce duplicate filenames (' || dup_count || ')' ELSE 'Reduce function name collisions (' || coll_count || ')' END", "search", "dup_count || ' duplicate filenames, ' || coll_count || ' function name collisions, ' || generic_count || ' generic names'"),
    16: ("'Audit potentially unused code (~' || unreferenced_functions || ' functions, ~' || unreferenced_lines || ' lines)'", "dead", "'~' || unreferenced_functions || ' functions (>= 15 lines each) in files with no incoming imports, totaling ~' || unreferenced_lines || ' lines'"),
}


def _said(i: int) -> str:
    text = lambda x: "'" + score._ACTIONS[x].replace("'", "''") + "'"
    own = {
        1: ("'Split ' || ls.path || ' (' || ls.line_count || ' lines, ' || ls.functions || ' functions)'", text("split"), "ls.line_count || ' lines, ' || ls.functions || ' functions'"),
        7: ("'Simplify ' || wf.name || ' (complexity ' || wf.complexity || ', ' || wf.line_count || ' lines)'", text("complexity") + " || ' ' || wf.n_complex || ' functions exceed complexity threshold.'", "'cyclomatic complexity ' || wf.complexity || ', ' || wf.line_count || ' lines, nesting depth ' || wf.nesting"),
    }
    for k, (title, action, proof) in _WORDS.items():
        own[k] = title, text(action) + (" || ' Largest cycle: ' || largest_members" if k == 8 else ""), proof
    return "CASE rk.rule " + " ".join(f"WHEN {k} THEN {x[i]}" for k, x in sorted(own.items())) + " END"


_RULES = Q._RULES.replace("estimated_reduction, target FROM rd QUALIFY", "estimated_reduction, target, rule, nth FROM rd QUALIFY")


@query(
    f"{_RULES} SELECT rk.repo_id, priority, {_said(0)} AS title, {_said(1)} AS action, {_said(2)} AS evidence FROM rk JOIN rt ON rt.repo_id = rk.repo_id LEFT JOIN ls ON ls.repo_id = rk.repo_id AND ls.nth = rk.nth AND rk.rule = 1 LEFT JOIN wf ON wf.repo_id = rk.repo_id AND rk.rule = 7"
)
def recommendation_texts(spark, d):
    return Q._recommended(spark, d).select("repo_id", "priority", "title", "action", "evidence")


@query(
    f"WITH {X.numbered('ef', 'path', X.EVENT_FILES)}, e AS (SELECT CAST(user_id AS VARCHAR) AS repo_id, path, ts FROM events JOIN ef ON event_id % {len(X.EVENT_FILES)} = k), "
    f"m AS (SELECT repo_id, max(ts) FILTER ({Q._BASE} IN {Q._list_sql(L.CONFIG_NAMES['Lockfile'])}) AS lk, max(ts) FILTER ({Q._BASE} IN {Q._list_sql(L.CONFIG_NAMES['DependencyManager'])}) AS mf FROM e GROUP BY 1) SELECT repo_id, coalesce(lk >= mf, false) AS lockfile_fresh FROM m"
)
def lockfile_fresh(spark, d):
    names = F.array(*[F.lit(x) for x in X.EVENT_FILES])
    listing = Q._read(spark, d, "events").select(F.col("user_id").cast("string").alias("repo_id"), F.get(names, (F.col("event_id") % len(X.EVENT_FILES)).cast("int")).alias("path"), F.col("ts").alias("modified"))
    return scanning.lockfile_fresh(listing)


@query(
    f"WITH {Q._PAGEFILES}, {Q._PART}, fs AS (SELECT * FROM pf UNION ALL SELECT p_brand, 'lib/' || p_size || '/util.py' FROM part), al AS (SELECT * FROM fn UNION ALL SELECT repo_id, path, 'process' FROM pf UNION ALL SELECT p_brand, 'f' || p_size, 'weigh' || (p_partkey % 4) FROM part), "
    f"df AS (SELECT repo_id, {Q._BASE} AS name, count(*) AS n FROM fs GROUP BY 1, 2 HAVING count(*) > 1), cf AS (SELECT repo_id, name, count(DISTINCT path) AS n FROM al WHERE name NOT IN {Q._list_sql(['<anonymous>', *L.STRUCTURAL_NAMES])} GROUP BY 1, 2 HAVING count(DISTINCT path) >= 3), "
    f"g AS (SELECT repo_id, count(*) AS n FROM (SELECT repo_id FROM fs WHERE {Q._STEM} IN {Q._list_sql(L.GENERIC_NAMES)} UNION ALL SELECT repo_id FROM al WHERE name IN {Q._list_sql(L.GENERIC_NAMES)}) GROUP BY 1), "
    "dw AS (SELECT repo_id, count(*) AS c, arg_min(name, (-n, name)) AS w, max(n) AS m FROM df GROUP BY 1), cw AS (SELECT repo_id, count(*) AS c, arg_min(name, (-n, name)) AS w, max(n) AS m FROM cf GROUP BY 1) "
    "SELECT r.repo_id, coalesce(dw.c, 0) AS dup_count, coalesce(dw.w, '') AS dup_worst, coalesce(dw.m, 0) AS dup_worst_count, coalesce(cw.c, 0) AS coll_count, coalesce(cw.w, '') AS coll_worst, coalesce(cw.m, 0) AS coll_worst_count, coalesce(g.n, 0) AS generic_count "
    "FROM (SELECT DISTINCT repo_id FROM fs) r LEFT JOIN dw USING (repo_id) LEFT JOIN cw USING (repo_id) LEFT JOIN g USING (repo_id)"
)
def searchability(spark, d):
    part, pages = Q._read(spark, d, "part"), Q._page_files(spark, d)
    files = pages.unionByName(part.select(F.col("p_brand").alias("repo_id"), F.concat(F.lit("lib/"), F.col("p_size").cast("string"), F.lit("/util.py")).alias("path")))
    named = part.select(F.col("p_brand").alias("repo_id"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("path"), F.concat(F.lit("weigh"), (F.col("p_partkey") % 4).cast("string")).alias("name"))
    found = search.searchability(files, Q._part_functions(spark, d).unionByName(pages.withColumn("name", F.lit("process"))).unionByName(named))
    return found.fillna({"dup_worst": "", "coll_worst": "", "dup_worst_count": 0, "coll_worst_count": 0})


@query(
    f"WITH {Q._ITEMFN}, o AS (SELECT repo_id, 'q' || nesting || '_' || complexity AS name, path, line_count * 3 AS line_count, nesting, complexity, line_count * 10 + nesting AS start_line FROM lf WHERE complexity > 15 OR line_count * 3 > 100), "
    "u AS (SELECT DISTINCT * FROM o) SELECT repo_id, name, path, CAST(line_count AS INT) AS line_count, nesting, complexity, CAST(start_line AS INT) AS start_line, count(*) OVER (PARTITION BY repo_id) AS n_complex FROM u QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC, path, start_line) = 1"
)
def worst_function(spark, d):
    found = Q._item_functions(spark, d).withColumn("start_line", F.col("line_count") * 10 + F.col("nesting")).withColumn("line_count", F.col("line_count") * 3)
    found = found.withColumn("name", F.concat(F.lit("q"), F.col("nesting").cast("string"), F.lit("_"), F.col("complexity").cast("string"))).distinct()
    return score.worst_function(found)


@query(
    f"WITH {Q._FILES}, b AS (SELECT repo_id, language, count(*) AS n FROM files GROUP BY 1, 2) SELECT repo_id, language AS main_language, CASE language WHEN 'Rust' THEN 3.2::DOUBLE WHEN 'JavaScript' THEN 3.8::DOUBLE ELSE 3.5::DOUBLE END AS main_chars_per_token FROM b QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) = 1"
)
def main_language(spark, d):
    return scanning.main_language(scanning.language_breakdown(Q._files(spark, d)))


@query(
    f"SELECT o_orderkey, {_short('floor(o_totalprice * 7)')} AS short, printf('[%s%s]', repeat('#', CAST(o_orderkey % 6 AS INT)), repeat('-', CAST(5 - o_orderkey % 6 AS INT))) AS bar FROM orders"
)
def formatted(spark, d):
    o = Q._read(spark, d, "orders")
    return o.select("o_orderkey", S.short_number(F.floor(F.col("o_totalprice") * 7)).alias("short"), S.rating_bar(F.col("o_orderkey") % 6).alias("bar"))


@query(X.values("kinds", "kind, label", sorted(L.CONFIG_LABELS.items())).join(["WITH ", f", {Q._CONFIGS} SELECT repo_id, path, coalesce(label, 'Unknown') AS label FROM c LEFT JOIN kinds USING (kind)"]))
def config_labels(spark, d):
    return Q.config_kinds(spark, d).select("repo_id", "path", S.config_label(F.col("kind")).alias("label"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of the repositories of code and configuration texts."""
    s = api.scan_rows(X.table(spark, "repo_id string, path string, content string", X.CODE + X.CONFIG_TEXTS))
    a = api.analyze(s)
    return report.report_json(s, a, api.score(a), cut(api.recommend(s, a)))


_REPORTED = (
    f"{X.values('rf', 'repo_id, path, content', X.CODE + X.CONFIG_TEXTS)}, {X.values('ex', 'ext, language', sorted(L.EXTENSIONS.items()))}, {X.values('bn', 'bare, language', sorted(L.BARE_NAMES.items()))}, "
    f"kn AS (SELECT repo_id, path, content, coalesce(ex.language, bn.language) AS language FROM rf LEFT JOIN ex ON ex.ext = lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) LEFT JOIN bn ON bn.bare = lower({Q._BASE})), "
    f"kf AS (SELECT repo_id, path, language, strlen(content) AS b, {Q._LINES.format('content')} AS n FROM kn WHERE language IS NOT NULL), "
    "lg AS (SELECT repo_id, language, count(*) AS f, sum(n) AS l FROM kf GROUP BY 1, 2)"
)


@query(
    f"WITH {_REPORTED}, t AS (SELECT repo_id, count(*) AS total_files, CAST(sum(n) AS BIGINT) AS total_lines, CAST(sum(b) AS BIGINT) AS total_bytes, CAST(max(n) AS BIGINT) AS max_file_lines FROM kf GROUP BY 1), "
    "o AS (SELECT repo_id, string_agg(language || ':' || f || ':' || CAST(l AS BIGINT), ',' ORDER BY l DESC, language) AS languages FROM lg GROUP BY 1) "
    f"SELECT repo_id, total_files, total_lines, total_bytes, max_file_lines, languages, {repr(','.join(n for n, _ in L.DIMENSIONS))} AS dimensions, 176000 AS usable_context FROM t JOIN o USING (repo_id)"
)
def report_fields(spark, d):
    """What stands in the JSON reports."""
    kind = "summary struct<total_files: bigint, total_lines: bigint, total_bytes: bigint, max_file_lines: bigint, languages: array<struct<name: string, files: bigint, lines: bigint>>>, dimensions array<struct<name: string>>, context_budget struct<usable_context: bigint>"
    read = _reports(spark, d).select("repo_id", F.from_json("report", kind).alias("r"))
    languages = F.array_join(F.transform("r.summary.languages", lambda x: F.concat_ws(":", x["name"], x["files"], x["lines"])), ",")
    return read.select("repo_id", *[F.col(f"r.summary.{c}").alias(c) for c in ("total_files", "total_lines", "total_bytes", "max_file_lines")], languages.alias("languages"), F.array_join("r.dimensions.name", ",").alias("dimensions"), F.col("r.context_budget.usable_context").cast("int").alias("usable_context"))
