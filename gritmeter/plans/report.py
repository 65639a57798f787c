"""Reports of scored repositories: JSON rows for any number of them, texts for one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api
from ..functions import scalar as S
from ..operators import duplication, git
from ..operators import scan as scanning


def report_json(s: api.Scan, a: api.Analysis, sc: api.Score, recommended: DataFrame) -> DataFrame:
    """(repo_id, report): one JSON document a repository; the active surface is left out where no history is known."""
    lists = lambda df, order, cols, name: df.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias(name))
    dims = lists(sc.dimensions, "ordinal", ["name", "weight", "rating", "evidence"], "dimensions")
    recs = lists(recommended, "priority", ["estimated_reduction", "title", "target", "action", "evidence"], "recommendations")
    langs = scanning.language_breakdown(s.files).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("total_lines")).alias("o"), F.col("language").alias("name"), F.col("file_count").alias("files"), F.col("total_lines").alias("lines"), F.col("total_bytes").alias("bytes")))).alias("l"))
    langs = langs.select("repo_id", F.transform("l", lambda x: x.dropFields("o")).alias("languages"))
    confs = s.configs.groupBy("repo_id").agg(F.array_sort(F.collect_set(F.concat(S.config_label(F.col("kind")), F.lit(": "), F.col("path")))).alias("configs"))
    dups = duplication.duplicate_totals(a.clusters)
    wide = a.wide
    if s.commits is not None:
        windows = git.window(s.commits, s.now, s.months)
        hot = git.hot_files(s.files, git.frequency(s.commits, windows, s.now))
        hots = lists(hot, "rank", ["path", "commit_count", "lines"], "hot_files")
        hots = hots.select("repo_id", F.transform("hot_files", lambda x: x.dropFields("rank")).alias("hot_files"))
    else:
        hots = wide.select("repo_id", F.lit(None).cast("array<struct<path:string,commit_count:bigint,lines:int>>").alias("hot_files"))
    joined = sc.index.join(sc.budget, "repo_id").join(wide, "repo_id")
    for part in (dims, recs, langs, confs, dups, hots):
        joined = joined.join(part, "repo_id", "left")
    joined = joined.fillna({"duplicate_lines": 0})
    budget = F.struct(
        F.col("discovery").alias("file_discovery_tokens"), F.col("reading").alias("code_reading_tokens"), F.col("tracing").alias("dependency_tracing_tokens"), F.col("comprehension").alias("comprehension_tokens"),
        F.col("total_navigation").alias("total_navigation_tokens"), "usable_context", "navigation_pct", F.col("remaining").alias("remaining_tokens"),
    )
    summary = F.struct("total_files", "total_lines", "total_bytes", "max_file_lines", "avg_file_lines", "languages", "test_files", "source_files", "configs")
    surface = F.when(F.col("is_git") & (F.col("active_files") > 0), F.struct("active_files", "active_lines", "active_bytes", "frozen_files", "frozen_bytes", "window_days", "window_label", "total_commits", "hot_files"))
    doc = F.struct(
        "friction_index", "verdict", "raw_score", "size_multiplier", F.transform("dimensions", lambda x: x.dropFields("ordinal")).alias("dimensions"), budget.alias("context_budget"),
        F.coalesce("recommendations", F.array().cast(joined.schema["recommendations"].dataType)).alias("recommendations"), summary.alias("summary"), surface.alias("active_surface"),
        F.struct(F.coalesce("cluster_count", F.lit(0)).alias("cluster_count"), F.col("duplicate_lines").alias("total_duplicate_lines")).alias("duplicates"),
    )
    return joined.drop("cluster_count").join(dups.select("repo_id", "cluster_count"), "repo_id", "left").select("repo_id", F.to_json(doc).alias("report"))


def instructions(report: dict) -> str:
    """Text for a language model that is to improve the repository, from one parsed report."""
    s, b = report["summary"], report["context_budget"]
    out = ["CODEBASE IMPROVEMENT INSTRUCTIONS", f"Current friction index: {report['friction_index']}/100 ({report['verdict']})", ""]
    out.append(f"Codebase: {s['total_files']} files, {s['total_lines']} lines across {len(s['languages'])} languages.")
    if a := report.get("active_surface"):
        out.append(f"Active surface: {a['active_files']} files, {a['active_lines']} lines (changed in last {a['window_label']}). {a['frozen_files']} files frozen.")
    out += ["", f"Context budget: ~{b['total_navigation_tokens']} tokens navigation cost ({b['navigation_pct']:.1f}% of usable context).", ""]
    out += ["Lower the index: make these fixes in order of priority. The index expected after each one is given.", ""]
    running = report["friction_index"]
    for r in report["recommendations"]:
        running = max(0, running - r["estimated_reduction"])
        out += [f"PRIORITY {r['priority']}: {r['title']} (estimated index after: {running})", f"Target: {r['target']}", f"Evidence: {r['evidence']}", f"Action: {r['action']}", ""]
    out += ["DIMENSION DETAILS", ""]
    return "\n".join(out + [f"- {d['name']} (score {d['rating']}/5, weight {d['weight']}): {d['evidence']}" for d in report["dimensions"]])


def _short(n: float) -> str:
    return f"{n / 1e6:.1f}M" if n >= 1e6 else f"{n / 1e3:.1f}k" if n >= 1e3 else str(int(n))


def terminal(report: dict, verbose: bool = False, with_budget: bool = False) -> str:
    """Text for a terminal, from one parsed report."""
    s, out = report["summary"], [f"Friction index: {report['friction_index']}/100  {report['verdict']}"]
    if report["size_multiplier"] < 0.95:
        out.append(f"(raw {report['raw_score']:.0f} x size {report['size_multiplier']:.2f})")
    out.append(f"{_short(s['total_files'])} files, {_short(s['total_lines'])} lines; largest {s['max_file_lines']} lines")
    out += [f"  {x['name']}: {x['files']} files, {_short(x['lines'])} lines" for x in s["languages"][:5]]
    if a := report.get("active_surface"):
        out.append(f"Active: {a['active_files']} files in {a['window_label']}, {a['frozen_files']} frozen")
        out += [f"  {h['path']}: {h['commit_count']} commits" for h in (a.get("hot_files") or [])[:3]]
    kinds = list(dict.fromkeys(c.split(":")[0] for c in s.get("configs") or []))[:6]
    out.append("Configs: " + (", ".join(kinds) or "none"))
    ordered = sorted(report["dimensions"], key=lambda d: -d["weight"] * d["rating"])
    for d in ordered if verbose else ordered[:6]:
        out.append(f"[{'#' * d['rating']}{'-' * (5 - d['rating'])}] {d['name']} ({d['weight']}): {d['evidence']}")
    if with_budget:
        b = report["context_budget"]
        out += [f"{k.replace('_', ' ')}: {_short(b[k])}" for k in ("file_discovery_tokens", "code_reading_tokens", "dependency_tracing_tokens", "comprehension_tokens", "total_navigation_tokens", "remaining_tokens")]
    running = report["friction_index"]
    for r in report["recommendations"][:5]:
        running = max(0, running - r["estimated_reduction"])
        out.append(f"{r['priority']}. {r['title']} (-{r['estimated_reduction']})")
    return "\n".join([*out, f"After these fixes: {running}/100"])


def exit_code(index: int, max_score: int | None = None, ci: bool = False) -> int:
    """1 if the index is over ``max_score``; without one, ``ci`` fails on any friction."""
    return int(index > max_score) if max_score is not None else int(ci and index > 0)
