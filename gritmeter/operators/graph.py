"""The import graph: fan-out, fan-in, strongly connected components; directory layers built on it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.cut import cut


def _fan(imports: DataFrame, key: str, prefix: str) -> DataFrame:
    counted = imports.groupBy("repo_id", key).agg(F.count(F.lit(1)).alias("n"))
    worst = F.min_by(F.col(key), F.struct(-F.col("n"), F.col(key)))
    return counted.groupBy("repo_id").agg(F.avg("n").alias(f"avg_{prefix}"), F.max("n").alias(f"max_{prefix}"), worst.alias(f"max_{prefix}_name"))


def fan_out(imports: DataFrame) -> DataFrame:
    """(repo_id, avg_fan_out, max_fan_out, max_fan_out_name) over files with imports; ties by name."""
    return _fan(imports, "path", "fan_out")


def fan_in(imports: DataFrame) -> DataFrame:
    """(repo_id, avg_fan_in, max_fan_in, max_fan_in_name) over imported modules; ties by name."""
    return _fan(imports, "module_path", "fan_in")


def edges(imports: DataFrame) -> DataFrame:
    """(repo_id, src, dst): file to the module string that it names."""
    return imports.select("repo_id", F.col("path").alias("src"), F.col("module_path").alias("dst")).distinct()


def strong_components(pairs: list[tuple[str, str]]) -> Iterator[list[str]]:
    """Components of more than one node, sorted, of a directed graph, with explicit stacks."""
    out: dict[str, list[str]] = {}
    for a, b in sorted(set(pairs)):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    path: list[str] = []
    inside: set[str] = set()
    for root in out:
        if root in seen:
            continue
        work = [(root, iter(out[root]))]
        seen[root] = low[root] = len(seen)
        path.append(root)
        inside.add(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in seen:
                    seen[other] = low[other] = len(seen)
                    path.append(other)
                    inside.add(other)
                    work.append((other, iter(out[other])))
                    break
                if other in inside:
                    low[node] = min(low[node], seen[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == seen[node]:
                    part = []
                    while True:
                        x = path.pop()
                        inside.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    if len(part) > 1:
                        yield sorted(part)


def trimmed(graph: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges that may lie on a cycle: a node without edges in or without edges out is on none, and is peeled off ``rounds`` times.

    In ordinary import graphs modules import nothing, so this leaves next to
    nothing for the component search of a repository.
    """
    left = cut(graph.where("src != dst").select("repo_id", "src", "dst"))
    for _ in range(rounds):
        both = left.select("repo_id", F.col("src").alias("node")).intersect(left.select("repo_id", F.col("dst").alias("node")))
        left = cut(left.join(both.withColumnRenamed("node", "src"), ["repo_id", "src"], "left_semi").join(both.withColumnRenamed("node", "dst"), ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst"))
    return left


def _spread(nodes: DataFrame, graph: DataFrame, come: str, go: str) -> DataFrame:
    """(repo_id, node, colour) with each colour the least that reaches the node along edges from ``come`` to ``go``."""
    step = graph.select("repo_id", F.col(come).alias("node"), F.col(go).alias("to"))
    before = None
    while True:
        sent = nodes.join(step, ["repo_id", "node"]).select("repo_id", F.col("to").alias("node"), "colour")
        nodes = cut(nodes.unionByName(sent).groupBy("repo_id", "node").agg(F.min("colour").alias("colour")))
        now = nodes.agg(F.sum(F.xxhash64("repo_id", "node", "colour").cast("decimal(38,0)"))).first()
        if now == before:
            return nodes
        before = now


def coloured(graph: DataFrame) -> DataFrame:
    """(repo_id, members, size) of components, without any task that sees a whole graph.

    Every node takes the least name that reaches it; those that reach that node
    again inside their colour are its component. They are taken out, and the rest
    is coloured anew until no edges are left.
    """
    found, left = None, cut(graph)
    while not left.isEmpty():
        nodes = left.select("repo_id", F.col("src").alias("node")).union(left.select("repo_id", "dst")).distinct()
        colours = _spread(nodes.withColumn("colour", F.col("node")), left, "src", "dst")
        a, b = (colours.select("repo_id", F.col("node").alias(x), F.col("colour").alias(f"{x}_colour")) for x in ("src", "dst"))
        inside = cut(left.join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"]).where("src_colour = dst_colour").select("repo_id", "src", "dst", F.col("src_colour").alias("colour")))
        # Back from each colour's own node; a node's colour is told apart by the names reached, as edges stay inside.
        back = colours.withColumn("reached", F.col("node") == F.col("colour"))
        step = inside.select("repo_id", F.col("dst").alias("node"), F.col("src").alias("to"))
        got, size = cut(back.where("reached").select("repo_id", "node", "colour")), -1
        while (n := got.count()) != size:
            size = n
            got = cut(got.unionByName(got.join(step, ["repo_id", "node"]).select("repo_id", F.col("to").alias("node"), "colour")).distinct())
        parts = cut(got.groupBy("repo_id", "colour").agg(F.array_sort(F.collect_list("node")).alias("members")).select("repo_id", "members", F.size("members").alias("size")).where("size > 1"))
        found = parts if found is None else found.unionByName(parts)
        gone = got.select("repo_id", "node")
        for side in ("src", "dst"):
            left = left.join(gone.withColumnRenamed("node", side), ["repo_id", side], "left_anti")
        left = cut(left)
    return graph.select("repo_id", F.array("src").alias("members"), F.lit(1).alias("size")).where("false") if found is None else found


#: Edges of a repository, of those that may lie on a cycle, up to which one task searches it.
LOCAL_EDGES = 1_000_000


def cycles(graph: DataFrame) -> DataFrame:
    """(repo_id, members, size) of the strongly connected components of more than one node of (repo_id, src, dst); repositories of up to LOCAL_EDGES edges are searched by one task each, larger ones by colours."""
    open_ = trimmed(graph)
    large = cut(open_.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges")).where(F.col("edges") > LOCAL_EDGES).select("repo_id"))
    if large.isEmpty():
        return _local_cycles(open_)
    return _local_cycles(open_.join(large, "repo_id", "left_anti")).unionByName(coloured(open_.join(large, "repo_id", "left_semi")))


def _local_cycles(graph: DataFrame) -> DataFrame:
    def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = list(strong_components(list(zip(rows["src"], rows["dst"], strict=True))))
        return pd.DataFrame({"repo_id": [key[0]] * len(found), "members": found, "size": [len(m) for m in found]})

    return graph.groupBy("repo_id").applyInPandas(find, "repo_id string, members array<string>, size int")


def cycle_stats(found: DataFrame) -> DataFrame:
    """(repo_id, cycle_count, largest_cycle, largest_members); ties by the members' names."""
    largest = F.min_by("members", F.struct(-F.col("size"), F.col("members")))
    return found.groupBy("repo_id").agg(F.count(F.lit(1)).alias("cycle_count"), F.max("size").alias("largest_cycle"), largest.alias("largest_members"))


def import_stats(imports: DataFrame, files: DataFrame) -> DataFrame:
    """All of the above a repository, zeros where there are no imports."""
    base = files.select("repo_id").distinct()
    zero = {"avg_fan_out": 0.0, "max_fan_out": 0, "avg_fan_in": 0.0, "max_fan_in": 0, "cycle_count": 0, "largest_cycle": 0}
    return base.join(fan_out(imports), "repo_id", "left").join(fan_in(imports), "repo_id", "left").join(cycle_stats(cycles(edges(imports))), "repo_id", "left").fillna(zero)


def groups(files: DataFrame) -> DataFrame:
    """(repo_id, path, grp): directory group of each file that has one."""
    return files.select("repo_id", "path", S.layer_group(F.col("path")).alias("grp")).where("grp is not null")


def layer_edges(imports: DataFrame, grouped: DataFrame) -> DataFrame:
    """(repo_id, src, dst) between different groups: an import's module is a group by name, else by the first of its parts that is part of a group's name.

    Where a part belongs to several groups the first by name is taken.
    """
    names = grouped.select("repo_id", "grp").distinct()
    parts = names.select("repo_id", "grp", F.explode(F.split("grp", "/")).alias("part")).where("part != ''").groupBy("repo_id", "part").agg(F.min("grp").alias("target"))
    by_file = imports.select("repo_id", "path", "module_path").distinct().join(grouped, ["repo_id", "path"]).select("repo_id", "grp", "module_path").distinct()
    exact = by_file.join(names.select("repo_id", F.col("grp").alias("module_path")), ["repo_id", "module_path"], "left_semi").select("repo_id", "grp", "module_path", F.col("module_path").alias("target"))
    pieces = by_file.join(exact.select("repo_id", "grp", "module_path"), ["repo_id", "grp", "module_path"], "left_anti").select("repo_id", "grp", "module_path", F.posexplode(F.split("module_path", r"[/.:\\]")).alias("pos", "part"))
    loose = pieces.join(parts, ["repo_id", "part"]).groupBy("repo_id", "grp", "module_path").agg(F.min_by("target", "pos").alias("target"))
    return exact.unionByName(loose).where("grp != target").select("repo_id", F.col("grp").alias("src"), F.col("target").alias("dst")).distinct()


def bidirectional(layered: DataFrame) -> DataFrame:
    """(repo_id, a, b) of groups that import one another, a before b."""
    back = layered.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return layered.join(back, ["repo_id", "src", "dst"], "left_semi").where("src < dst").select("repo_id", F.col("src").alias("a"), F.col("dst").alias("b"))


def god_modules(layered: DataFrame, group_counts: DataFrame) -> DataFrame:
    """(repo_id, grp, in_degree) of groups that three fifths of all groups import, where there are three or more."""
    degree = layered.groupBy("repo_id", F.col("dst").alias("grp")).agg(F.count(F.lit(1)).alias("in_degree"))
    return degree.join(group_counts, "repo_id").where((F.col("groups") >= 3) & (F.col("in_degree") >= F.ceil(F.col("groups") * 0.6))).select("repo_id", "grp", "in_degree")


def layering(layered: DataFrame) -> DataFrame:
    """(repo_id, layering_score): share of connected pairs of groups that import in one direction only."""
    pair = layered.groupBy("repo_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return pair.groupBy("repo_id").agg((F.count_if(F.col("n") == 1) / F.count(F.lit(1))).alias("layering_score"))


def layers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, groups, layer_violations, god_modules, layering_score)."""
    grouped = groups(files)
    counts = grouped.groupBy("repo_id").agg(F.count_distinct("grp").alias("groups"))
    layered = layer_edges(imports, grouped)
    both = bidirectional(layered).groupBy("repo_id").agg(F.count(F.lit(1)).alias("layer_violations"))
    gods = god_modules(layered, counts).groupBy("repo_id").agg(F.count(F.lit(1)).alias("god_modules"))
    out = files.select("repo_id").distinct()
    for part in (counts, both, gods, layering(layered)):
        out = out.join(part, "repo_id", "left")
    return out.fillna({"groups": 0, "layer_violations": 0, "god_modules": 0, "layering_score": 1.0})


