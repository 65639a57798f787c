import random
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gritmeter import api
from gritmeter import lookups as L
from gritmeter.operators import duplication, graph
from gritmeter.plans import fixtures as X
from gritmeter.plans import report, score
from gritmeter.sources import files as sources


def _ring(*nodes):
    return list(zip(nodes, nodes[1:] + nodes[:1], strict=True))


def _path(*nodes):
    return list(zip(nodes, nodes[1:]))


@pytest.mark.parametrize(
    "pairs,parts",
    [
        (_path("ui", "core", "db"), []), (_ring("ui", "core"), [["core", "ui"]]), (_ring("ui", "core", "db"), [["core", "db", "ui"]]), (_path("ui", "x", "db") + _path("ui", "y", "db"), []),
        (_ring("ui", "x") + _ring("db", "y"), [["db", "y"], ["ui", "x"]]), (_ring("p", "q", "r", "s") + _path("s", "t"), [["p", "q", "r", "s"]]), (_ring("self"), []),
    ],
)
def test_components(pairs, parts):
    assert sorted(graph.strong_components(pairs)) == parts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_colours(spark, seed):
    import random

    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)] + _ring("a", "b", "c")
    rows = [(r, x, y) for r in ("one", "two") for x, y in pairs if x != y]
    found = graph.coloured(spark.createDataFrame(rows, "repo_id string, src string, dst string")).collect()
    want = sorted(graph.strong_components(pairs))
    assert sorted(x["members"] for x in found if x["repo_id"] == "one") == want == sorted(x["members"] for x in found if x["repo_id"] == "two")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=20))
def test_components_are_mutual_reachability(pairs):
    named = [(str(a), str(b)) for a, b in pairs]
    reach = {x: {x} for p in named for x in p}
    for _ in range(8):
        for a, b in named:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {tuple(sorted(y for y in reach[x] if x in reach[y])) for x in reach}
    assert {tuple(c) for c in graph.strong_components(named)} == {w for w in want if len(w) > 1}


def test_cycles_per_repository(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("q", "a", "b"), ("r", "c", "a")], "repo_id string, src string, dst string")
    assert [(r["repo_id"], r["members"]) for r in graph.cycles(edges).collect()] == [("r", ["a", "b"])]
    assert graph.cycles(edges.limit(0)).count() == 0


def _chunk(name):
    return "\n".join(f"if {name} and value_{i} is not None: return self.{name}[{i}]" for i in range(9)) + "\n"


def test_duplicates(spark):
    from gritmeter.operators.scan import files_from

    rows = [("r", "a.py", _chunk("alpha")), ("r", "b.py", _chunk("beta")), ("r", "c.py", "x = 1\n" * 20), ("q", "a.py", _chunk("alpha"))]
    df = spark.createDataFrame(rows, "repo_id string, path string, content string")
    files = files_from(df, F.col("repo_id"), F.col("path"), F.col("content"))
    got = duplication.clusters(files).collect()
    assert got and {r["repo_id"] for r in got} == {"r"} and all(r["n_files"] == 2 for r in got)
    assert all(0 < r["similarity"] < 1 for r in duplication.similarity(files).collect())


def test_normalize():
    assert duplication.normalize("if  x == 'a b' : return 12abc") == 'if _ID_ == "_ID_" : return 12_ID_'
    assert list(duplication.chunks_of("short\n" * 7)) == []


def _chunks_by_definition(content):
    """Every window normalised as a whole."""
    lines = duplication.lines_of(content)
    step = 4 if len(lines) > 2000 else 2 if len(lines) > 500 else 1
    for start in range(0, len(lines) - 7, step):
        raw = "\n".join([x for x in map(str.strip, lines[start : start + 8]) if x and not x.startswith(("//", "#"))])
        plain = duplication.normalize(raw)
        if len(raw.encode()) >= 60 and len(plain.encode()) >= 30 and sum(t in L.DUP_KEYWORDS for t in plain.split()) >= 2:
            yield start + step, raw, plain


def test_chunks_against_their_definition():
    rng, found = random.Random(3), 0
    parts = ["if", "for x", "a1if", "1if", '"', "'", "''", '"a b"', "'c", "  ", "\t", "\n", "\n", "\r\n", "\x0b", "\x0c", "\u2028", "\x85", "\xa0", "#", "//", "é", "return", "name_of_it", "();", "9", "日本", "while("]
    for n in [40, 300, 400] * 300 + [4000, 9000] * 3:
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(n)))
        got = list(duplication.chunks_of(text))
        assert got == list(_chunks_by_definition(text))
        found += len(got)
    assert found > 1000


def test_a_line_is_normalised_once(monkeypatch):
    """Windows overlap by seven lines of eight: only those with a quote that stays open in its line are normalised as a whole."""
    asked = []
    monkeypatch.setattr(duplication, "normalize", lambda x, f=duplication.normalize: asked.append(x) or f(x))
    lines = [f"if value_{i} is None: return 'none of {i}' # and more of it" for i in range(100)]
    assert len(list(duplication.chunks_of("\n".join(lines)))) == 93 and not asked
    lines[50] += " don't"
    assert len(list(duplication.chunks_of("\n".join(lines)))) == 93 and len(asked) == 8


def test_similarity_shuffled(spark, monkeypatch):
    rows = [("r", f"p{i}", "\n".join(f"if value_{i}_{j} is None: return other_value_{j} and more" for j in range(12))) for i in range(4)] + [("r", "none", "x")]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    got = sorted(map(tuple, duplication.similarity(files).collect()))
    monkeypatch.setattr(duplication, "BROADCAST_FILES", -1)
    assert got and got == sorted(map(tuple, duplication.similarity(files).collect()))


def test_score_bounds(spark):
    wide = X.score_table(spark, spark.createDataFrame([(7,), (8,)], "c_custkey long"))
    rows = score.dimensions(wide).collect()
    assert len(rows) == 10 * (len(X.SCORES) + 2) and all(0 <= r["rating"] <= 5 for r in rows)
    assert sum(r["weight"] for r in rows if r["repo_id"] == "blank") == 100
    index = {r["repo_id"]: r["friction_index"] for r in score.index(wide).collect()}
    assert index["clean"] <= 5 and index["heavy"] > 80 and index["blank"] == 0


def test_recommendations_are_ranked(spark):
    from gritmeter.plans.queries import _recommended

    rows = _recommended(spark, "/root/testdata/sf0.001").orderBy("repo_id", "priority").collect()
    for repo in {r["repo_id"] for r in rows}:
        own = [r for r in rows if r["repo_id"] == repo]
        assert [r["priority"] for r in own] == list(range(1, len(own) + 1)) and len(own) <= 10
        assert [r["estimated_reduction"] for r in own] == sorted([r["estimated_reduction"] for r in own], reverse=True)


@pytest.mark.parametrize("name", ["recommendation_texts", "recommendations", "running_index"])
def test_fixes_are_ranked_inside_a_row(spark, monkeypatch, name):
    """No task holds the fixes of many repositories to sort them."""
    from gritmeter.plans.queries import QUERIES

    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Window", "Sort [", "hashpartitioning") if x in plan]
    monkeypatch.setattr(score, "BROADCAST_REPOS", -1)
    shuffled = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, shuffled.collect()))


def test_exit_code():
    assert [report.exit_code(*a) for a in ((51, 50), (50, 50), (0, None, True), (1, None, True), (90, None, False))] == [1, 0, 0, 1, 0]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in {"README.md": "# x\n\nInstall it.\n", ".gitignore": "skip/\n*.log.py\n", "src/a.py": "import b\n\ndef runAll(x):\n    print(x)\n", "src/b.py": "STATE = []\n", "skip/c.py": "x\n", "src/d.log.py": "y\n", "node_modules/e.js": "z\n", "pyproject.toml": "[tool.ruff]\n", "bin.py": None}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"\xff\xfe" if text is None else text.encode())
    git = ["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com"]
    for command in (["init", "-q"], ["add", "-f", "src/a.py", "README.md"], ["commit", "-qm", "x"]):
        subprocess.run([*git, *command], check=True)
    return str(root)


def test_folder_scan(spark, folder):
    entries = sources.listing(spark, {"r": folder})
    assert {r["path"] for r in sources.files(entries).collect()} == {"README.md", "src/a.py", "src/b.py", "pyproject.toml"}
    assert {r["path"] for r in sources.files(entries, ["*a.py"]).collect()} == {"README.md", "src/b.py", "pyproject.toml"}
    assert {r["path"] for r in sources.commits(spark, {"r": folder}).collect()} == {"src/a.py", "README.md"}
    assert "src/a.py" in {r["path"] for r in sources.binary_files(spark, folder, "r").collect()}


def test_listing_of_files_proper(tmp_path):
    import os

    (tmp_path / "a.py").write_text("x\n")
    (tmp_path / "own.py").write_text("x\n")
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    os.mkfifo(tmp_path / "pipe.py")
    (tmp_path / ".git" / "info").mkdir(parents=True)
    (tmp_path / ".git" / "info" / "exclude").write_text("own.py\n")
    assert [p for p, is_dir, *_ in sources.walk(str(tmp_path)) if not is_dir] == ["a.py"]


def test_four_calls(spark, folder):
    import json

    s = api.scan(spark, {"r": folder})
    a = api.analyze(s)
    got = json.loads(report.report_json(s, a, api.score(a), api.recommend(s, a)).first()["report"])
    assert got["summary"]["total_files"] == 4 and got["active_surface"]["active_files"] == 2
    assert len(got["dimensions"]) == 10 and got["recommendations"][0]["priority"] == 1
    assert "DIMENSION DETAILS" in report.instructions(got) and "Friction index" in report.terminal(got, True, True)
