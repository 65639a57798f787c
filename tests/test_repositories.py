"""Whole runs over two small repositories on disk: a tidy one and a messy one."""

import json
import subprocess

import pytest

from gritmeter import api
from gritmeter.plans import report

TIDY = {
    "README.md": "# Tidy\n\nInstall it, then run `tidy`.\n",
    "pyproject.toml": "[project]\nname = \"tidy\"\n\n[tool.ruff]\nline-length = 100\n\n[tool.mypy]\nstrict = true\n\n[tool.black]\n\n[tool.pytest.ini_options]\n",
    "src/main.py": "from utils import add\n\n\ndef run(first, second):\n    return add(first, second)\n",
    "src/utils.py": "def add(first, second):\n    return first + second\n",
    "tests/test_utils.py": "from utils import add\n\n\ndef test_add():\n    assert add(1, 2) == 3\n",
}
MESSY = {
    "src/motor.py": (
        "from assist import *\nimport json\nimport sys\n\n# TODO tidy this\n# FIXME and this\n\nSTORE = []\nLOOKUP = {}\n\ndef fetchRows(src):\n    # if src: return\n    print(src)\n    try:\n        return json.loads(src)\n"
        "    except:\n        pass\n\ndef shapeRows(rows):\n    for r in rows:\n        if r:\n            print(r)\n    return rows\n\ndef Wrap(x):\n    return x\n\ndef sum_up(rows):\n    total = 0\n    while rows:\n        total += rows.pop()  # HACK\n    return total\n\nSIZES = [1]\n"
    ),
    "src/assist.py": "import os\n\ndef join_all(parts):\n    return os.path.join(*parts)\n\ndef limit(n):\n    if n > 9000:\n        print(n)\n    return n\n",
}


def _write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("repositories")
    roots = {"tidy": _write(base / "a" / "tidy", TIDY), "messy": _write(base / "a" / "messy", MESSY)}
    s = api.scan(spark, roots, use_git=False)
    a = api.analyze(s)
    return s, a, api.score(a)


def _by(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_golden_counts(both):
    _, a, _ = both
    found = [p for r, p in _by(a.anti_patterns, "repo_id", "pattern") if r == "messy"]
    assert {k: found.count(k) for k in set(found)} == {"todo_placeholder": 3, "debug_print": 3, "commented_code": 1, "bare_except": 1, "empty_catch": 1, "star_import": 1, "magic_number": 1}
    assert [x for r, x in _by(a.global_mutables, "repo_id", "line") if r == "messy"] == [8, 9, 34]
    assert _by(a.functions.where("repo_id = 'messy'"), "name", "start_line", "line_count", "complexity", "nesting") == [
        ("Wrap", 25, 2, 1, 0), ("fetchRows", 11, 7, 2, 1), ("join_all", 3, 2, 1, 0), ("limit", 6, 4, 2, 1), ("shapeRows", 19, 5, 3, 2), ("sum_up", 28, 5, 2, 1),
    ]
    assert _by(a.imports.where("repo_id = 'messy'"), "module_path") == [("assist",), ("json",), ("os",), ("sys",)]
    wide = {r["repo_id"]: r for r in a.wide.collect()}
    assert wide["messy"]["dominant_ratio"] == 0.5 and wide["tidy"]["dominant_ratio"] == 1.0
    assert wide["messy"]["total_files"] == 2 and wide["tidy"]["total_files"] == 5 and wide["tidy"]["test_files"] == 1


def test_configuration_is_found(both):
    s, _, _ = both
    assert {k for r, k in _by(s.configs, "repo_id", "kind") if r == "tidy"} == {"Readme", "DependencyManager", "Linter", "TypeChecker", "TestFramework", "Formatter"}


def test_index_dimensions_and_fixes(both):
    s, a, sc = both
    index = {r["repo_id"]: r["friction_index"] for r in sc.index.collect()}
    assert index["tidy"] <= 50 and all(0 <= x <= 100 for x in index.values())
    dims = sc.dimensions.collect()
    assert len(dims) == 20 and all(0 <= r["rating"] <= 5 for r in dims) and sum(r["weight"] for r in dims) == 200
    raw = {r["repo_id"]: r["raw_score"] for r in sc.index.collect()}
    assert raw["tidy"] < raw["messy"]
    assert {r["repo_id"] for r in api.recommend(s, a).collect()} >= {"messy"}


def test_ignored_files_are_left_out(spark, tmp_path):
    root = _write(tmp_path / "messy", MESSY)
    assert api.scan(spark, {"m": root}, ignore=["*motor*"], use_git=False).files.count() == 1


def test_reports(both):
    s, a, sc = both
    rows = report.report_json(s, a, sc, api.recommend(s, a)).collect()
    for r in rows:
        doc = json.loads(r["report"])
        assert len(doc["dimensions"]) == 10 and doc["context_budget"]["usable_context"] == 176000
        text = report.terminal(doc, verbose=True, with_budget=True)
        assert text.startswith(f"Friction index: {doc['friction_index']}/100") and text.count("[") >= 10 and text.rstrip().endswith("/100")
        told = report.instructions(doc)
        assert told.startswith("CODEBASE IMPROVEMENT INSTRUCTIONS") and f"PRIORITY {len(doc['recommendations'])}:" in told and "DIMENSION DETAILS" in told


def test_history(spark, tmp_path):
    root = _write(tmp_path / "messy", MESSY)
    run = lambda *x: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", "-C", root, *x], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "messy" / "src" / "motor.py").write_text(MESSY["src/motor.py"] + "\n")
    run("commit", "-qam", "two")
    s = api.scan(spark, {"m": root})
    assert sorted((r["path"].rsplit("/", 1)[-1], r["count"]) for r in s.commits.groupBy("path").count().collect()) == [("assist.py", 1), ("motor.py", 2)]
    wide = api.analyze(s).wide.first()
    assert wide["is_git"] and wide["total_commits"] == 2 and wide["active_files"] == 2
