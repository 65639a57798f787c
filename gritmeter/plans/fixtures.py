"""Small tables that both engines build from the same rows: paths, configuration texts, code, and wide score rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .score import DEFAULTS

PATHS = [
    "src/main.py", "src/App.tsx", "lib/util.RS", "Makefile", "build/Dockerfile", "docs/read.me.md", ".toml", "a/.hidden.json", "notes.txt", "x/y/z/deep.test.js", "tests/test_a.py", "pkg/tests/b.go",
    "pkg/spec/c_spec.rb", "conftest.py", "src/output/print.py", "ui/view.ts", "src/logging/log.py", "vendor/a.js", "src/node_modules/b.js", "Src/__tests__/q.jsx", "a.b/c", "./src/main.rs", "one/two.c", "one.h",
    "gen/proto/x.pb.cc", "src/Foo.Test.ts", "deps/third_party/k.php", "GNUmakefile", "data.yaml", "q/r/s/t.kt",
]

LISTING = [
    ("r1", "README.md", 1), ("r1", "pyproject.toml", 1), ("r1", ".gitignore", 1), ("r1", "src", 1), ("r1", "docs", 1), ("r1", "src/app/package.json", 3), ("r1", "a/b/c/Cargo.toml", 4), ("r1", "biome.json", 1),
    ("r2", ".editorconfig", 1), ("r2", "node_modules/x/package.json", 3), ("r2", ".github", 1), ("r2", ".github/Dockerfile", 2), ("r2", "web/Dockerfile", 2), ("r2", "web/yarn.lock", 2), ("r2", "Makefile", 1), ("r2", "readme.MD", 1),
]

CONFIG_TEXTS = [
    ("r1", "README.md", "# Tool\n\nHow to run: `make run`\n"), ("r1", "docs/README.md", "Nothing here."), ("r1", "pyproject.toml", "[tool.ruff]\nx=1\n[tool.mypy]\n[tool.pytest.ini_options]\n[tool.black]\n"),
    ("r1", "Makefile", "build: dep\n\techo\ntest :\n\techo\nother:\n"), ("r1", "Dockerfile", "from python:3\n  run pip install x\n"), ("r2", "readme.md", "install me"), ("r2", "Makefile", "deploy:\n"),
    ("r2", "Dockerfile", "FROM scratch\nCOPY a b\n"), ("r3", "compose.yml", "services: {}"), ("r3", "justfile", "lint:\n  x\ndev:\n"), ("r3", "README", "See ./start"),
]

CODE = [
    ("r1", "src/engine.py", "import os\nfrom helpers import *\n\nCACHE = []\nSTATE = {}\nlimit = 5000  # TODO tune\n\ndef getData(x):\n    # if x: old()\n    print(x)\n    try:\n        return x\n    except:\n        pass\n"),
    ("r1", "src/helpers.py", "import os\n\ndef calculate_total(items):\n    total = 0\n    for i in items:\n        if i > 100:\n            total += i\n    return total\n\nclass Pool:\n    _instance = None\n    items = []\n\n    def get_instance(self):\n        return self._instance\n\nconnect(1)\n"),
    ("r1", "tests/test_engine.py", "from engine import getData\nVALUES = []\n\ndef test_it():\n    print(getData(1))\n"),
    ("r1", "web/app.js", "import x from './engine';\nvar registry = {};\nfunction loadAll(a, b) {\n                if (a) { return b; }\n  console.log(a);\n  try { b(); } catch (e) {}\n}\nwindow.addEventListener('x', () => { loadAll(1, 2); });\n"),
    ("r1", "web/server.js", "const express = require('express');\napp.get('/', (req, res) => { res.send(1); });\nclass One { static getInstance() { return One._instance; } }\n"),
    ("r2", "lib/core.rs", "use std::fmt;\n\nstatic mut COUNT: i32 = 0;\n\nfn narrow_path(x: i32) -> i32 {\n    match x {\n        1 => 2,\n        _ => 3,\n    }\n}\n"),
    ("r2", "lib/run.go", "package lib\n\nimport (\n\t\"fmt\"\n\t\"os\"\n)\n\nfunc Run(a int) int {\n\tif a == 404 {\n\t\tfmt.Println(a)\n\t}\n\treturn a\n}\n"),
    ("r2", "lib/Main.java", "import java.util.List;\n\nclass Main {\n  int weigh(int a) {\n    if (a > 1) { return 2; }\n    return 1;\n  }\n}\n"),
    ("r2", "lib/tool.c", "#include <stdio.h>\n\nint main(int c, char **v) {\n  while (c) { c--; }\n  return 0;\n}\n"),
    ("r2", "lib/job.rb", "require 'json'\n\ndef perform(a)\n  if a\n    puts a\n  end\nend\n"),
    ("r2", "lib/page.php", "<?php\nuse App\\Model;\nclass Page { public function show($a) { foreach ($a as $b) { if ($b) { echo $b; } } } }\n"),
    ("r2", "lib/form.tsx", "import React from 'react';\nexport const Form = (p) => { return p.ok ? 1 : 2; };\n"),
]

#: (repo_id, name, path, start_line, line_count)
DEAD_FUNCTIONS = [
    ("r1", "orphanRoutine", "a/lonely.py", 1, 20), ("r1", "orphanRoutine", "b/second.py", 1, 30), ("r1", "mentionedHere", "a/lonely.py", 30, 25), ("r1", "wideInnerThing", "a/island.py", 1, 40),
    ("r1", "shortOne", "a/island.py", 50, 10), ("r1", "getSomething", "a/island.py", 60, 30), ("r1", "test_something", "a/island.py", 90, 30), ("r1", "linkedThing", "a/linked.py", 1, 30),
    ("r1", "namedInImport", "a/island.py", 120, 30), ("r2", "quietHelper", "q.py", 1, 16),
]
DEAD_FILES = [
    ("r1", "a/lonely.py", "def orphanRoutine(): pass\ndef mentionedHere(): pass\n"), ("r1", "b/second.py", "x = mentionedHereToo(1)\norphan = 1\n"), ("r1", "a/island.py", "def wideInnerThing(): pass\n"),
    ("r1", "a/linked.py", "def linkedThing(): pass\n"), ("r1", "main.py", "import linked\nrun(linked)\n"), ("r2", "q.py", "def quietHelper(): pass\n"),
]
DEAD_IMPORTS = [("r1", "main.py", "pkg.linked"), ("r1", "main.py", "pkg/namedInImport"), ("r1", "b/second.py", "os")]

LOGS = [("r1", "src/a.py\nsrc/b.py\n\nsrc/a.py\n  \nsrc/c.py\n"), ("r2", ""), ("r3", "  x y.txt  \nx y.txt\n")]

_ALL = {k: True for k in DEFAULTS if k.startswith("has_")}
SCORES: list[dict] = [
    {"repo_id": "blank"},
    {"repo_id": "clean", "total_files": 40, "total_lines": 4000, "total_bytes": 140_000, "test_files": 25, "source_files": 30, "docker_useful": True, "build_has_standard": True, "readme_bytes": 2000, "readme_has_setup": True, "lockfile_fresh": True, "total_tokens": 40_000, "avg_file_lines": 100, **_ALL},
    {"repo_id": "heavy", "total_files": 900, "total_lines": 400_000, "total_bytes": 14_000_000, "max_depth": 9, "top_level_dirs": 12, "complex_large": 9, "layer_violations": 3, "god_modules": 1, "dup_count": 25, "coll_count": 40, "avg_fan_out": 16.5, "max_fan_out": 50, "max_fan_out_name": "src/hub.py",
     "cycle_count": 7, "largest_cycle": 4, "dominant_ratio": 0.4, "source_files": 800, "test_files": 10, "global_mutables": 30, "side_effects": 9, "hazards": 12, "anti_patterns": 300, "build_seconds": 200.0, "total_tokens": 4_000_000, "max_function_lines": 400, "max_nesting": 9, "hot_complex": 4,
     "avg_complexity": 12.0, "cluster_count": 120, "unreferenced_functions": 30, "unreferenced_lines": 900, "avg_file_lines": 444, "main_chars_per_token": 3.2, "generic_count": 4},
    {"repo_id": "active", "total_files": 100, "total_lines": 30_000, "total_bytes": 2_000_000, "is_git": True, "active_files": 70, "active_bytes": 700_000, "frozen_files": 30, "window_label": "3 weeks", "test_files": 15, "source_files": 85, "has_Formatter": True, "has_CI": True, "has_Readme": True, "readme_bytes": 300,
     "dominant_ratio": 0.7, "avg_fan_out": 9.0, "max_fan_out": 40, "max_fan_out_name": "src/App.tsx", "cycle_count": 1, "largest_cycle": 2, "dup_count": 7, "coll_count": 3, "global_mutables": 5, "hazards": 4, "build_seconds": 6.0, "total_tokens": 600_000, "max_function_lines": 150, "max_nesting": 5, "avg_complexity": 6.0, "cluster_count": 3, "avg_file_lines": 300, "hot_names": "a.py, b.py"},
    {"repo_id": "edges", "total_files": 500, "total_lines": 50_000, "total_bytes": 616_000, "max_depth": 5, "complex_large": 3, "dup_count": 10, "coll_count": 15, "avg_fan_out": 8.0, "max_fan_out": 30, "dominant_ratio": 0.6, "source_files": 10, "test_files": 5, "global_mutables": 20, "side_effects": 5, "hazards": 3,
     "build_seconds": 5.0, "total_tokens": 100_000, "max_function_lines": 100, "max_nesting": 8, "hot_complex": 3, "anti_patterns": 10, "avg_file_lines": 50},
]


#: Texts whose parts a plain search takes for code, or misses.
TRICKY = [
    ("r3", "t/loop.c", "int walk(int n) {\n  for (int i = 0; i < n; i++) {\n    if (i) {\n      n--;\n    }\n  }\n  return n;\n}\n"),
    ("r3", "t/doc.py", "\"\"\"\nimport os first\n\"\"\"\nimport json; import re\nimport numpy as np\nfrom . import near\nfrom __future__ import annotations\n\ndef pick(y, z, w):\n    return [x for x in y if x] if z else w\n"),
    ("r3", "t/note.js", "// import a from 'none'\n/* import b from 'none' */\nimport c from 'real'; import {\n  d } from 'other'\nimport('late');\nfunction sign(x) { return /[{]/.test(x); }\nfunction join(x, y) { return `${x && y} }`; }\n"),
    ("r3", "t/Chain.java", "class Chain {\n  int go(int a) {\n    if (a == 1) { return 1; }\n    else if (a == 2) { return 2; }\n    else { while (a > 3) { a--; } }\n    return a;\n  }\n}\n"),
    ("r3", "t/call.ts", "function outer(a: number[]) {\n  if (a.some(function (x) { if (x) { return true; } return false; })) {\n    for (;;) {}\n  }\n}\n"),
]

#: By path, what the tree's node kinds give: (name, start_line, line_count, complexity, nesting), (module_path, line), (kind, line).
FUNCTIONS = {
    "src/engine.py": [("getData", 8, 7, 2, 1)], "src/helpers.py": [("calculate_total", 3, 6, 3, 2), ("get_instance", 14, 2, 1, 0)], "tests/test_engine.py": [("test_it", 4, 2, 1, 0)],
    "web/app.js": [("loadAll", 3, 5, 3, 1), ("<anonymous>", 8, 1, 1, 0)], "web/server.js": [("<anonymous>", 2, 1, 1, 0), ("getInstance", 3, 1, 1, 0)], "lib/core.rs": [("narrow_path", 5, 6, 3, 1)],
    "lib/run.go": [("Run", 8, 6, 2, 1)], "lib/Main.java": [("weigh", 4, 4, 2, 1)], "lib/tool.c": [("main", 3, 4, 2, 1)], "lib/job.rb": [("perform", 3, 5, 2, 1)], "lib/page.php": [("show", 3, 1, 3, 2)],
    "lib/form.tsx": [("<anonymous>", 2, 1, 2, 0)], "t/loop.c": [("walk", 1, 8, 3, 2)], "t/doc.py": [("pick", 9, 2, 2, 0)], "t/note.js": [("sign", 6, 1, 1, 0), ("join", 7, 1, 2, 0)],
    "t/Chain.java": [("go", 2, 6, 4, 3)], "t/call.ts": [("outer", 1, 5, 4, 2), ("<anonymous>", 2, 1, 2, 1)],
}
IMPORTS = {
    "src/engine.py": [("os", 1), ("helpers", 2)], "src/helpers.py": [("os", 1)], "tests/test_engine.py": [("engine", 1)], "web/app.js": [("./engine", 1)], "lib/core.rs": [("std::fmt", 1)],
    "lib/run.go": [("fmt", 4), ("os", 5)], "lib/Main.java": [("java.util.List", 1)], "lib/tool.c": [("stdio.h", 1)], "lib/job.rb": [("require 'json'", 1)], "lib/page.php": [("App\\Model", 2)],
    "lib/form.tsx": [("react", 1)], "t/doc.py": [("json", 4), ("re", 4), (".", 6)], "t/note.js": [("real", 3), ("other", 3)],
}
HAZARDS = {
    "src/helpers.py": [("SingletonPattern", 10), ("MutableClassVariable", 12), ("ModuleLevelCall", 17)], "web/app.js": [("GlobalEventListener", 8)], "web/server.js": [("ModuleLevelCall", 2), ("SingletonPattern", 3)],
}
#: Names of the last parts of paths that stand for the kinds of events.
EVENT_FILES = ["package-lock.json", "package.json", "yarn.lock", "src/x.py", "go.mod"]

_RANGES = {
    "total_files": 1200, "total_lines": 400_000, "total_bytes": 9_000_000, "max_file_lines": 5000, "avg_file_lines": 500, "test_files": 300, "large_files": 60, "max_depth": 14, "top_level_dirs": 14, "readme_bytes": 90_000,
    "active_files": 1100, "active_lines": 90_000, "active_bytes": 3_000_000, "frozen_files": 300, "max_function_lines": 450, "max_nesting": 12, "hot_complex": 8, "functions": 3000, "hazards": 20, "cycle_count": 9, "largest_cycle": 7,
    "god_modules": 3, "layer_violations": 4, "complex_large": 9,
}


def score_expressions() -> dict[str, str]:
    """A wide row of made-up figures for each customer, as SQL that both engines read; none falls on a tie of rounding."""
    out = {}
    for i, (name, value) in enumerate(DEFAULTS.items()):
        k = f"(CAST(c_custkey AS BIGINT) * {2 * i + 37})"
        if isinstance(value, bool):
            e = f"{k} % 3 = 0"
        elif name in ("source_files", "total_files"):
            e = f"2 * ({k} % {450 if name == 'source_files' else 600}) + 1"
        elif name == "total_tokens":
            e = f"2 * ({k} % 700001) + 1"
        elif isinstance(value, int):
            e = f"{k} % {_RANGES.get(name, 40)}"
        elif name == "main_chars_per_token":
            e = "CAST(3.5 AS DOUBLE)"
        elif name == "dominant_ratio":
            e = f"CAST({k} % 101 AS DOUBLE) / CAST(100 AS DOUBLE)"
        elif name == "build_seconds":
            e = f"CAST({k} % 199 AS DOUBLE) + CAST(0.3 AS DOUBLE)"
        elif isinstance(value, float):
            e = f"CAST({k} % 250 AS DOUBLE) / CAST(10 AS DOUBLE)"
        else:
            e = f"CASE WHEN {k} % 4 = 0 THEN '' ELSE concat('src/m', CAST({k} % 9 AS VARCHAR(9)), '.py') END"
        out[name] = e
    return out


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list) -> str:
    """A common table expression with these rows."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


def score_rows() -> list[tuple]:
    return [tuple([s["repo_id"], *[s.get(k, v) for k, v in DEFAULTS.items()]]) for s in SCORES]


def numbered(name: str, columns: str, rows: list) -> str:
    """A common table expression with these rows and their number k."""
    return values(name, "k, " + columns, [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)])


def score_values() -> str:
    own = ", ".join(f"{e} AS {c}" for c, e in score_expressions().items())
    return values("w0", ", ".join(["repo_id", *DEFAULTS]), score_rows()) + f", w AS (SELECT * FROM w0 UNION ALL SELECT concat('customer', CAST(c_custkey AS VARCHAR)) AS repo_id, {own} FROM customer)"


def table(spark: SparkSession, schema: str, rows: list) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def by_document(spark: SparkSession, documents: DataFrame, schema: str, rows: list) -> DataFrame:
    """``documents``, each with one of the ``rows`` in turn."""
    full = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return documents.withColumn("k", (F.col("doc_id") % len(rows)).cast("int")).join(F.broadcast(spark.createDataFrame(full, "k int, " + schema)), "k")


def by_nation(spark: SparkSession, nation: DataFrame, schema: str, rows: list) -> DataFrame:
    """All ``rows`` for each nation, which comes first in repo_id."""
    every = nation.select("n_name", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("k"))
    full = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return every.join(F.broadcast(spark.createDataFrame(full, "k int, " + schema)), "k").withColumn("repo_id", F.concat("n_name", F.lit("/"), "repo_id")).drop("k", "n_name")


def score_table(spark: SparkSession, customer: DataFrame) -> DataFrame:
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    own = spark.createDataFrame(score_rows(), "repo_id string, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in DEFAULTS.items()))
    more = customer.select(F.concat(F.lit("customer"), F.col("c_custkey").cast("string")).alias("repo_id"), *[F.expr(e).cast(kinds[type(DEFAULTS[c])]).alias(c) for c, e in score_expressions().items()])
    return own.unionByName(more)
