"""Command line: ``python -m gritmeter.cli PATH...``"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api
from .plans import report


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gritmeter")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("--format", choices=("terminal", "json", "llm"), default="terminal")
    p.add_argument("--ci", action="store_true")
    p.add_argument("--max-score", type=int)
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--context-budget", action="store_true")
    p.add_argument("--no-git", action="store_true")
    p.add_argument("--git-months", type=int, default=1)
    o = p.parse_args(argv)
    spark = SparkSession.builder.appName("gritmeter").getOrCreate()
    s = api.scan(spark, {path: path for path in o.paths}, o.ignore, not o.no_git, o.git_months)
    a = api.analyze(s)
    worst = 0
    for row in report.report_json(s, a, api.score(a), api.recommend(s, a)).orderBy("repo_id").toLocalIterator():
        got = json.loads(row["report"])
        worst = max(worst, got["friction_index"])
        text = json.dumps(got, indent=2) if o.format == "json" else report.instructions(got) if o.format == "llm" else report.terminal(got, o.verbose, o.context_budget)
        print(text)
    return report.exit_code(worst, o.max_score, o.ci)


if __name__ == "__main__":
    sys.exit(main())
