"""Command line: doctor, index, analyze and benchmark."""

from __future__ import annotations

import argparse
import json
import os
import sys
import traceback

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ripplet.plans import analysis as plan
from ripplet.plans.benchmark import Case, report_markdown, run_benchmark, write_report
from ripplet.session import SETTINGS
from ripplet.sources.git import commit_of
from ripplet.sources.store import GraphStore, save_cache


def _session() -> SparkSession:
    """The session that spark-submit configured, or a local one."""
    builder = SparkSession.builder.appName("ripplet")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ripplet", description=__doc__)
    parser.add_argument("command", choices=["doctor", "index", "analyze", "benchmark"])
    parser.add_argument("repository", nargs="?", default=".")
    parser.add_argument("--task", default=None)
    parser.add_argument("--base", default=None)
    parser.add_argument("--head", default=None)
    parser.add_argument("--budget", type=int, default=4000)
    parser.add_argument("--depth", type=int, default=3)
    parser.add_argument("--cases", help="JSON list of {id, task, k, gold} for the benchmark")
    parser.add_argument("--store", help="folder of the graph tables")
    parser.add_argument("--artifacts", default=os.path.join("generated", "latest"))
    parser.add_argument("--show", type=int, default=12, help="how many recommendations to print")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--verbose", action="store_true")
    return parser


def doctor(spark: SparkSession, repository: str, store: str | None) -> list[dict]:
    checks = [
        {"check": "Spark", "ok": spark.range(1).count() == 1, "detail": spark.version},
        {"check": "Repository folder", "ok": os.path.isdir(repository), "detail": os.path.realpath(repository)},
        {"check": "Git commit", "ok": commit_of(repository) != "uncommitted", "detail": commit_of(repository)},
    ]
    if store:
        n = GraphStore(spark, store).read().nodes.filter("label = 'Repository'").count()
        checks.append({"check": "Graph tables", "ok": True, "detail": f"{n} repositories"})
    return checks


def run(argv: list[str]) -> int:
    args = _parser().parse_args(argv)
    spark = _session()
    store = GraphStore(spark, args.store) if args.store else None
    if args.command == "doctor":
        checks = doctor(spark, args.repository, args.store)
        if args.json:
            print(json.dumps({"ok": all(c["ok"] for c in checks), "checks": checks}, indent=2))
        else:
            for c in checks:
                print(f"{'PASS' if c['ok'] else 'FAIL'}  {c['check']:<24} {c['detail']}")
        return 0 if all(c["ok"] for c in checks) else 1
    if args.command == "index":
        repo = plan.index_repository(spark, args.repository)
        receipt = store.synchronize(repo.index.graph) if store else None
        # Spark would resolve a relative folder against the JVM's start folder.
        save_cache(repo.index.graph, os.path.abspath(os.path.join(".ripplet", "cache", repo.root_hash)))
        out = {
            "repository": repo.root, "commit": repo.commit, "warnings": repo.warnings,
            "diagnostics": repo.index.diagnostics.head().asDict(),
            "synchronization": [r.asDict() for r in receipt.collect()] if receipt is not None else None,
        }
        print(json.dumps(out, indent=2))
        return 0
    if args.command == "benchmark":
        if not args.cases:
            raise ValueError("The benchmark needs --cases.")
        with open(args.cases, encoding="utf-8") as handle:
            cases = [Case(c["id"], c["task"], c["k"], tuple(c["gold"])) for c in json.load(handle)]
        repo = plan.index_repository(spark, args.repository)
        report = run_benchmark(spark, repo.index.graph, repo.sources, cases)
        write_report(report, os.path.join("generated", "benchmark"))
        print(report_markdown(report))
        return 0
    result = plan.run_analysis(
        spark, args.repository, args.task or "", args.base, args.head, args.budget, args.depth,
        bool(args.base or args.head or not args.task), store, args.artifacts)
    if args.json:
        print(json.dumps(plan.agent_context(result), indent=2, default=str))
        return 0
    s = result.summary()
    print(f"Analyzed {result.repository.root}")
    print(f"Seeds: {s['seeds']} · Recommendations: {s['recommendations']} · High risk: {s['high_risk']}")
    print(f"Graph: {s['nodes']} nodes / {s['edges']} edges · Context: {s['estimated_tokens']}/{args.budget} estimated tokens")
    for r in result.impact.recommendations.filter(F.col("position") <= args.show).orderBy("position").collect():
        where = f":{r.start_line} {r.symbol}" if r.symbol else ""
        print(f"{r.risk:<6} {r.score:.3f}  {r.path}{where}\n       {r.evidence_text}")
    print(f"Artifacts: {args.artifacts}")
    return 0


def main() -> None:
    try:
        sys.exit(run(sys.argv[1:]))
    except Exception as error:  # noqa: BLE001
        if "--verbose" in sys.argv:
            traceback.print_exc()
        else:
            print(error, file=sys.stderr)
        sys.exit(1)


if __name__ == "__main__":
    main()
