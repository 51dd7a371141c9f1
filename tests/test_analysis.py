import json
import os
import subprocess

import pytest

from ripplet import cli
from ripplet.plans import analysis as plan
from ripplet.plans.benchmark import Case, report_markdown, run_benchmark, write_report
from ripplet.sources import discovery, git
from ripplet.sources.store import GraphStore
from tests.library import FILES


def run_git(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def checkout(tmp_path_factory):
    root = tmp_path_factory.mktemp("checkout")
    for path, text in {**FILES, "tsconfig.json": "{}", "node_modules/x/a.ts": "export const no = 1;",
                       "README.md": "#", "big.js": "/" * 2_000_001}.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    outside = tmp_path_factory.mktemp("outside")
    (outside / "secret.ts").write_text("export const secret = 1;")
    os.symlink(outside, root / "linked")
    run_git(root, "init", "-q")
    run_git(root, "add", ".")
    run_git(root, "commit", "-qm", "one")
    return root


def test_discovery(spark, checkout):
    found = discovery.discover(spark, [str(checkout)])
    assert {r.path for r in found.filter("kept").collect()} == set(FILES)
    # .git, node_modules, linked, README.md, tsconfig.json and big.js.
    assert discovery.excluded_count(found) == 6
    read = {r.path: r.content for r in discovery.read_files(found).collect()}
    assert read == FILES


def test_paths_cannot_escape(checkout):
    discovery.assert_inside(str(checkout), str(checkout / "src"))
    with pytest.raises(ValueError, match="Outside of"):
        discovery.assert_inside(str(checkout), str(checkout / ".." / "other"))


def test_missing_project_file(tmp_path, checkout):
    assert discovery.project_warnings(str(checkout)) == [] and "tsconfig" in discovery.project_warnings(str(tmp_path))[0]


def test_git_modes(checkout, tmp_path):
    assert len(git.commit_of(str(checkout))) == 40 and git.commit_of(str(tmp_path)) == "uncommitted"
    # A clean tree whose only commit has no parent gives no diff.
    assert git.read_diff(str(checkout)) == git.GitDiff("", "HEAD", "HEAD")
    with pytest.raises(ValueError):
        git.read_diff(str(checkout), "--output=x")
    target = checkout / "src" / "log.ts"
    try:
        target.write_text(FILES["src/log.ts"].replace("entries.length = 0", "entries.splice(0)"))
        dirty = git.read_diff(str(checkout))
        assert (dirty.base_ref, dirty.head_ref) == ("HEAD", "worktree") and "+++ b/src/log.ts" in dirty.raw
        assert git.read_diff(str(checkout), "HEAD").raw == dirty.raw
    finally:
        target.write_text(FILES["src/log.ts"])


def test_task_analysis_end_to_end(spark, checkout, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    out = plan.run_analysis(spark, str(checkout), "Change loanLength for callers", store=store, budget=2000,
                            artifacts=str(tmp_path / "out"))
    rows = {r.symbol or r.path: r for r in out.impact.recommendations.collect()}
    assert rows["loanLength"].is_seed and rows["loanLength"].risk == "High" and rows["loanLength"].found_by_baseline
    # The alias leads from the seed to its caller, and on to the caller's caller.
    assert rows["lend"].evidence_text == "loanLength <-CALLS- lend" and rows["lend"].hops == 1
    assert rows["Desk.checkout"].evidence_text == "loanLength <-CALLS- lend <-CALLS- Desk.checkout"
    assert not any(r.path == "src/settings.ts" for r in rows.values())
    assert out.pack["estimated_tokens"] <= 2000 and out.pack["items"]
    body = json.loads((tmp_path / "out" / "analysis.json").read_text())
    assert body["analysis"]["graph_counts"]["nodes"]["File"] == len(FILES)
    assert "index" not in body and body["diff"] is None and not body["analysis"]["low_confidence"]
    assert (tmp_path / "out" / "context-pack.md").read_text() == out.pack["markdown"]
    assert store.read().nodes.count() == body["synchronization"][0]["node_count"]


def test_diff_analysis(spark, checkout):
    target = checkout / "src" / "log.ts"
    try:
        target.write_text(FILES["src/log.ts"].replace("entries.push(text)", "entries.unshift(text)"))
        os.remove(checkout / "src" / "settings.ts")
        out = plan.run_analysis(spark, str(checkout), include_diff=True, budget=1500)
        seeds = {s["qualified_name"] or s["path"]: s for s in out.pack["seeds"]}
        assert seeds["record"]["confidence"] == 1.0 and seeds["src/settings.ts"]["confidence"] == 0.75
        rows = {r.symbol or r.path: r for r in out.impact.recommendations.collect()}
        assert rows["lend"].evidence_text == "record <-CALLS- lend"
        assert out.pack["hunks_included"] == out.pack["hunks_total"] == 2
        assert "diff HEAD..worktree of 2 files" in out.pack["markdown"]
        assert any(o["path"] == "src/settings.ts" and "No text" in o["omitted_reason"] for o in out.pack["omitted"])
        agent = plan.agent_context(out)
        assert agent["diff"]["total_files"] == 2 and not agent["diff"]["truncated"]
        assert agent["analysis"]["graph_counts"]["edges"]["TOUCHES"] == 2
    finally:
        target.write_text(FILES["src/log.ts"])
        (checkout / "src" / "settings.ts").write_text(FILES["src/settings.ts"])


def test_symbol_tool_and_limits(spark, checkout):
    out = plan.explain_symbol_impact(spark, str(checkout), "StandardRule", 1000, 1)
    # The quoted symbol and its own members all score one; the symbol itself is a direct seed.
    rows = {r["symbol"]: r for r in out["analysis"]["recommendations"]}
    assert rows["StandardRule"]["reason"].startswith("Part of the change") and out["analysis"]["depth"] == 1
    with pytest.raises(ValueError, match="Nothing to start from"):
        plan.get_change_context(spark, str(checkout), "zzz qqq")
    for bad in (dict(task=""), dict(task="x", token_budget=10), dict(task="x", maximum_depth=4)):
        with pytest.raises(ValueError):
            plan.get_change_context(spark, str(checkout), **bad)
    assert plan.check_web_request("Change it", 2000, 3, "lib", {"lib": "/x"}) == "/x"
    for bad in (("ab", 2000, 3, "lib"), ("abc", 1999, 3, "lib"), ("abc", 2000, 0, "lib"), ("abc", 2000, 1, "../etc")):
        with pytest.raises(ValueError):
            plan.check_web_request(*bad, {"lib": "/x"})


def test_benchmark(spark, library, tmp_path):
    index, sources = library
    cases = [
        Case("length", "Change loanLength rounding", 6, ("src/rules/standard.ts", "src/lend.ts", "src/desk.ts")),
        Case("settings", "Locate settings maximumLoans", 3, ("src/settings.ts",)),
    ]
    report = run_benchmark(spark, index.graph, sources, cases)
    rows = {r.case_id: r for r in report.cases.collect()}
    assert rows["length"].lexical_recall == 0.333 and rows["length"].graph_recall == 1.0
    assert rows["settings"].graph_recall == 1.0 and rows["length"].graph_tokens <= 2000
    write_report(report, str(tmp_path))
    assert "length: first 6 files; recall 1.000 by graph, 0.333 by words" in report_markdown(report)
    assert json.loads((tmp_path / "report.json").read_text())["summary"]["cases"] == 2


def test_command_line(spark, checkout, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.run(["doctor", str(checkout), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["ok"]
    assert cli.run(["index", str(checkout), "--store", str(tmp_path / "s")]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert len(list((tmp_path / ".ripplet" / "cache").iterdir())) == 1
    assert shown["diagnostics"]["files_scanned"] == len(FILES) and shown["synchronization"][0]["synchronized"]
    assert cli.run(["analyze", str(checkout), "--task", "Change loanLength", "--budget", "1000"]) == 0
    assert "loanLength <-CALLS- lend" in capsys.readouterr().out
    assert (tmp_path / "generated" / "latest" / "context-pack.md").exists()
