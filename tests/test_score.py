import json
from pathlib import Path

from helpers import finding, findings_df

from rulelens.operators.match import applicable_rules
from rulelens.operators.score import (
    counts_by_level,
    rule_coverage,
    run_meta,
    score,
    score_by,
    score_rollup,
    summary,
)
from rulelens.plans.storage import run_dir
from rulelens.sinks import findings_document, findings_jsonl, write_documents, write_jsonl
from rulelens.sources.rules import Rule, rules_df


def of_levels(spark, levels, path="p"):
    return findings_df(spark, [finding(level=lv, path=path, line=i) for i, lv in enumerate(levels)])


def test_penalties(spark):
    for levels, wanted in [
        (["blocker"], 75), (["critical"], 85), (["major"], 92), (["minor"], 97), (["info"], 100), ([], 100),
        (["major", "major", "minor"], 81), (["blocker"] * 10, 0), (["odd"], 100),
    ]:
        assert score(of_levels(spark, levels)).first()["score"] == wanted, levels


def test_summary_and_counts(spark):
    df = of_levels(spark, ["major", "info", "major"])
    assert {r["level"]: r["findings"] for r in counts_by_level(df).collect()} == {"major": 2, "info": 1}
    assert summary(df).first().asDict() == {"score": 84, "max_score": 100, "total_issues": 3, "counts": {"info": 1, "major": 2}}
    assert summary(df.limit(0)).first().asDict() == {"score": 100, "max_score": 100, "total_issues": 0, "counts": {}}


def test_scores_by_key_cover_rows_without_findings(spark, corpus):
    found = of_levels(spark, ["major"], "a/1").union(of_levels(spark, ["minor"], "b/2")).union(of_levels(spark, ["info"], "lost"))
    rows = corpus([("a/1", ""), ("a/2", ""), ("b/2", "")])
    got = {r["path"]: (r["score"], r["findings"]) for r in score_by(found, rows, ["path"]).collect()}
    assert got == {"a/1": (92, 1), "a/2": (100, 0), "b/2": (97, 1)}
    keys = [("top", "split_part(path, '/', 1)"), "path"]
    rolled = {(r["top"], r["path"]): r["score"] for r in score_rollup(found.filter("path <> 'lost'"), rows, keys).collect()}
    assert rolled[(None, None)] == 89 and rolled[("a", None)] == 92 and rolled[("a", "a/2")] == 100


def test_run_meta(spark):
    rows = spark.createDataFrame([("skip",), ("cached",), ("analyze",), ("analyze",)], "status string")
    calls = spark.createDataFrame([(0.5,)], "cost_usd double")
    assert run_meta(rows, calls).first().asDict() == {
        "files_analyzed": 4, "skipped": 1, "cache_hits": 1, "llm_calls": 1, "deferred": 1, "cost_usd": 0.5,
    }
    assert set(run_meta(rows.limit(0)).first()) == {0, 0.0}


def test_coverage(spark, corpus):
    rules = [Rule("a/x", "X", pack="a", code_patterns=("x",)), Rule("a/y", "Y", pack="a", code_patterns=("y",)), Rule("b/z", "Z", pack="b")]
    rows = corpus([("p", "x"), ("q", "xy")])
    found = findings_df(spark, [finding(path="p"), finding(path="p", line=2), finding(path="q")])
    got = {(r["pack"], r["rule_id"]): tuple(r)[2:] for r in rule_coverage(applicable_rules(rows, rules), found, rules_df(spark, rules)).collect()}
    assert got[("a", "a/x")] == (1, 2, 3, 2, 0) and got[("a", "a/y")] == (1, 1, 0, 0, 1) and got[("b", "b/z")] == (1, 2, 0, 0, 1)
    assert got[("a", None)] == (2, 3, 3, 2, 1) and got[(None, None)] == (3, 5, 3, 2, 2)


def test_documents_and_lines(spark):
    df = of_levels(spark, ["info", "blocker"]).union(of_levels(spark, ["minor"], "q"))
    docs = {r["path"]: json.loads(r["document"]) for r in findings_document(df, {"run": 1}).collect()}
    assert [i["level"] for i in docs["p"]["issues"]] == ["blocker", "info"]
    assert docs["p"]["summary"] == {"score": 75, "total_issues": 2, "counts": {"blocker": 1, "info": 1}}
    assert docs["p"]["meta"] == {"run": "1"} and docs["q"]["issues"][0]["snippet"] is None
    assert set(docs["p"]["issues"][0]["location"]) == {"path", "start_line", "end_line", "start_col", "end_col"}
    lines = findings_jsonl(df, summary(df))
    folder = run_dir(spark, "jsonl")
    write_jsonl(lines, folder)
    parts = sorted(Path(folder.removeprefix("file:")).glob("part-*"))
    texts = [json.loads(line) for part in parts for line in part.read_text().splitlines()]
    assert texts[0] == {"type": "summary", "score": 72, "issues_count": 3}
    assert len(texts) == 4 and {t["type"] for t in texts[1:]} == {"issue"}
    assert findings_jsonl(df.limit(0), summary(df.limit(0))).count() == 1
    folder = run_dir(spark, "documents")
    write_documents(findings_document(df), folder)
    assert spark.read.text(folder).count() == 2
