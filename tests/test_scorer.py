import json

from pyspark.sql import functions as F

from rulelens.operators.scorer import (
    build_prompt,
    canned_scorer,
    parse_responses,
    prompt_stats,
    python_scorer,
    score_with,
    validate_findings,
    with_prompt,
)
from rulelens.sources.rules import Rule


def issue(**changes):
    given = {"rule_id": "a/x", "level": "major", "location": {"start_line": 3, "end_line": 4}, "title": "t", "why": "w", "do": ["d"]}
    given.update(changes)
    return {k: v for k, v in given.items() if v is not ...}


def answers(spark, cases):
    rows = [(k, v if isinstance(v, str) or v is None else json.dumps({"issues": v})) for k, v in cases.items()]
    return spark.createDataFrame(rows, "path string, response_json string")


def test_answers_are_checked_whole(spark):
    cases = {
        "good": [issue()],
        "80": [issue(title="x" * 80)],
        "81": [issue(), issue(title="x" * 81)],
        "low": [issue(confidence=-0.1)],
        "high": [issue(confidence=1.2)],
        "edge": [issue(confidence=0), issue(confidence=1.0)],
        "no why": [issue(why=...)],
        "no line": [issue(location={})],
        "no place": [issue(location=...)],
        "no issues": "{}",
        "empty": [],
        "broken": '{"issues":[{',
        "not json": "sorry",
        "null": None,
        "wrong type": '{"issues":[{"rule_id":{"a":1}}]}',
        "list": "[]",
        "null issues": '{"issues":null}',
        "number": [issue(), issue(title=5)],
        "null confidence": [issue(confidence=None)],
        "null tag": [issue(tags=[None])],
        "null item": [issue(do=["a", None])],
        "text list": [issue(do="a")],
        "number list": [issue(do=[1])],
        "no end": [issue(location={"start_line": 1, "end_line": None})],
        "level": [issue(level="fatal"), issue(level="info"), issue(level="MAJOR")],
    }
    good, bad = validate_findings(answers(spark, cases))
    kept = sorted((r["path"], r["ordinal"]) for r in good.collect())
    assert kept == [("80", 0), ("edge", 0), ("edge", 1), ("good", 0), ("level", 1), ("no end", 0)]
    reasons = {(r["path"], r["ordinal"]): r["reject_reason"] for r in bad.collect()}
    assert reasons == {
        ("81", None): "title_too_long", ("low", None): "confidence_range", ("high", None): "confidence_range",
        ("no why", None): "missing_field", ("no line", None): "missing_field", ("no place", None): "missing_field",
        ("broken", None): "malformed", ("not json", None): "malformed", ("null", None): "malformed",
        ("wrong type", None): "wrong_type", ("list", None): "malformed", ("null issues", None): "wrong_type",
        ("number", None): "wrong_type", ("null confidence", None): "wrong_type", ("null tag", None): "wrong_type",
        ("null item", None): "wrong_type", ("text list", None): "malformed", ("number list", None): "wrong_type",
        ("level", 0): "unknown_level", ("level", 2): "unknown_level",
    }


def test_defaults_of_optional_fields(spark):
    row = parse_responses(answers(spark, {"p": [issue(location={"start_line": 1})]})).first()
    assert (row["confidence"], row["tags"], row["end_line"], row["do"]) == (0.9, [], None, ["d"])


RULES = [Rule("b/two", "Two", "minor", description="d" * 150), Rule("a/one", "One", "blocker", description="short")]


def test_prompt(spark):
    df = spark.createDataFrame([("p", "é" * 10_001, ["a/one", "b/two"]), ("q", "x", [])], "path string, content string, rule_ids array<string>")
    prompt = {r["path"]: r["prompt"] for r in with_prompt(df, RULES).collect()}
    assert '"rule": "a/one"' in prompt["p"] and "d" * 150 in prompt["p"]
    assert "é" * 10_001 in prompt["p"] and "Path: p\n" in prompt["p"]
    short = {r["path"]: r["prompt"] for r in with_prompt(df, RULES, max_chars=10).collect()}
    assert "é" * 10 in short["p"] and "é" * 11 not in short["p"]
    assert "Spanish" in df.select(build_prompt(F.col("path"), F.col("content"), F.col("rule_ids"), RULES, "Spanish")).first()[0]
    stats = {r["path"]: r for r in prompt_stats(with_prompt(df, RULES), 10).collect()}
    assert not prompt_stats(with_prompt(df, RULES)).filter("truncated").count()
    assert stats["p"]["truncated"] and not stats["q"]["truncated"] and stats["p"]["rules"] == 2
    assert stats["p"]["prompt_chars"] == len(prompt["p"]) and stats["q"]["prompt_tokens"] == len(prompt["q"]) // 4


def test_canned_answers_take_the_first_key(spark):
    df = spark.createDataFrame([("ab",), ("b",), ("c",)], "prompt string")
    got = score_with(df, canned_scorer({"a": "A", "b": "B"})).select("prompt", "answer.response_json", "answer.error").collect()
    assert {r["prompt"]: r["response_json"] for r in got} == {"ab": "A", "b": "B", "c": '{"issues":[]}'}


def test_python_scorer_quarantines_a_failing_batch(spark):
    def answer(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("no answer")
        return ["{}" for _ in prompts]

    df = spark.createDataFrame([("fine",), ("boom",), ("good",)], "path string").coalesce(1).withColumn("prompt", F.col("path"))
    rows = score_with(df, python_scorer(answer, batch_size=1)).select("path", "answer.*").collect()
    got = {r["path"]: (r["response_json"], r["error"]) for r in rows}
    assert got["fine"] == got["good"] == ("{}", None) and got["boom"][0] is None and "no answer" in got["boom"][1]
    whole = score_with(df, python_scorer(answer)).select("answer.error").collect()
    assert all("no answer" in r["error"] for r in whole)
    short = score_with(df, python_scorer(lambda prompts: [])).select("answer.error").first()
    assert "one answer per prompt" in short["error"]
    flat = spark.createDataFrame([("x", None, "E")], "path string, response_json string, error string")
    assert validate_findings(flat, "response_json", "error")[1].first()["reject_reason"] == "call_failed"
