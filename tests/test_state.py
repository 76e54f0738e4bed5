import time
from pathlib import Path

from pyspark.sql import Row
from test_review import RULES

from rulelens.plans.storage import run_dir
from rulelens.streaming.state import KeyedReview, findings_of_outcomes, keyed_state, review_outcomes
from rulelens.streaming.streams import read_stream, write_available

ANSWER = '{"issues":[{"rule_id":"a/x","level":"major","location":{"start_line":1},"title":"t","why":"w","do":["d"]}]}'


def scorer(log, fails):
    """Answers every prompt, notes each call in a file, and fails as long as `fails` is there."""

    def answer(prompts):
        with open(log, "a") as lines:
            lines.writelines("call\n" for _ in prompts)
        if Path(fails).exists():
            raise OSError("down")
        return [ANSWER for _ in prompts]

    return answer


def test_batches_failures_and_replays(spark, corpus, tmp_path):
    home, log, fails = run_dir(spark, "state"), tmp_path / "calls", tmp_path / "down"
    log.touch()

    def arrive(rows, **given):
        if rows:
            corpus(rows).coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = read_stream(spark, f"{home}/in", "path string, content string")
        with keyed_state(spark):
            outcomes = review_outcomes(stream, RULES, scorer(str(log), str(fails)), retry_seconds=0, **given)
            write_available(outcomes, f"{home}/out", f"{home}/ck")
        return log.read_text().count("call")

    def rows():
        return sorted((str(r["path"]), r["status"]) for r in spark.read.parquet(f"{home}/out").collect())

    first = [("p.py", "TODO one"), ("p.py", "TODO two"), ("q.py", "TODO one"), (None, "TODO null")]
    assert arrive(first) == 3
    assert rows() == [("None", "scored"), ("p.py", "scored"), ("p.py", "scored"), ("q.py", "cached")] or ("q.py", "scored") in rows()
    before = rows()
    assert arrive([]) == log.read_text().count("call") and rows() == before
    calls = arrive([("late.py", "TODO one"), ("r.py", "TODO one")])
    assert {("late.py", "cached"), ("r.py", "cached")} <= set(rows())
    fails.touch()
    calls = arrive([("s.py", "TODO three")])
    assert ("s.py", "waiting") in rows() and ("s.py", "scored") not in rows()
    fails.unlink()
    time.sleep(1)
    assert arrive([("t.py", "TODO one")]) == calls + 1
    assert ("s.py", "scored") in rows() and ("t.py", "cached") in rows()
    found = findings_of_outcomes(spark.read.parquet(f"{home}/out"), "p")
    assert {r["path"] for r in found.collect()} >= {"p.py", "q.py", "s.py", "t.py"}


def test_calls_are_bounded_and_no_row_is_lost(spark, corpus, tmp_path):
    home, log = run_dir(spark, "state"), tmp_path / "calls"
    log.touch()
    for step in range(8):
        corpus([(f"{step}-{i}.py", f"TODO {step} {i}") for i in range(3 if step == 0 else 1)]).coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = read_stream(spark, f"{home}/in", "path string, content string")
        with keyed_state(spark):
            outcomes = review_outcomes(stream, RULES, scorer(str(log), str(tmp_path / "no")), retry_seconds=0, calls_per_task=1)
            write_available(outcomes, f"{home}/out", f"{home}/ck")
        out = spark.read.parquet(f"{home}/out").filter("status = 'scored'").select("path")
        if step and out.count() == 3 + step:
            break
    assert out.distinct().count() == out.count() == 3 + step


class _Kept:
    """A state variable that counts how often it is asked."""

    def __init__(self, value, asked):
        self.value, self.asked = value, asked

    def __getattr__(self, name):
        self.asked.append(name)
        return lambda *given: self.value


def test_a_key_asks_its_state_once_for_each_variable():
    asked = []
    review = KeyedReview(lambda prompts: ["{}"], 1, 1, None)
    review.calls, review.verdict, review.waiting = 0, _Kept(None, asked), _Kept((), asked)
    rows = [Row(path=path, prompt="p") for path in "ab"]
    got = [(r["path"], r["status"]) for r in review.handleInputRows(("f", "r"), iter(rows), None)]
    assert got == [("a", "scored"), ("b", "cached")] and asked == ["get", "get", "update"]
    asked.clear()
    review.verdict.value = ("{}",)
    got = [(r["path"], r["status"]) for r in review.handleInputRows(("f", "r"), iter(rows), None)]
    assert got == [("a", "cached"), ("b", "cached")] and asked == ["get"]
