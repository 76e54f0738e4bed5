import json
from datetime import datetime, timedelta

import pytest
from helpers import sha

from rulelens.operators.scorer import canned_scorer, python_scorer
from rulelens.operators.spans import python_spans
from rulelens.plans.review import Options, apply_budget, changed_corpus, review, review_changed
from rulelens.schemas import CACHE, FINDING_COLUMNS
from rulelens.sources.rules import Rule

NOW = datetime(2024, 5, 1)
RULES = [
    Rule("py/eval", "Eval", "critical", code_patterns=(r"eval\(",)),
    Rule("py/todo", "Todo", "minor", code_patterns=("TODO",)),
    Rule("txt/any", "Any", "info", file_patterns=("*.txt",)),
]


def issue(rule="py/eval", level="critical", line=1, title="t", **more):
    return {"rule_id": rule, "level": level, "location": {"start_line": line}, "title": title, "why": "w", "do": ["d"], **more}


def answer(*issues):
    return json.dumps({"issues": list(issues)})


SCORER = canned_scorer({"eval(": answer(issue(), issue("py/todo", "minor", 2)), "TODO": answer(issue("py/todo", "minor"))})
ROWS = [("a.py", "eval(1)\n# TODO\n"), ("b.py", "# TODO"), ("c.py", "x"), ("d.txt", "plain"), ("e.py", "eval(1)\n# TODO")]


def options(**changed):
    return Options(**{"as_of": NOW, "pack_name": "one+two", "model": "m", **changed})


def plain(df):
    return sorted((r["path"], r["rule_id"], r["start_line"]) for r in df.collect())


def meta(result):
    row = result.run_meta.first()
    return row["files_analyzed"], row["skipped"], row["cache_hits"], row["llm_calls"], row["deferred"]


ALL = [("a.py", "py/eval", 1), ("a.py", "py/todo", 2), ("b.py", "py/todo", 1), ("e.py", "py/eval", 1), ("e.py", "py/todo", 2)]


@pytest.fixture
def empty_cache(spark):
    return spark.createDataFrame([], CACHE)


def test_empty_corpus(spark, corpus, empty_cache):
    result = review(corpus([]), RULES, SCORER, options(), empty_cache)
    assert result.summary.first()["score"] == 100 and meta(result) == (0, 0, 0, 0, 0) and result.findings.count() == 0


@pytest.mark.parametrize("budget", [None, 10])
@pytest.mark.parametrize("with_cache", [True, False])
def test_first_run(spark, corpus, empty_cache, budget, with_cache):
    opts = options(budget=budget, prices={"m": (1.0, 1.0)})
    result = review(corpus(ROWS), RULES, SCORER, opts, empty_cache if with_cache else None)
    assert plain(result.findings) == ALL and result.findings.columns == FINDING_COLUMNS
    assert meta(result) == (5, 1, 0, 4, 0) and result.rejected.count() == result.deferred.count() == 0
    assert result.summary.first()["score"] == 100 - 15 * 2 - 3 * 3
    row = result.findings.filter("path = 'a.py' and start_line = 1").first()
    assert row["issue_id"] == sha("py/eval:a.py:1:t", 12) and row["pack"] == "one+two" and row["source"] == "llm"
    assert row["confidence"] == 0.9 and row["snippet"] == ">    1 | eval(1)\n     2 | # TODO"
    usage = result.usage.collect()
    assert len(usage) == 4 and {u["issues_found"] for u in usage} == {0, 1, 2}
    assert sum(u["cost_usd"] for u in usage) == sum(u["total_tokens"] for u in usage) == result.run_meta.first()["cost_usd"]
    # a.py and e.py have the same normalised text and rules, so they share one entry; d.txt has an empty one.
    assert sorted(len(r["findings"]) for r in result.new_cache.collect()) == [0, 1, 2]


def test_second_run_is_served_from_the_cache(spark, corpus):
    first = review(corpus(ROWS), RULES, SCORER, options())
    second = review(corpus(ROWS), RULES, SCORER, options(), first.new_cache)
    assert meta(second) == (5, 1, 4, 0, 0) and plain(second.findings) == ALL
    # Findings stored under one path are bound to the path that asks, with a snippet of its own text.
    rows = second.findings.filter("start_line = 2").collect()
    assert {r["snippet"] for r in rows} == {"     1 | eval(1)\n>    2 | # TODO"} and len(rows) == 2
    later = options(as_of=NOW + timedelta(hours=168))
    assert meta(review(corpus(ROWS), RULES, SCORER, later, first.new_cache)) == (5, 1, 0, 4, 0)
    unread = review(corpus(ROWS), RULES, SCORER, options(no_cache=True), first.new_cache)
    assert meta(unread) == (5, 1, 0, 4, 0) and unread.new_cache.count() == 3
    salted = review(corpus(ROWS), RULES, SCORER, options(cache_salt="v2"), first.new_cache)
    assert meta(salted)[2] == 0


def test_budget_defers_the_rest(spark, corpus):
    result = review(corpus(ROWS), RULES, SCORER, options(budget=2))
    assert meta(result) == (5, 1, 0, 2, 2)
    assert sorted(r["path"] for r in result.deferred.collect()) == ["d.txt", "e.py"]
    assert {p for p, _, _ in plain(result.findings)} == {"a.py", "b.py"}
    none = review(corpus(ROWS), RULES, SCORER, options(budget=0))
    assert meta(none) == (5, 1, 0, 0, 4) and none.findings.count() == 0


def test_rule_filter_changes_key_and_findings(spark, corpus):
    whole = review(corpus(ROWS), RULES, SCORER, options())
    part = review(corpus(ROWS), RULES, SCORER, options(rule_filter=("todo",)), whole.new_cache)
    assert plain(part.findings) == [r for r in ALL if r[1] == "py/todo"]
    assert meta(part) == (5, 2, 1, 2, 0)


def test_disabled_rules_are_scored_and_dropped_late(spark, corpus):
    result = review(corpus(ROWS), RULES, SCORER, options(disabled_rules=("py/eval", "todo")))
    assert plain(result.findings) == [r for r in ALL if r[1] == "py/todo"]
    assert meta(result) == (5, 1, 0, 4, 0) and result.summary.first()["score"] == 91


def test_cap_and_dedup_before_the_score(spark, corpus):
    many = [issue("r/minor", "minor", i) for i in range(1, 12)] + [issue("r/block", "blocker", 50)] * 3
    result = review(corpus(ROWS[1:2]), RULES, canned_scorer({"TODO": answer(*many)}), options())
    got = plain(result.findings)
    assert len(got) == 10 and ("b.py", "r/block", 50) in got and ("b.py", "r/minor", 9) in got
    assert result.summary.first()["score"] == 100 - 25 - 9 * 3


def test_optional_filters(spark, corpus):
    scorer = canned_scorer({"TODO": answer(issue("py/todo", "minor", confidence=0.5), issue("made/up", "info", confidence=0.95))})
    rows = corpus(ROWS[1:2])
    assert len(plain(review(rows, RULES, scorer, options()).findings)) == 2
    assert plain(review(rows, RULES, scorer, options(min_confidence=0.8)).findings) == [("b.py", "made/up", 1)]
    assert plain(review(rows, RULES, scorer, options(known_rules_only=True)).findings) == [("b.py", "py/todo", 1)]


def test_bad_answers_are_quarantined_and_not_cached(spark, corpus):
    scorer = canned_scorer({"eval(": "oops", "TODO": answer(issue("py/todo", "fatal"), issue("py/todo", "minor"))})
    result = review(corpus(ROWS), RULES, scorer, options())
    assert plain(result.findings) == [("b.py", "py/todo", 1)]
    assert sorted((r["path"], r["reject_reason"]) for r in result.rejected.collect()) == [
        ("a.py", "malformed"), ("b.py", "unknown_level"), ("e.py", "malformed"),
    ]
    assert result.new_cache.count() == 2 and meta(result)[3] == 4


def test_python_scorer_is_called_once_per_row(spark, corpus, tmp_path):
    folder = str(tmp_path)

    def scorer(prompts):
        import json
        import os
        import uuid

        for _ in prompts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w"):
                pass
        return [json.dumps({"issues": []}) for _ in prompts]

    result = review(corpus(ROWS), RULES, python_scorer(scorer), options())
    for df in (result.findings, result.new_cache, result.usage, result.rejected, result.run_meta):
        df.collect()
    assert len(list(tmp_path.iterdir())) == 4


def test_context_of_findings(spark, corpus):
    rows = corpus([("m.py", "def f():\n    eval(1)  # TODO\n")])
    found = review(rows, RULES, SCORER, options(spans=python_spans(rows))).findings
    assert {r["context"] for r in found.collect()} == {"in function f"}


def test_changed_rows_only(spark, corpus):
    old = corpus([("a.py", "eval(1)\n# TODO"), ("b.py", "old"), ("gone.py", "eval(2)")])
    new = corpus(ROWS)
    assert {r["path"]: r["is_new"] for r in changed_corpus(old, new).collect()} == {"b.py": False, "c.py": True, "d.txt": True, "e.py": True}
    result = review_changed(old, new, RULES, SCORER, options(), globs=["*.py"], exclude=["e.*"])
    assert plain(result.findings) == [("b.py", "py/todo", 1)] and meta(result) == (2, 1, 0, 1, 0)


def test_budget_on_its_own(spark, corpus):
    chosen, deferred = apply_budget(corpus(ROWS).select("path"), 3)
    assert [r["path"] for r in chosen.orderBy("path").collect()] == ["a.py", "b.py", "c.py"]
    assert [r["path"] for r in deferred.orderBy("path").collect()] == ["d.txt", "e.py"]
    everything, nothing = apply_budget(corpus(ROWS).select("path"), None)
    assert everything.count() == 5 and nothing.count() == 0


def test_repeated_rows_are_scored_once(spark, corpus):
    rows = [("a.py", "TODO")] * 5 + [("b.py", "TODO"), ("b.py", "TODO x")]
    result = review(corpus(rows), RULES, SCORER, options())
    assert result.usage.count() == 3 and meta(result) == (3, 0, 0, 3, 0)
    assert plain(result.findings) == [("a.py", "py/todo", 1), ("b.py", "py/todo", 1)]
    again = review(corpus(rows), RULES, SCORER, options(budget=1), result.new_cache)
    assert meta(again) == (3, 0, 3, 0, 0) and plain(again.findings) == plain(result.findings)


def test_long_texts_are_scored_whole(spark, corpus):
    rows = corpus([("long.py", "x" * 30_000 + " eval(1)")])
    assert len(plain(review(rows, RULES, SCORER, options()).findings)) == 2
    assert plain(review(rows, RULES, SCORER, options(max_prompt_chars=1000)).findings) == []


def test_cached_findings_show_the_text_they_were_found_in(spark, corpus):
    rows = [("a.py", "eval(1)\n# TODO"), ("a.py", "# TODO")]
    cache = review(corpus(rows), RULES, SCORER, options()).new_cache
    found = review(corpus(rows), RULES, SCORER, options(), cache)
    assert meta(found)[2:4] == (2, 0)
    got = {(r["rule_id"], r["start_line"]): r["snippet"] for r in found.findings.collect()}
    assert got == {
        ("py/eval", 1): ">    1 | eval(1)\n     2 | # TODO",
        ("py/todo", 2): "     1 | eval(1)\n>    2 | # TODO",
        ("py/todo", 1): ">    1 | # TODO",
    }
