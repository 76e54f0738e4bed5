import random

from helpers import finding, findings_df, sha
from pyspark.sql import functions as F

from rulelens.functions.findings import (
    cached_form,
    findings_from_json,
    findings_to_json,
    level_norm,
    level_rank,
    level_weight,
)
from rulelens.operators.findings import (
    all_findings,
    attach_snippet,
    dedup_findings,
    drop_disabled,
    enrich_findings,
    filter_rules,
    findings_by_category,
    findings_by_level,
    findings_by_path,
    findings_by_tag,
    findings_for_rule,
    findings_of_packs,
    limit_per_path,
)
from rulelens.operators.spans import enclosing_span, python_spans
from rulelens.sources.rules import Rule, rules_df


def ids(df):
    return sorted(r["rule_id"] for r in df.collect())


def test_levels(spark):
    df = spark.createDataFrame([(x,) for x in ["BLOCKER", "critical", "fatal", "", None]], "l string")
    norm = level_norm(F.col("l"))
    got = df.select(norm, level_rank(norm), level_weight(norm), level_rank(F.col("l")), level_weight(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [
        ("blocker", 0, 25, 5, 0), ("critical", 1, 15, 1, 15), ("info", 4, 0, 5, 0), ("info", 4, 0, 5, 0), ("info", 4, 0, 5, 0),
    ]


def test_issue_ids_show_an_end_only_if_it_differs(spark):
    df = findings_df(spark, [finding(line=3, end=e, title=str(e)) for e in (None, 0, 3, 5)])
    got = {r["title"]: r["issue_id"] for r in df.collect()}
    place = {"None": "p.txt:3", "0": "p.txt:3", "3": "p.txt:3", "5": "p.txt:3-5"}
    assert got == {t: sha(f"a/x:{place[t]}:{t}", 12) for t in got}


def test_filters(spark):
    rules = [Rule("p/email", "E", category="pii", tags=("x", "y")), Rule("p/mail", "M"), Rule("q/email", "Q")]
    df = findings_df(spark, [finding(r.rule_id, pack=r.rule_id[0]) for r in rules])
    table = rules_df(spark, rules)
    assert ids(filter_rules(df, ["email"])) == ["p/email", "q/email"]
    assert ids(filter_rules(df, ["p/", "q/"])) == ids(filter_rules(df, [])) == ["p/email", "p/mail", "q/email"]
    assert ids(drop_disabled(df, ["mail", "p/mail"])) == ["p/email", "q/email"]
    assert ids(findings_for_rule(df, "email")) == ["p/email", "q/email"]
    assert ids(findings_for_rule(df, "p/mail")) == ["p/mail"] and ids(findings_for_rule(df, "ail")) == []
    assert ids(findings_of_packs(df, ["p", "q"], ["p", "q"], ["p"])) == ["q/email"]
    assert ids(findings_of_packs(df, ["p", "q"], None, ["q"])) == ["p/email", "p/mail"]
    assert ids(findings_by_tag(df, table, "y")) == ids(findings_by_category(df, table, "pii")) == ["p/email"]
    assert ids(findings_by_level(df, "info")) == []
    row = enrich_findings(df, table).filter("rule_id = 'p/email'").first()
    assert (row["rule_name"], row["category"], row["rule_checklist"]) == ("E", "pii", [])
    try:
        findings_of_packs(df, ["p"], ["zz"])
        raise AssertionError
    except ValueError:
        pass


def test_dedup_prefers_cached_then_confident(spark):
    low, high = finding(confidence=0.4), finding(confidence=0.8)
    fresh = findings_df(spark, [low, high, high, finding(line=2, confidence=0.2)])
    cached = findings_df(spark, [low])
    got = dedup_findings(all_findings(cached, fresh)).orderBy("start_line").collect()
    assert [(r["start_line"], r["cached"], r["confidence"]) for r in got] == [(1, True, 0.4), (2, False, 0.2)]
    assert [r["confidence"] for r in dedup_findings(fresh).orderBy("start_line").collect()] == [0.8, 0.2]


def test_cap_keeps_the_most_severe(spark):
    rng = random.Random(2)
    levels = ["blocker", "critical", "major", "minor", "info"]
    rows = [finding("a/x", rng.choice(levels), f"p{i % 3}", i, title=str(i)) for i in range(90)]
    got = limit_per_path(findings_df(spark, rows)).collect()
    for path in ("p0", "p1", "p2"):
        mine = sorted((r for r in rows if r[3] == path), key=lambda r: (levels.index(r[2]), r[4]))[:10]
        assert sorted(r["start_line"] for r in got if r["path"] == path) == sorted(r[4] for r in mine)
    one = findings_df(spark, rows[:1] + [finding("a/y", "info", "p0", 1, title=str(i)) for i in range(10)])
    assert limit_per_path(one).count() == 10


def test_cap_is_cut_before_the_shuffle(spark):
    plan = limit_per_path(findings_df(spark, [finding()]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_grouped_by_path(spark):
    df = findings_df(spark, [finding("b", "info"), finding("a", "info", title="u"), finding("c", "blocker"), finding(path="q")])
    got = {r["path"]: (r["findings"], [e["rule_id"] for e in r["entries"]]) for r in findings_by_path(df).collect()}
    assert got == {"p.txt": (3, ["c", "a", "b"]), "q": (1, ["a/x"])}


def test_snippets_also_for_a_hot_path(spark, corpus, monkeypatch):
    import rulelens.operators.findings as module
    from rulelens.plans import joins

    def few_rows(*args, **kwargs):
        return joins.lookup_join(*args, **{**kwargs, "rows_per_task": 7})

    monkeypatch.setattr(module, "lookup_join", few_rows)
    text = "\n".join(f"l{i}" for i in range(1, 101))
    df = findings_df(spark, [finding(path="hot", line=i) for i in range(1, 101)] + [finding(path="cold"), finding(path="absent")])
    got = attach_snippet(df, corpus([("hot", text), ("cold", "x"), ("unused", "y")])).collect()
    assert len(got) == 102
    hot = {r["start_line"]: r["snippet"] for r in got if r["path"] == "hot"}
    assert hot[50] == "    48 | l48\n    49 | l49\n>   50 | l50\n    51 | l51\n    52 | l52".replace("    48", "    48")
    others = {r["path"]: r["snippet"] for r in got if r["path"] != "hot"}
    assert others == {"cold": ">    1 | x", "absent": None}


CODE = '''import x

class Outer:
    a = 1

    def method(self):
        def inner():
            return 1
        return inner

    class Nested:
        async def go(self):
            pass

def free():
    class Local:
        b = 2
    return Local

y = 2
'''


def test_python_context(spark, corpus):
    wanted = {
        1: None, 3: "in class Outer", 4: "in class Outer", 6: "in class Outer.method()", 7: "in function inner",
        8: "in function inner", 9: "in class Outer.method()", 11: "in class Nested", 12: "in class Nested.go()",
        15: "in function free", 16: "in class Local", 17: "in class Local", 18: "in function free", 20: None, 99: None,
    }
    spans = python_spans(corpus([("m.py", CODE), ("bad.py", "def f(:\n"), ("nul.py", "\0")]))
    rows = [finding(path="m.py", line=n) for n in wanted] + [finding(path="bad.py"), finding(path="nul.py")]
    got = enclosing_span(findings_df(spark, rows), spans).collect()
    assert {r["start_line"]: r["context"] for r in got if r["path"] == "m.py"} == wanted
    assert {r["context"] for r in got if r["path"] != "m.py"} == {None}
    assert len(got) == len(rows)


def test_spans_over_many_line_buckets(spark):
    spans = spark.createDataFrame(
        [("p", 1, None, "class", "Big", 1, 1000), ("p", 2, 1, "function", "f", 60, 70), ("p", 3, 1, "function", "g", 64, 64)],
        "path string, span_id int, parent_id int, kind string, name string, start_line int, end_line int",
    )
    lines = [1, 63, 64, 65, 999, 1000, 1001]
    got = enclosing_span(findings_df(spark, [finding(path="p", line=n) for n in lines]), spans).collect()
    assert {r["start_line"]: r["context"] for r in got} == {
        1: "in class Big", 63: "in class Big.f()", 64: "in class Big.g()", 65: "in class Big.f()",
        999: "in class Big", 1000: "in class Big", 1001: None,
    }


def test_json_round_trip(spark):
    df = findings_df(spark, [finding(end=4, confidence=0.25, tags=["a", 'q"'], do=["x", "y"])])
    whole = F.array(cached_form(F.struct(*[F.col(c) for c in df.columns])))
    text = df.select(findings_to_json(whole)).first()[0]
    assert '"start_col":null' in text and "snippet" not in text and "issue_id" not in text
    back = spark.range(1).select(findings_from_json(F.lit(text)).alias("f")).first()["f"][0]
    assert back["location"].asDict() == {"path": "p.txt", "start_line": 1, "end_line": 4, "start_col": None, "end_col": None}
    assert (back["confidence"], back["tags"], back["do"]) == (0.25, ["a", 'q"'], ["x", "y"])
    old = spark.range(1).select(findings_from_json(F.lit('[{"rule_id":"r"}]')).alias("f")).first()["f"][0]
    assert (old["confidence"], old["tags"]) == (1.0, [])
