import pytest

from rulelens.operators.match import applicable_rules, content_matches, detect_lines, match_rules, path_matches
from rulelens.packs import CHAT, HOUSE, PACKS
from rulelens.sources.rules import Rule, compose_rules

RULES = [
    Rule("a/always", "Always"),
    Rule("a/glob", "Glob", file_patterns=("*.py", "lib/*")),
    Rule("a/regex", "Regex", code_patterns=(r"eval\(", r"exec\(")),
    Rule("a/both", "Both", "blocker", file_patterns=("*.py",), code_patterns=(r"eval\(",)),
    Rule("a/ref", "Back-reference", code_patterns=(r"(\w+) == \1\b",)),
]
ROWS = [
    ("x.py", "eval(1)"),
    ("x.txt", "eval(1)\nexec(2)"),
    ("lib/y", "a == a"),
    ("z", "nothing"),
    ("e.py", ""),
]
WANTED = {
    ("x.py", "a/always"), ("x.py", "a/glob"), ("x.py", "a/regex"), ("x.py", "a/both"), ("x.txt", "a/always"),
    ("x.txt", "a/regex"), ("lib/y", "a/always"), ("lib/y", "a/glob"), ("lib/y", "a/ref"), ("z", "a/always"),
    ("e.py", "a/always"), ("e.py", "a/glob"),
}


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_any_chunking_applies_path_and_content_triggers(corpus):
    for chunk in (250, 2):
        assert pairs(applicable_rules(corpus(ROWS), RULES, chunk)) == sorted(WANTED)


def test_rule_ids_are_sorted_and_empty_without_rules(corpus):
    rows = match_rules(corpus(ROWS), RULES).collect()
    assert all(r["rule_ids"] == sorted(r["rule_ids"]) for r in rows)
    assert [r["rule_ids"] for r in match_rules(corpus(ROWS), []).collect()] == [[]] * len(ROWS)


def test_many_rules_and_null_rows(corpus):
    many = [Rule(f"m/{i}", "n", code_patterns=(f"k{i}k",)) for i in range(1200)]
    found = {r["path"]: r["rule_ids"] for r in match_rules(corpus([("p", "k7k k400k k1100k"), ("q", None), (None, "k8k")]), many).collect()}
    assert found == {"p": ["m/1100", "m/400", "m/7"], "q": [], None: ["m/8"]}


def test_patterns_mean_what_python_means(corpus):
    import re

    patterns = ["[a&&b]&", "a{,3}b", "[[]", "[[:]y", "foo(?#c)", "[]x]", r"[\]]z", "[^]]"]
    texts = ["a&", "&&", "aab", "[", ":y", "foo", "]", "x", "]z", "q"]
    rules = [Rule(f"p/{i}", "n", code_patterns=(p,)) for i, p in enumerate(patterns)]
    got = {r["content"]: r["rule_ids"] for r in match_rules(corpus([("p", t) for t in texts]), rules).collect()}
    assert got == {t: [f"p/{i}" for i, p in enumerate(patterns) if re.search(p, t)] for t in texts}
    for pattern in (r"(?a)\w+", "(unclosed"):
        with pytest.raises(ValueError, match="rule bad/one"):
            match_rules(corpus(ROWS), [Rule("bad/one", "n", code_patterns=(pattern,))])


def test_lines_are_those_of_the_snippet(corpus):
    rule = [Rule("w/bad", "n" * 100, code_patterns=("worthless$",))]
    rows = detect_lines(corpus([("u", "a\u2028bad\nworthless"), ("c", "x\r\nworthless\r\n"), ("r", "x\rworthless")]), rule).collect()
    assert sorted((r["path"], r["start_line"]) for r in rows) == [("c", 2), ("r", 2), ("u", 3)]
    assert {r["title"] for r in rows} == {"n" * 100}


def test_single_triggers(corpus):
    df = corpus(ROWS)
    assert ("z", "a/regex") in pairs(path_matches(df, RULES))
    assert ("x.txt", "a/both") in pairs(content_matches(df, RULES))


def test_line_findings(corpus, spark):
    rows = detect_lines(corpus(ROWS), RULES).select("path", "start_line", "rule_id", "level", "source").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("lib/y", 1, "a/ref", "info", "regex"),
        ("x.py", 1, "a/both", "blocker", "regex"),
        ("x.py", 1, "a/regex", "info", "regex"),
        ("x.txt", 1, "a/regex", "info", "regex"),
        ("x.txt", 2, "a/regex", "info", "regex"),
    ]
    assert detect_lines(corpus(ROWS), RULES[:2]).count() == 0


def test_rules_are_evaluated_once(corpus):
    df = match_rules(corpus(ROWS), RULES).filter("size(rule_ids) > 1").selectExpr("path", "explode(rule_ids) AS r")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?d)exec\(") == 1


def test_our_packs_compose():
    name, rules = compose_rules(PACKS, [HOUSE])
    by_id = {r.rule_id: r for r in rules}
    assert name == "prose+web+chat" and by_id["privacy/phone"].level == "major" and by_id["privacy/phone"].pack == "house"
    assert len(rules) == len({r.rule_id for p in PACKS for r in p.rules}) and CHAT.version == "0.1.0"
    assert {r.level for r in rules} == {"blocker", "critical", "major", "minor", "info"}
