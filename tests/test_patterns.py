import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulelens.functions.patterns import (
    content_trigger,
    glob_match,
    glob_to_regex,
    java_pattern,
    path_trigger,
    required_literal,
)

GLOBS = [
    "*", "**", "*.py", "**/*.py", "**/views.py", "src/*", "a?c", "[ab]*", "[!a]*", "[]]x", "[!]]x", "[a", "a[b", "[a-c]x",
    "[c-a]x", "[!c-a]x", "x[a-]", "a.b", "a+b", "*/", "src", "*it's*", "[[]x", "[\\]x", "[a&&b]x", "[!]", "é*", "*.*", "",
]
PATHS = [
    "", "a.py", "b/a.py", "views.py", "x/views.py", "src/a/b.txt", "src", "abc", "aXc", "]x", "-x", "a.b", "aXb", "a+b", "cx", "bx",
    "x-", "xa", "a/", "it's", "[x", "\\x", "&x", "é.txt", "a\nb", "[a", "a[b", "[!]", "b\n",
]


def py_regex(glob):
    return re.compile(glob_to_regex(glob).replace(r"\z", r"\Z"))


def test_globs_equal_fnmatch_in_python_and_spark(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    wanted = {(g, p) for g in GLOBS for p in PATHS if fnmatch.fnmatchcase(p, g)}
    assert {(g, p) for g in GLOBS for p in PATHS if py_regex(g).search(p)} == wanted
    got = df.selectExpr("path", *[f"{glob_match('path', g)} AS g{i}" for i, g in enumerate(GLOBS)]).collect()
    assert {(g, r["path"]) for r in got for i, g in enumerate(GLOBS) if r[f"g{i}"]} == wanted


@settings(max_examples=400, deadline=None)
@given(st.text("ab/.*?[]!-\\^", max_size=7), st.text("ab/.[]!-\\^", max_size=6))
def test_globs_equal_fnmatch_on_random_input(glob, path):
    assert bool(py_regex(glob).search(path)) == fnmatch.fnmatchcase(path, glob)


def test_double_star_still_needs_a_slash(spark):
    df = spark.createDataFrame([("x",), ("a/x",)], "path string")
    assert [r[0] for r in df.filter(glob_match("path", "**/x")).collect()] == ["a/x"]


REGEXES = [r"a.c$", r"^b", r"\bword\b", r"\d+", r"(?i)SELECT", r"(?P<q>['\"])x(?P=q)", r"end\Z", r"\\Z", r"a|b", r"\s{2,}", "it's", r"\w+é"]
TEXTS = ["a.c", "a\rc", "abc\n", "x\nb", "bword", "a word!", "٣", "select É", "'x'", '"x\'', "the end", "end\n", "\\Z", "a  b", "it's", "caféé", ""]


def test_regexes_mean_what_python_means(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.selectExpr("t", *[f"{content_trigger('t', [p])} AS r{i}" for i, p in enumerate(REGEXES)]).collect()
    for row in got:
        for i, pattern in enumerate(REGEXES):
            assert row[f"r{i}"] == bool(re.search(pattern, row["t"])), (pattern, row["t"])


@pytest.mark.parametrize(
    "pattern, literal",
    [
        (r"eval\(", "eval("),
        (r"foo\s+barbaz", "barbaz"),
        (r"a|b", ""),
        (r"(?i)select", ""),
        (r"(?:abc)+d", "abc"),
        (r"(?:abc)*d", "d"),
        (r"(?i:abc)de", "de"),
        (r"(?!abc)x", "x"),
        (r"[xy]", ""),
        (r"(", ""),
        (r"ab?c", "a"),
    ],
)
def test_required_literal(pattern, literal):
    assert required_literal(pattern) == literal


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"\A(ab|c)+(x{1,2}|[yz])(foo)?bar\Z"))
def test_required_literal_is_in_every_match(text):
    assert required_literal(r"(ab|c)+(x{1,2}|[yz])(foo)?bar") in text


def test_flags_only_where_needed():
    assert java_pattern("abc") == "(?d)abc"
    assert java_pattern(r"\d").startswith("(?dU)")
    assert java_pattern("(?i)x").startswith("(?dU)")


def test_empty_triggers_always_hold():
    assert path_trigger("path", []) == content_trigger("content", []) == "true"
