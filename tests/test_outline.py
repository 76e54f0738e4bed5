import random

from helpers import finding, findings_df

from rulelens.operators.outline import innermost, outline, outlines, prose_spans, section_context

TEXT = "intro\n\n# One\na\nb\n\n## Two ##\nc\n# Three\n\n### Deep\nd\n## Four\n#no heading"


def test_outline_of_a_text():
    assert [tuple(s) for s in outline(TEXT.split("\n"))] == [
        ("paragraph", None, 1, 1, 1), ("section", "One", 1, 3, 8), ("paragraph", "One", 2, 4, 5), ("section", "Two", 2, 7, 8),
        ("paragraph", "Two", 3, 8, 8), ("section", "Three", 1, 9, 14), ("section", "Deep", 3, 11, 12), ("paragraph", "Deep", 4, 12, 12),
        ("section", "Four", 2, 13, 14), ("paragraph", "Four", 3, 14, 14),
    ]
    assert outline([]) == [] and outline(["", " "]) == []


def test_innermost_equals_a_search():
    rnd = random.Random(3)
    for _ in range(100):
        lines = [rnd.choice(["", "text", "# a", "## b", "### c", "word"]) for _ in range(rnd.randint(0, 30))]
        found = outline(lines)
        for line, place in enumerate(innermost(found, len(lines)), 1):
            around = [i for i, s in enumerate(found) if s[3] <= line <= s[4]]
            assert place == (min(around, key=lambda i: (found[i][4] - found[i][3], -i)) if around else -1)


def test_context_of_findings(spark, corpus):
    texts = corpus([("p", TEXT), ("q", "plain"), (None, "# x"), ("n", None), ("long", "# top\n" + "word\n" * 50_000)])
    rows = [finding(path="p", line=n) for n in (1, 2, 4, 8, 10, 12)]
    rows += [finding(path="q"), finding(path="gone"), finding(path="long", line=40_000), finding(path="p", line=99)]
    got = section_context(findings_df(spark, rows), texts).collect()
    want = [
        ("p", 1, None), ("p", 2, None), ("p", 4, "in section One"), ("p", 8, "in section One / Two"), ("p", 10, "in section Three"),
        ("p", 12, "in section Three / Deep"), ("q", 1, None), ("gone", 1, None), ("long", 40_000, "in section top"), ("p", 99, None),
    ]
    assert sorted(((r["path"], r["start_line"], r["context"]) for r in got), key=str) == sorted(want, key=str)
    contexts = {(r["path"], r["start_line"]): r["context"] for r in got}
    assert contexts["p", 12] == "in section Three / Deep" and contexts["p", 99] is None and contexts["long", 40_000] == "in section top"
    assert contexts["p", 2] is None and contexts["p", 10] == "in section Three" and contexts["gone", 1] is None and len(got) == len(rows)
    assert prose_spans(texts).filter("path = 'p'").count() == 10 and outlines(texts.limit(0)).count() == 0
