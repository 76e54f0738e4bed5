import random
import re

import pytest
from brute import phrase_hits
from pyspark.sql import functions as F

from rulelens.llm import decontaminate


def tables(seed=4):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "été", "x1", "Q", "a", "b"]) if rnd.random() < 0.6 else f"r{rnd.randint(0, 500)}"
    items = [(i, rnd.choice([" ", "--", ", "]).join(word() for _ in range(rnd.choice([1, 2, 5, 13, 20])))) for i in range(12)]
    items += [(12, None), (13, "!!"), (None, "the of the"), (3, items[4][1])]
    docs = [(100, None), (101, ""), (102, "?! "), (None, items[3][1])]
    for i in range(60):
        parts = [rnd.choice(items)[1] or "" if rnd.random() < 0.3 else word() for _ in range(rnd.randint(0, 30))]
        docs.append((i, " ".join(parts).upper() if rnd.random() < 0.2 else ". ".join(parts)))
    return docs + [docs[-1]], items


@pytest.mark.parametrize("window, most", [(13, 50_000), (4, 0)])
def test_equals_the_definition(spark, monkeypatch, window, most):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", most)
    data, items = tables()
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id bigint, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.phrase_matches(docs, bench, window).select("doc_id", "text", "n_words", "n_hit", "hit_items").collect()
    want = []
    for i, text in data:
        n, hit, found = phrase_hits(text, items, window)
        want.append((i, text, n, len(hit) if i is not None else 0, found if i is not None else []))
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    kept = decontaminate.drop_contaminated(docs, bench, window)
    clean = [w for w in want if not (w[3] and 20 * w[3] >= w[2])]
    assert kept.columns == docs.columns and kept.count() == len(clean)
    assert decontaminate.phrase_matches(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.phrase_matches(docs.limit(0), bench).count() == 0


def test_proximity_allows_shifts(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "red old fox jumps"), (3, "red a b c d fox jumps"), (4, "fox red")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "red fox jumps")], "item_id bigint, text string")
    near = lambda slop: sorted(r["doc_id"] for r in decontaminate.proximity_matches(docs, bench, slop).collect())
    assert near(0) == [1] and near(1) == [1, 2] and near(4) == [1, 2, 3]


def test_a_line_separator_at_the_end_is_a_word(spark):
    ends = ["\u2028", "\u2029", "\u0085", "\n", "\r\n", "."]
    data = [(i, "red fox bar." + e) for i, e in enumerate(ends)]
    items = [(7, "red fox bar")]
    found = decontaminate.phrase_matches(spark.createDataFrame(data, "doc_id bigint, text string"),
                                         spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["hit_items"]) for r in found.collect()}
    want = {i: phrase_hits(t, items) for i, t in data}
    assert got == {i: (n, len(hit), names) for i, (n, hit, names) in want.items()}
    assert got[0] == (4, 3, ["7"])


def test_words_are_cut_in_one_pass(spark):
    _words, UPPER = decontaminate._words, decontaminate.UPPER
    texts = [None, "", " .,", "One TWO", "-One\tTWO3-", "Ünd ÄB_c\u0085", "\u2028x.", "İX K"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(_words(F.col("text")).alias("words"))
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()
    small = str.maketrans(UPPER, UPPER.lower())
    assert [r["words"] for r in rows.collect()] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(small)) for t in texts]
