import random

import pytest
from brute import removed, words

from rulelens.llm.substrings import cut_duplicates, substring_dedup


def rows(seed=1, n=40):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 3)) for _ in range(rnd.randint(3, 30))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else f"w{rnd.randint(0, 99999)}" for _ in range(rnd.randint(0, 6))]
        out.append((rnd.randint(0, 30), rnd.choice([" ", "\n", "  \t"]).join(parts)))
    out += [(50, None), (51, ""), (None, passages[0]), (None, None), (52, "is " * 200), (53, "is " * 300), (3, out[0][1]), out[0]]
    return out


@pytest.mark.parametrize("window", [2, 4, 13])
def test_equals_the_definition(spark, window):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id bigint, text string, kept string").repartition(3)
    got = substring_dedup(docs, window).collect()
    gone = removed(rows(), window)
    want = []
    for at, (i, text) in enumerate(rows()):
        kept = [w for k, w in enumerate(words(text)) if k not in gone[at]]
        want.append((str(i), len(words(text)), len(gone[at]), " ".join(kept)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(want)
    texts = {}
    for i, text in rows():
        texts.setdefault(i, []).append(words(text))
    for r in got:
        places = [p for f in r["factors"] for p in range(f["start"], f["start"] + f["length"])]
        assert len(places) == len(set(places)) == r["n_removed"]
        own = [t for t in texts[r["doc_id"]] if len(t) == r["n_words"]]
        for f in r["factors"]:
            assert f["ref_id"] < r["doc_id"]
            there = [t[f["ref_start"] : f["ref_start"] + f["length"]] for t in texts[f["ref_id"]]]
            assert any(t[f["start"] : f["start"] + f["length"]] in there for t in own)


def test_factors_are_a_parse_against_references(spark):
    a, b = ([f"{c}{i}" for i in range(40)] for c in "ab")
    data = [(1, a), (2, b), (3, ["x", *a[5:30], *b[3:20], "y"]), (4, a[10:40] + a[:20]), (5, [*a[5:30], *b[3:20]])]
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in data], "doc_id bigint, text string")
    got = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in substring_dedup(docs).collect()}
    assert got[1] == got[2] == []
    assert got[3] == [(1, 25, 1, 5), (26, 17, 2, 3)]
    assert got[4] == [(0, 30, 1, 10), (30, 20, 1, 0)]
    # The windows across the boundary are in document 3 alone, so that its words take over from there.
    assert got[5] == [(0, 25, 1, 5), (25, 12, 3, 26), (37, 5, 2, 15)]


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        substring_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_cut_keeps_columns_and_untouched_texts(spark):
    data = [(1, "a b c d\n e", 7), (2, "x  a b c d y\n", 8), (3, "a b c d", 9), (4, " spaced   out ", 1), (None, "a b c d", 2), (5, None, 3)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, id bigint")
    got = cut_duplicates(docs, 4)
    assert got.columns == docs.columns
    want = [(1, "a b c d\n e", 7), (2, "x y", 8), (4, " spaced   out ", 1), (None, "a b c d", 2), (5, None, 3)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert cut_duplicates(docs.limit(0)).count() == 0
