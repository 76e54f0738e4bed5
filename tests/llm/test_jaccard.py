import random

import pytest
from brute import jaccard_components as by_definition
from brute import shingles

from rulelens.llm import jaccard


def rows(seed, families=8):
    rnd = random.Random(seed)
    out = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one"), (906, "one"), (None, "one")]
    for _ in range(families):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([9, 11, 14, 40, 120, 300]))]
        for _ in range(rnd.randint(1, 14)):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                text[rnd.randrange(len(text))] = f"z{rnd.randint(0, 9)}"
            if rnd.random() < 0.3:
                text = text[: len(text) - rnd.randint(0, len(text) // 12)]
            out.append((rnd.randint(0, 800), " ".join(text)))
    return out + [out[-1], out[-2]]


@pytest.mark.parametrize("seed, size, percent, block", [(1, 3, 90, 1024), (2, 5, 80, 3), (3, 1, 75, 4), (4, 2, 100, 2)])
def test_components_equal_the_definition(spark, monkeypatch, seed, size, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    data = rows(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id bigint, text string, component_id string")
    want = by_definition(data, size, percent)
    got = [tuple(r) for r in jaccard.jaccard_components(docs.repartition(3), size, percent).collect()]
    assert sorted(map(str, got)) == sorted(str((i, len(shingles(t, size)), want.get(i))) for i, t in data)
    assert len(set(want.values())) < len(want)


def test_low_similarities_are_refused(spark):
    with pytest.raises(ValueError):
        jaccard.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string"), 3, 50)


def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    data = [(5, text, 1), (3, text, 2), (9, text.replace("w59", "new"), 3), (4, None, 4), (None, text, 5)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, u bigint")
    kept = jaccard.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r["u"] for r in kept.collect()) == [2, 4, 5]
    assert jaccard.one_per_component(docs.limit(0)).count() == 0


def test_links_across_band_edges(spark):
    def text(name, shared, own):  # shared + own - 4 shingles of five words
        return " ".join([f"{name}s{i}" for i in range(shared)] + [f"{name}{own}{i}" for i in range(own)])

    data, pairs = [], []
    for e in jaccard.BANDS[(jaccard.BANDS >= 6) & (jaccard.BANDS <= 711)].tolist():
        least = -(-80 * e // 100)  # e shingles over the edge, as few below it as link, and one less than the edge
        for n in {least, e - 1}:
            pairs.append((f"e{e}n{n}", (n + 4, 0), (n + 4, e - n)))
    pairs.append(("p582", (84, 14), (84, 5)))  # 94 and 85 shingles, 80 of them in both: documents 582 and 875 of sf0.01
    for k, (name, a, b) in enumerate(pairs):
        data += [(2 * k, text(name, *a)), (2 * k + 1, text(name, *b))]
    want = by_definition(data, 5, 80)
    assert all(want[2 * k + 1] == 2 * k for k in range(len(pairs)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 5, 80).collect()}
    assert got == want
