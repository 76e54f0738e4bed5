import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rulelens.llm import classifier


def test_features_are_word_ngrams():
    row, index, counts = classifier.features(["a b a", None, "", "x x x", "b"])
    assert counts.tolist() == [5, 0, 0, 5, 1] and row.tolist() == [0] * 5 + [3] * 5 + [4]
    assert len(set(index[:3])) == 2 and index[10] in index[:3]
    again = classifier.features(["y y y"])[1]
    assert len(set(index[5:10]) & set(again)) == 2  # a repeated word, and two in a row, whatever the word


def test_dots_equal_the_single_ones():
    rnd = np.random.default_rng(1)
    w = rnd.normal(size=classifier.DIMENSIONS)
    texts = ["the cat sat on the mat", "", "x " * 500, "a b c"]
    row, index, counts = classifier.features(texts)
    got = classifier._dots(row, index, counts, w)
    for i in range(len(texts)):
        at, x = classifier._sparse(index[row == i])
        assert np.isclose(got[i], w[at] @ x)


def test_learns_scores_odd_rows_and_repeats_itself(spark):
    docs = [(i, "plain words stand here" if i % 2 else "### $$$ ### %%%", 9) for i in range(200)]
    docs += [(300, None, 9), (301, "", 9), (None, "### $$$", 9), (302, "plain words", 9), (302, "plain words", 9)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, label int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(3, 1), (300, None), (999, 1)], "doc_id bigint, label int")
    weights = classifier.fit(docs, labels)
    assert np.array_equal(weights, classifier.fit(docs, labels))
    got = classifier.score(docs, weights).collect()
    assert len(got) == 205 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    nothing = classifier.fit(docs, labels.limit(0))
    assert not nothing.any() and classifier.score(docs.limit(0), nothing).count() == 0


def plain_ftrl(examples):
    """Weights by coordinate: follow the regularised leader one example and one coordinate at a time, a learner a shard."""
    z, n = {}, {}

    def weight(i, z, n):
        l1 = 0 if i == classifier.BIAS else classifier.L1
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((classifier.STEADY + math.sqrt(n[i])) / classifier.RATE + classifier.L2)

    for _ in range(classifier.EPOCHS):
        moves = []
        for shard in sorted({s for s, _, _, _ in examples}):
            own_z, own_n = dict(z), dict(n)
            for _, _, label, text in sorted(e for e in examples if e[0] == shard):
                index = classifier.features([text])[1].tolist()
                x = {i: min(c * classifier.SCALE / math.sqrt(len(index)), 8 * classifier.SCALE) for i, c in Counter(index).items()}
                x[classifier.BIAS] = 1.0
                w = {i: weight(i, own_z, own_n) for i in x}
                p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
                for i, v in x.items():
                    g, before = (p - label) * v, own_n.get(i, 0.0)
                    own_z[i] = own_z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / classifier.RATE * w[i]
                    own_n[i] = before + g * g
            moves += [(i, own_z[i] - z.get(i, 0), own_n[i] - n.get(i, 0)) for i in own_z]
        for i, dz, dn in moves:
            z[i], n[i] = z.get(i, 0) + dz / classifier.SHARDS, n.get(i, 0) + dn / classifier.SHARDS
    return {i: weight(i, z, n) for i in z}


def test_fit_equals_plain_updates(spark):
    rnd = np.random.default_rng(4)
    texts = [" ".join(rnd.choice(["good", "plain", "words", "###", "$$", "spam", "spam", "é"], 12)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int("good" in t)) for i, t in enumerate(texts)], "doc_id bigint, label int")
    place = F.xxhash64("doc_id", "text")
    dealt = docs.join(labels, "doc_id").select(F.pmod(place, F.lit(classifier.SHARDS)), place, "label", "text")
    want = plain_ftrl([tuple(r) for r in dealt.collect()])
    got = classifier.fit(docs, labels)
    assert np.allclose([got[i] for i in want], list(want.values()), atol=1e-9) and np.count_nonzero(got) <= len(want)
    assert len({s for s, *_ in (tuple(r) for r in dealt.collect())}) > 3 and any(want.values())
