import numpy as np
import pytest

from rulelens.llm import langid

PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "c", "d", "cd", "▁cd", "dc"]


def ways(text, lattice, prob):
    """Probability of a text by listing every segmentation."""
    if not text:
        return np.ones(prob.shape[1])
    total = np.zeros(prob.shape[1])
    for k in range(1, min(len(text), lattice.longest) + 1):
        piece = lattice.ids.get(text[:k], lattice.unknown if k == 1 else None)
        if piece is not None:
            total = total + prob[piece] * ways(text[k:], lattice, prob)
    return total


def test_forward_sums_all_segmentations():
    rnd = np.random.default_rng(0)
    prob = rnd.dirichlet(np.ones(len(PIECES) + 1), 3).T
    lattice = langid.Lattice(PIECES)
    words = ["a", "abba", "cdcd", "abxab", "zz", "ababababab", "\U0001f600a", ""]
    want = [np.log(ways(langid.START + w, lattice, prob)) for w in words]
    assert np.allclose(langid._log_probs(lattice, words, prob), want)
    sizes = np.array([len(w) for w in words])
    arcs, last = lattice.arcs(words), langid._places(sizes)[1]
    for logs in (False, True):
        given = np.log(prob) if logs else prob
        forward, backward = (langid._sums(arcs, sizes, given, logs, back) for back in (False, True))
        assert np.allclose(forward[last], backward[langid._places(sizes)[0]])


def test_long_words_are_summed_whole():
    prob = np.random.default_rng(1).dirichlet(np.ones(len(PIECES) + 1), 2).T
    lattice = langid.Lattice(PIECES)
    for word in ("ab" * 40, "abcdx" * 2000):
        log = [np.zeros(2)]
        marked = langid.START + word
        for end in range(1, len(marked) + 1):  # the same sums, one place after the other, as logarithms
            ways_in = []
            for start in range(max(0, end - lattice.longest), end):
                piece = lattice.ids.get(marked[start:end], lattice.unknown if start == end - 1 else None)
                if piece is not None:
                    ways_in.append(log[start] + np.log(prob[piece]))
            log.append(np.logaddexp.reduce(ways_in))
        assert np.allclose(langid._log_probs(lattice, ["a", word, "abba"], prob)[1], log[-1])


def segmentations(text, lattice):
    if not text:
        yield []
    for k in range(1, min(len(text), lattice.longest) + 1):
        piece = lattice.ids.get(text[:k], lattice.unknown if k == 1 else None)
        if piece is not None:
            for rest in segmentations(text[k:], lattice):
                yield [piece, *rest]


def test_fit_equals_expectation_maximisation_over_listed_segmentations(spark):
    data = {"x": ["abba", "ab", "ab", "cab"], "y": ["cdc", "dcd", "zz", "abcd"]}
    rows = [(i, " ".join(words) + " 12½", lang) for i, (lang, words) in enumerate(data.items())]
    names, got = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), PIECES)
    lattice = langid.Lattice(PIECES)
    for k, lang in enumerate(names):
        prob = np.full(len(PIECES) + 1, 1 / (len(PIECES) + 1))
        for _ in range(langid.ROUNDS):
            total = np.full(len(prob), langid.SMOOTHING)
            for word in data[lang]:
                listed = list(segmentations(langid.START + word, lattice))
                weight = np.array([np.prod(prob[s]) for s in listed])
                for s, w in zip(listed, weight / weight.sum()):
                    np.add.at(total, s, w)
            prob = total / total.sum()
        assert np.allclose(got[:, k], prob)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "ab ba abba " * 3, "x") for i in range(20)] + [(i, "cd dc cddc " * 3, "y") for i in range(20, 40)]
    rows += [(40, None, "x"), (41, "ab", None), (42, "12", "x"), (None, "ab", "x")]
    return langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), PIECES)


def test_learns_and_predicts_odd_rows(spark, model):
    names, prob = model
    assert names == ["x", "y"] and np.allclose(prob.sum(axis=0), 1)
    rows = [(1, "abba!", 1), (1, "abba!", 1), (2, "CD, dc", 2), (3, None, 3), (4, "12 !?", 4), (5, "", 5), (None, "ab" * 5000, 6)]
    rows += [(7, "½ ² ① _", 7), (8, "½cd²dc", 8)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id bigint, text string, score int"), PIECES, names, prob).collect()
    want = [("1", "x"), ("1", "x"), ("2", "y"), ("3", "und"), ("4", "und"), ("5", "und"), ("7", "und"), ("8", "y"), ("None", "x")]
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == want
    plain = {r["doc_id"]: r["score"] for r in got}
    same = langid.predict(spark.createDataFrame([(8, "cd dc")], "doc_id bigint, text string"), PIECES, names, prob).first()
    assert np.isclose(plain[8], same["score"])
    even = langid.predict(spark.createDataFrame([(1, "ab")], "doc_id bigint, text string"), PIECES, ["p", "q"], np.repeat(prob[:, :1], 2, 1))
    assert even.first()["lang_pred"] == "p"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_without_anything_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    names, prob = langid.fit(empty, PIECES)
    assert names == [] and langid.predict(empty, PIECES, names, prob).count() == 0
    one = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    assert langid.predict(one, PIECES, names, prob).first()["lang_pred"] == "und"


@pytest.mark.parametrize("limit", [200])
def test_held_out_languages_of_the_given_documents(spark, limit):
    from pathlib import Path

    from rulelens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("needs the given tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, sf).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) > 0.97 * limit / 2
