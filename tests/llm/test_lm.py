import math
import random
from collections import Counter

import pytest

from rulelens.llm import lm

ROWS = [(1, "a b a b", 0), (2, "A c", 0), (3, None, 0), (4, " ", 0), (None, "a b", 0), (5, "zz yy", 0), (5, "zz yy", 0), (6, "b", 0)]


def by_definition(rows, target):
    """Losses of each row by counts in dictionaries, its own left out."""
    split = [["", *(text or "").translate(str.maketrans("ABC", "abc")).split()] for _, text in rows]
    sides = [i is not None and i in target for i, _ in rows]
    sums = {}
    for side in (True, False):
        one, two = Counter(), Counter()
        for ws, mine in zip(split, sides):
            if mine == side and len(ws) > 1:
                one.update(ws)
                two.update(zip(ws, ws[1:]))
        sums[side] = one, two, sum(one.values()) - one[""]
    known = 1 + len(set(sums[True][0]) | set(sums[False][0]))
    scale = sums[False][2] / sums[True][2] if sums[True][2] and sums[False][2] else 1
    out = []
    for (i, _), ws, mine in zip(rows, split, sides):
        losses = []
        for side, unseen in ((True, lm.UNSEEN), (False, lm.UNSEEN * scale)):
            one, two, n = sums[side]
            if side == mine:
                one, two, n = one - Counter(ws), two - Counter(zip(ws, ws[1:])), n - len(ws) + 1
            loss = 0
            for b, w in zip(ws, ws[1:]):
                single = (one[w] + unseen) / (n + unseen * known)
                share = two[b, w] / one[b] if one[b] else single
                loss -= math.log(lm.PAIR_WEIGHT * share + (1 - lm.PAIR_WEIGHT) * single)
            losses.append(loss / (len(ws) - 1) if len(ws) > 1 else None)
        out.append((str(i), len(ws) - 1, *losses))
    return sorted(out, key=str)


def texts(seed, many):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["A", "ü", "\U0001f600"]
    out = []
    for i in range(many):
        ws = rnd.choices(vocabulary, [1 / (k + 1) for k in range(63)], k=rnd.randint(0, 70))
        out.append((rnd.choice([i, i, None]), rnd.choice([" ", "\n "]).join(ws) or None))
    return out


@pytest.mark.parametrize("rows, target, parts", [
    ([r[:2] for r in ROWS], {1, 3, 77}, 3),
    ([r[:2] for r in ROWS], set(), 1),
    ([r[:2] for r in ROWS if r[0]], {1, 2, 3, 4, 5, 6}, 2),
    (texts(1, 300), set(range(0, 300, 3)), 7),
    ([*texts(2, 20), (7, "w1 w2 A " * 30_000)], {7, 8, 9}, 2),
])
def test_equals_the_definition(spark, rows, target, parts):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, score int, target string").repartition(parts)
    ids = spark.createDataFrame([(i,) for i in [*target, None, *target]], "doc_id bigint")
    got = lm.cross_entropy_difference(docs, ids)
    assert got.columns == ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
    got, want = got.collect(), by_definition(rows, target)
    flat = sorted(((str(r[0]), r[1], r[2], r[3]) for r in got), key=lambda r: (r[0], r[1], str(r[2])))
    want = sorted(want, key=lambda r: (r[0], r[1], str(r[2])))
    assert [r[:2] for r in flat] == [r[:2] for r in want]
    for a, b in zip(flat, want):
        assert a[2:] == (None, None) == b[2:] or a[2:] == pytest.approx(b[2:])
    assert all(r["score"] is None if r["n_tokens"] == 0 else math.isclose(r["score"], r[3] - r[2], abs_tol=1e-12) for r in got)


def test_ranges_and_chunks_of_any_size_give_the_same(spark):
    import pyarrow as pa

    rows = [r for r in texts(3, 200) if r[1]]
    grams = lm.Grams(pa.array([t for _, t in rows]))
    for bits in (0, 1, 5):
        ends = lm._range_ends(grams.keys, bits)
        assert ends[-1] == len(grams.keys) and len(ends) == 1 << bits and (ends[1:] >= ends[:-1]).all()
    assert grams.added().sum() == 2 * grams.counts.sum() + len(rows)


def test_empty_table_and_a_clear_preference(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, score int")
    assert lm.cross_entropy_difference(docs.limit(0), docs.select("doc_id")).count() == 0
    rows = [(i, "good words here " * 5, 0) for i in range(10)] + [(i, "bad things there " * 5, 0) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = lm.cross_entropy_difference(docs, docs.filter("doc_id < 5").select("doc_id")).collect()
    assert all((r["score"] > 0) == (r["doc_id"] < 5) for r in got if r["doc_id"] < 5 or r["doc_id"] >= 10)
