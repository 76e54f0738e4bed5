import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import UPPER

from rulelens.llm import collocations as own
from rulelens.llm.collocations import PARTITIONS, Summary, collocations, phrase_counts

SCHEMA = "doc_id bigint, text string, lang string, f bigint, phrase string, n string"


def counted(rows, longest):
    """`{(lang, words): count}` of all sequences."""
    found = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            ws = re.findall("[^ \t]+", piece)
            for size in range(1, longest + 1):
                for i in range(len(ws) - size + 1):
                    found[("und" if lang is None else lang), tuple(ws[i : i + size])] += 1
    return found


def expected(rows, least, longest, top):
    found = counted(rows, longest)
    n = Counter()
    for (lang, ws), f in found.items():
        n[lang] += f if len(ws) == 1 else 0
    able = {k: f for k, f in found.items() if len(k[1]) > 1 and f >= least}
    out = defaultdict(list)
    for (lang, ws), a in able.items():
        score, _, left, right = min(
            (1000 * a * n[lang] // (found[lang, ws[:k]] * found[lang, ws[k:]]), k, found[lang, ws[:k]], found[lang, ws[k:]])
            for k in range(1, len(ws))
        )
        inside = any(
            g >= a and lang == other and len(long) > len(ws) and any(long[i : i + len(ws)] == ws for i in range(len(long)))
            for (other, long), g in able.items()
        )
        if not inside:
            out[lang].append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def texts(seed, many):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "für", "x.y", "a b", "z", " ", "né", "w", "\U0001f600", "\x1c"]
    rows = [(None, "en"), ("", "en"), (" \t.,\n", None), ("one", "de")]
    for _ in range(many):
        some = rnd.sample(vocabulary, rnd.randint(2, 6))
        blank = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"]
        text = "".join(rnd.choice(some) + rnd.choice(blank) for _ in range(rnd.randint(1, 60)))
        rows.append((text, rnd.choice(["en", "en", "de", "", None, "und"])))
    return [*rows, rows[-1], rows[-1], ("one of the words " * 3000, "long")]


def frame(spark, rows, parts=3):
    docs = [(i, t, lang, i, "k", "k") for i, (t, lang) in enumerate(rows)]
    return spark.createDataFrame(docs, SCHEMA).repartition(parts)


@pytest.mark.parametrize("least, longest, top", [(5, 5, 2000), (3, 3, 7), (40, 4, 10), (1, 2, 50)])
def test_equals_the_definition(spark, least, longest, top):
    rows = texts(least, 150)
    got = collocations(frame(spark, rows), least, longest, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected(rows, least, longest, top)


def test_every_frequent_sequence_is_counted(spark, monkeypatch):
    monkeypatch.setattr(own, "RANGE_MASS", 500)
    rows = texts(9, 400)
    phrases, words = phrase_counts(frame(spark, rows, 6), 6, 4)
    found = counted(rows, 4)
    assert {(r["lang"], r["phrase"]): r["f"] for r in words.collect()} == {(k, ws[0]): f for (k, ws), f in found.items() if len(ws) == 1}
    want = {(lang, " ".join(ws)): f for (lang, ws), f in found.items() if len(ws) > 1 and f >= 6}
    assert {(r["lang"], r["phrase"]): r["f"] for r in phrases.collect()} == want


def test_merged_summaries_keep_the_frequent_and_cut_the_rest():
    rnd, least = np.random.default_rng(3), 50
    often = rnd.integers(0, 1 << 63, 40).astype(np.uint64)
    keys = np.concatenate([np.repeat(often, 60), rnd.integers(0, 1 << 63, 60_000).astype(np.uint64)])
    rnd.shuffle(keys)
    part = (keys >> np.uint64(64 - own.PARTITION_BITS)).astype(int)
    capacity = np.bincount(part, minlength=PARTITIONS) // least + 1
    total, cut, rows = Counter(), np.zeros(PARTITIONS, int), 0
    for block in np.array_split(keys, 7):
        summary = Summary(capacity)
        for at in range(0, len(block), 500):
            summary.add(block[at : at + 500])
            summary.settle()
            assert (np.bincount((summary.keys >> np.uint64(64 - own.PARTITION_BITS)).astype(int), minlength=PARTITIONS) <= capacity).all()
        for row in summary.rows().to_pylist():
            cut[row["part"]] += row["cut"]
            if row["key"] is not None:
                total[row["key"] % (1 << 64)] += row["n"]
                rows += 1
    assert (cut < least).all() and cut.any() and rows < len(keys) / 4
    for key in often.tolist():
        assert total[key] <= 60 <= total[key] + cut[key >> (64 - own.PARTITION_BITS)]


def test_rows_are_added_up_in_parts(monkeypatch):
    monkeypatch.setattr(own, "MAX_ROWS", 10)
    rnd = random.Random(1)
    want, batches = Counter(), []
    for _ in range(40):
        some = [(rnd.choice("ab"), str(rnd.randint(0, 30)), rnd.randint(1, 5)) for _ in range(9)]
        for lang, phrase, n in some:
            want[lang, phrase] += n
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some)], names=["lang", "phrase", "n"]))
    got = Counter()
    for batch in own._added_up(iter(batches), ["lang", "phrase"]):
        for row in batch.to_pylist():
            got[row["lang"], row["phrase"]] += row["n"]
    assert got == want and list(own._added_up(iter([]), ["lang"])) == []


def test_empty_tables_and_ties(spark):
    assert collocations(frame(spark, []), 2).count() == 0
    rows = [("b a. a b. c d", "en")] * 3
    got = [(r["phrase"], r["rank"]) for r in collocations(frame(spark, rows), 3).collect()]
    assert sorted(got) == [("a b", 2), ("b a", 3), ("c d", 1)]
