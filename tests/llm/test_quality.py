import random

from brute import repeat_words, words

from rulelens.llm.quality import STOP_WORDS, keep_good, quality_rules


def judged(text):
    ws, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    n, stops = len(ws), sum(w.lower().rstrip(".,;:") in STOP_WORDS for w in ws)
    chars, symbols, repeats = sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), repeat_words(ws)
    base = n < 20 or 100 * repeats > 30 * n
    bad = not 2 * n <= chars <= 15 * n or 10 * symbols > n or 100 * stops < 3 * n
    bad = bad or 2 * (len(lines) - len(set(lines))) > len(lines)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, base, not base and not bad


def rows():
    rnd = random.Random(5)
    vocabulary = ["the", "of", "Für", "que", "word", "wörd", "a#b", "$", "|", "long" * 5, "x"]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "the " * 40), (4, " nbsp word")]
    for i in range(5, 80):
        size, few = rnd.randint(1, 120), rnd.sample(vocabulary, rnd.randint(2, 11))
        out.append((i, "".join(rnd.choice(few) + rnd.choice([" ", " ", "\n", "\t ", ".\n"]) for _ in range(size))))
    return out + [out[-1], (None, out[-1][1]), (99, "the word of many readers is here " * 3000)]


def test_counts_and_verdicts(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string")
    got = quality_rules(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=key) == sorted(((i, *judged(t)) for i, t in rows()), key=key)
    assert {r["kept"] for r in got} == {True, False} and all(bool(r["failed"]) != r["kept"] for r in got)


def test_keep_good_keeps_columns_and_takes_filters(spark):
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in rows()], "doc_id bigint, text string, n_words bigint, _row string")
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(str((i, t, i, "k")) for i, t in rows() if judged(t)[-1])
    assert keep_good(docs.limit(0)).count() == 0
    assert quality_rules(docs).filter("kept and n_words > 30").count() == sum(judged(t)[-1] and judged(t)[0] > 30 for _, t in rows())
