import random
from collections import Counter
from itertools import permutations

from brute import words

from rulelens.llm.audit import COUNTS, filter_audit

SCHEMA = "doc_id bigint, text string, source string, mask int, n bigint, quality int, id string"


def failing(rows):
    out = []
    for doc, text, _ in rows:
        text = text or ""
        ws = words(text)
        bad = {"A"} if len(ws) < 50 else set()
        bad |= {"B"} if 100 * len(set(ws)) < 65 * len(ws) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        bad |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows):
            bad.add("E")
        out.append(bad)
    return out


def expected(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, bad = {}, failing(rows)
    parts = {source or "" for _, _, source in rows}
    shapley = Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            mine = [(doc, b) for (doc, _, source), b in zip(rows, bad) if (source or "") == part]
            left = list(mine)
            for step, f in enumerate(order, 1):
                hit = [(d, b) for d, b in left if f in b]
                left = [(d, b) for d, b in left if f not in b]
                shapley[part, f] += len(hit)
                out[part, order, step] = [
                    len(left), len(hit), sum(f in b for _, b in mine) - len(hit), sum(b == {f} for _, b in mine),
                    sum(d in good for d, _ in hit), sum(d in toxic for d, _ in hit),
                ]
    for (part, order, step), row in out.items():
        row.append(shapley[part, order[step - 1]])
    return out


def test_equals_the_definition(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(90)] + ["The", "X", "é", " "]
    rows = [(0, None, "a"), (1, "", "a"), (2, None, None), (None, "", "b"), (None, "x", "b"), (4, "x", ""), (4, "x", ""), (4, "x", "b")]
    for i in range(5, 120):
        few = rnd.sample(vocabulary, rnd.choice([20, 60, 94]))
        text = "".join(rnd.choice(few) + rnd.choice([" "] * 40 + ["\n", "\t", " # ", " SHOUT "]) for _ in range(rnd.choice([5, 48, 60, 80])))
        rows += [(rnd.randint(5, 200), text, rnd.choice(["a", "b", "", None]))] * rnd.choice([1, 1, 1, 2])
        if i % 9 == 0:
            rows.append((i * 3 % 50, text, "c"))
    rows.append((500, "word " * 50_000, "long"))
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 200, 2)] + [(6, 1, 1), (None, 1, 1), (7, None, 1)]
    docs = spark.createDataFrame([(*r, 1, 1, 1, "k") for r in rows], SCHEMA)
    table = spark.createDataFrame([(*r, "k", 3) for r in labels], "doc_id bigint, quality int, toxic int, source string, n int")
    got = filter_audit(docs, table).collect()
    want = expected(rows, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in got} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, 0, 0, 0, "")], SCHEMA)
    got = filter_audit(one, labels).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and sum(r["removed"] for r in got) == 120
