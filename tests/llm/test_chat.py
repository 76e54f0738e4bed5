from pathlib import Path

import pytest

from rulelens.llm.chat import preference_format, swapped_answers
from rulelens.llm.queries import QUERIES

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "bad"),
    (3, 0, "system", None), (3, 1, "user", "q"), (4, 0, "system", None), (4, 1, "user", "q"), (4, 2, "assistant", "é\n"),
    (5, 0, "user", "alone"), (None, 0, "user", "lost"), (7, None, None, "x"), (8, 0, "user", "hi"), (8, 0, "user", "hi"),
]
PAIRS = [("p", 1, 2), ("q", 3, 4), ("r", 4, 3), ("s", 5, 6), ("t", 7, 7), ("u", 8, 1), ("v", 98, 99)]


def plain(turns):
    return "".join(f"<|{role or ''}|>\n{text or ''}<|end|>\n" for _, role, text in turns)


def test_prefix_and_masks(spark):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, prompt string")
    pairs = spark.createDataFrame(PAIRS, "pair_id string, chosen bigint, rejected bigint")
    got = {r["pair_id"]: r for r in preference_format(turns, pairs).collect()}
    assert set(got) == set("pqrstu")
    for pair, chosen, rejected in PAIRS[:-1]:
        a, b = (sorted((t[1:] for t in TURNS if t[0] == c), key=str) for c in (chosen, rejected))
        n = next((i for i, x in enumerate(a) if i >= len(b) or x[1:] != b[i][1:]), len(a))
        r = got[pair]
        assert (r["n_prompt_turns"], r["prompt"]) == (n, plain(a[:n]))
        assert (r["chosen"], r["rejected"]) == (plain(a[n:]), plain(b[n:]))
        for side, turns_left in (("chosen", a[n:]), ("rejected", b[n:])):
            marked = [r[side][s["start"] : s["start"] + s["length"]] for s in r[f"{side}_spans"]]
            assert marked == [f"{text or ''}<|end|>\n" for _, role, text in turns_left if role == "assistant"]
    assert preference_format(turns.limit(0), pairs).count() == 0 == preference_format(turns, pairs.limit(0)).count()


def test_swapped_answers(spark):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, pair_id string")
    pairs = spark.createDataFrame([(10, 1, 2), (11, 3, 4), (12, 4, 1), (13, None, 1)], "pair_id bigint, chosen bigint, other bigint")
    got = {r["pair_id"]: r for r in preference_format(*swapped_answers(turns, pairs)).collect()}
    assert set(got) == {10, 12}
    a = [t[1:] for t in TURNS if t[0] == 1]
    assert (got[10]["n_prompt_turns"], got[10]["prompt"], got[10]["chosen"]) == (3, plain(a[:3]), plain(a[3:]))
    assert got[10]["rejected"] == plain([(3, "assistant", "bad")]) and got[12]["rejected"] == plain([(2, "assistant", "yes")])
    assert preference_format(*swapped_answers(turns.limit(0), pairs)).count() == 0


def test_a_long_text_and_a_long_conversation(spark):
    long = [(1, i, "user" if i % 2 == 0 else "assistant", "word " * 20_000 if i == 3 else "w") for i in range(400)]
    other = [(2, i, role, text) for _, i, role, text in long[:-1]] + [(2, 399, "assistant", "else")]
    turns = spark.createDataFrame(long + other, "conv_id bigint, turn bigint, role string, text string")
    row = preference_format(turns, spark.createDataFrame([(1, 1, 2)], "pair_id bigint, chosen bigint, rejected bigint")).first()
    assert row["n_prompt_turns"] == 399 and row["rejected"] == plain([(399, "assistant", "else")])


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the given tables")
def test_given_pairs_share_a_prompt(spark):
    rows = QUERIES["op3_chat_formatting"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["n_prompt_turns"] > 0 and r["prompt"] and r["chosen_mask"] and r["rejected_mask"] for r in rows)
