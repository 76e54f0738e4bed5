import random

import pyarrow as pa
import pytest
from helpers import finding, findings_df

from rulelens.functions.linediff import changes, common_lines, hunks
from rulelens.sources.diffs import _diffs, diff_hunks, on_changed_lines, renamed_rows


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return table[-1][-1]


def rebuilt(old, new, found):
    """The new text from the old one and the changed lines."""
    out, at = [], 0
    for i, i_end, j, j_end in found:
        out += old[at:i] + new[j:j_end]
        at = i_end
    return out + old[at:]


@pytest.mark.parametrize("seed", range(4))
def test_changes_are_fewest_and_rebuild_the_text(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        old, new = (rnd.choices("abcdefgh"[: rnd.randint(1, 8)], k=rnd.randint(0, 14)) for _ in range(2))
        found = changes(old, new)
        assert rebuilt(old, new, found) == new
        touched = sum(i_end - i + j_end - j for i, i_end, j, j_end in found)
        assert touched == len(old) + len(new) - 2 * longest(old, new)
        for exact in (0, 9):  # cut at unique lines first: still right, if not always shortest
            pairs = common_lines(old, new, exact)
            assert all(old[i] == new[j] for i, j in pairs) and pairs == sorted(set(pairs))
            assert all(x < y and p < q for (x, p), (y, q) in zip(pairs, pairs[1:]))
            assert rebuilt(old, new, changes(old, new, exact)) == new


def test_removed_and_added_lines_stand_together():
    assert changes(list("avvvz"), list("aEvvz")) == [(1, 2, 1, 2)]
    assert changes(list("avvvz"), list("avvEz")) == [(3, 4, 3, 4)]
    assert changes(list("abab"), list("abXab")) == [(2, 2, 2, 3)]


def test_hunks_join_when_their_context_meets():
    assert hunks([(5, 6, 5, 6), (12, 13, 12, 13)], 30) == [(2, 16, [(5, 6, 5, 6), (12, 13, 12, 13)])]
    assert [h[:2] for h in hunks([(5, 6, 5, 6), (13, 14, 13, 14)], 30)] == [(2, 9), (10, 17)]
    assert hunks([(0, 2, 0, 0)], 0) == [(0, 0, [(0, 2, 0, 0)])]


def test_long_texts(corpus):
    old = [f"line {i}" for i in range(100_000)]
    new = list(old)
    new[50_000] = "other"
    new[10:10] = ["more", "lines"]
    del new[99_000]
    row = diff_hunks(corpus([("p", "\n".join(old))]), corpus([("p", "\n".join(new))])).first()
    assert [(s["first_line"], s["last_line"]) for s in row["changed"]] == [(11, 12), (50_003, 50_003), (99_001, 99_000)]
    assert len(row["hunks"]) == 3 and row["hunks"][0]["content"].split("\n")[3:5] == ["more", "lines"]


def test_diff_hunks_of_snapshots(corpus):
    old = corpus([("same", "a\nb"), ("blank", "a  \nb\n"), ("edit", "1\n2\n3\n4\n5\n6"), ("gone", "x"), ("cut", "1\n2\n3"), (None, "n")])
    new = corpus([("same", "a\nb"), ("blank", "a\nb"), ("edit", "1\n2\n3\n4\nX\n6"), ("new", "p\nq\n"), ("cut", "1\n3"), ("void", ""), (None, "m")])
    got = {r["path"]: r for r in diff_hunks(old, new).filter("path is not null").collect()}
    assert set(got) == {"edit", "new", "cut", "void"}
    assert [tuple(h) for h in got["edit"]["hunks"]] == [(2, 6, "2\n3\n4\nX\n6", "")] and not got["edit"]["is_new"]
    assert [tuple(h) for h in got["new"]["hunks"]] == [(1, 2, "p\nq", "")] and got["new"]["is_new"]
    assert [tuple(s) for s in got["cut"]["changed"]] == [(2, 1)] and [tuple(h) for h in got["cut"]["hunks"]] == [(1, 2, "1\n3", "")]
    assert got["void"]["hunks"] == []
    assert diff_hunks(old.limit(0), new.limit(0)).count() == 0
    assert [r["path"] for r in diff_hunks(old, new, globs=["e*"]).collect()] == ["edit"]


def test_findings_on_changed_lines(spark, corpus):
    diffs = diff_hunks(corpus([("p", "1\n2\n3\n4")]), corpus([("p", "1\nX\n3\n4"), ("q", "new")]))
    rows = [finding(path="p", line=2), finding(path="p", line=3), finding(path="p", line=1, end=3), finding(path="q", line=1), finding(path="r")]
    got = on_changed_lines(findings_df(spark, rows), diffs).collect()
    assert sorted((r["path"], r["start_line"]) for r in got) == [("p", 1), ("p", 2), ("q", 1)]


def test_renamed_rows(corpus):
    body = "\n".join(f"line {i}" for i in range(10))
    old = corpus([("a", body), ("b", "same"), ("c", "same"), ("d", "same"), ("e", "one\ntwo\nthree"), ("f", "quite\nother"), ("stay", "s")])
    new = corpus([("x/a", body + "\nmore"), ("x/b", "same"), ("x/c", "same "), ("x/e", "one\nother words"), ("x/f", "nothing\nalike"), ("stay", "t")])
    got = sorted(tuple(r) for r in renamed_rows(old, new).collect())
    assert got == [("a", "x/a", 100), ("b", "x/b", 100), ("c", "x/c", 100), ("e", "x/e", 50)]
    assert sorted(r["path"] for r in renamed_rows(old, new, globs=["x/a"]).collect()) == ["x/a"]
    assert renamed_rows(old, old).count() == 0


def test_many_equal_texts_are_paired_one_to_one(corpus):
    old, new = (corpus([(f"{side}/{i:03d}", "") for i in range(n)]) for side, n in (("o", 70), ("n", 50)))
    got = sorted((r["old_path"], r["path"]) for r in renamed_rows(old, new).collect())
    assert got == [(f"o/{i:03d}", f"n/{i:03d}") for i in range(50)]


def test_results_leave_a_task_in_pieces():
    rows = [(f"{i}.py", i == 2, None if i == 2 else ["a", "b"], ["a", "c" * 9, f"{i}"]) for i in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], ["path", "is_new", "before", "after"])
    whole, pieces = (list(_diffs(1, together)([batch])) for together in (1 << 20, 12))
    assert [b.num_rows for b in whole] == [5] and [b.num_rows for b in pieces] == [1] * 5
    got = [row for b in pieces for row in b.to_pylist()]
    assert got == whole[0].to_pylist() and [row["path"] for row in got] == [row[0] for row in rows]
    assert got[0]["changed"] == [{"first_line": 2, "last_line": 3}]
    assert got[2]["hunks"] == [{"start_line": 1, "end_line": 3, "content": "a\nccccccccc\n2", "header": ""}]
