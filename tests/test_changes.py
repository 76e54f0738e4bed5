from queries.changes import edited
from rulelens.plans.storage import run_dir
from rulelens.sources.changes import changed_rows, mark_new, parse_hunks

PATCH = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,5 +1,5 @@ def f():
 keep
-gone
+new
+++lost
--- lost too

 kept again
@@ -9 +11 @@
+one
@@ -20,2 +21,0 @@   spaced
-x
\\ No newline at end of file"""


def test_hunks(spark):
    df = spark.createDataFrame([("m.py", PATCH), ("none", "no hunks"), ("empty", "")], "path string, patch string")
    got = [tuple(r) for r in parse_hunks(df).orderBy("hunk_no").collect()]
    assert got == [
        ("m.py", 1, 1, 5, "keep\nnew\n++lost\n\nkept again", "def f():"),
        ("m.py", 2, 11, 11, "one", ""),
        ("m.py", 3, 21, 20, "", "spaced"),
    ]


def test_hunk_headers_must_start_a_line(spark):
    text = "@@ -1 +1,2 @@\n+a @@ -5 +5 @@ b\n @@ -6 +6 @@"
    df = spark.createDataFrame([("p", text)], "path string, patch string")
    assert [tuple(r) for r in parse_hunks(df).collect()] == [("p", 1, 1, 2, "a @@ -5 +5 @@ b\n@@ -6 +6 @@".replace("\n@@", "\n@@"), "")]


def test_changes(corpus):
    old = corpus([("same", "a"), ("blank", "a"), ("edit", "a"), ("gone", "a"), ("x/skip", "a"), ("indent", "a")])
    new = corpus([("same", "a"), ("blank", "a  \n\n"), ("edit", "b"), ("add", "a"), ("x/skip", "b"), ("indent", " a")])
    got = sorted(tuple(r) for r in changed_rows(old, new, exclude=["x"], keep_removed=True).collect())
    assert got == [("add", "added", True), ("edit", "modified", False), ("gone", "removed", False), ("indent", "modified", False)]
    assert changed_rows(new, new).count() == 0
    assert [r["path"] for r in changed_rows(old, new, globs=["a*"]).collect()] == ["add"]


def test_mark_new(corpus):
    got = mark_new(corpus([("a", ""), ("b", "")]), corpus([("a", "x"), ("a", "y")])).collect()
    assert {r["path"]: r["is_new"] for r in got} == {"a": False, "b": True}


def test_edited_texts_are_split_once(spark):
    home = run_dir(spark, "edited")
    rows = [(i, "src0", "en", f"a{i}\nb\nc\n" if i % 2 else f"a{i}\nb") for i in range(1, 14)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{home}/documents.parquet")
    later = edited(spark, home)
    assert later._jdf.queryExecution().optimizedPlan().toString().count("split(regexp_replace(") == 1
    got = {r["path"].removeprefix("src0/en/"): r["content"] for r in later.collect()}
    assert len(got) == 13 and "11.txt" not in got and got["new-13.txt"] == got["13.txt"] == "a13\nb\nc\n"
    assert got["3.txt"] == "a3 edited 3\nb\nc" and got["6.txt"] == "a6 edited 6\nb\nadded 6" and got["1.txt"] == "a1\nb\nc\n"
