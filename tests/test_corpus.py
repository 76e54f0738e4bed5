import random
from fnmatch import fnmatch
from pathlib import PurePosixPath

import pytest

from rulelens.plans.storage import materialize
from rulelens.sources import corpus as sources
from rulelens.sources.corpus import corpus_scan, drop_ignored, exclude_paths, include_paths
from rulelens.sources.files import list_tree, read_text_files, with_corpus_defaults, write_text_files


@pytest.fixture
def tree(tmp_path):
    files = {
        "a.py": b"x = 1\r\ny = 2\r",
        "pkg/__init__.py": b"",
        "pkg/_private/deep/m.py": "é".encode(),
        "pkg/bad.py": b"\xff\xfe",
        "pkg/notes.txt": b"n",
        ".hidden/h.py": b"h",
        "pkg/__pycache__/c.py": b"c",
        "venv/v.py": b"v",
        "node_modules/n.py": b"n",
        "pkg/.dot.py": b"d",
    }
    for name, data in files.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    return tmp_path


def rows(df):
    return {r["path"]: r["content"] for r in df.collect()}


def test_scan_reads_text_and_skips_the_rest(spark, tree):
    got = rows(corpus_scan(spark, str(tree)))
    assert got == {"a.py": "x = 1\ny = 2\n", "pkg/__init__.py": "", "pkg/_private/deep/m.py": "é"}
    assert set(rows(corpus_scan(spark, str(tree), "*.txt"))) == {"pkg/notes.txt"}


def test_scan_of_file_missing_path_and_empty_folder(spark, tree, tmp_path):
    assert rows(corpus_scan(spark, str(tree / "pkg/notes.txt"))) == {"notes.txt": "n"}
    assert corpus_scan(spark, str(tree / "absent")).count() == 0
    (tmp_path / "empty").mkdir()
    assert corpus_scan(spark, str(tmp_path / "empty")).count() == 0


def test_defaults(corpus):
    row = with_corpus_defaults(corpus([("p", "c")])).first()
    assert row.asDict() == {"path": "p", "content": "c", "is_new": False, "hunks": []}


def test_ignored_components(corpus):
    kept = ["a/b.py", "./a.py", "../a.py", "venv2/x", "a/venv.py", "x"]
    gone = [".git/x", "a/.b/c", "venv/x", "a/__pycache__/x", "node_modules/x", "a/.venv/x", ".x", ".../x"]
    df = corpus([(p, "") for p in kept + gone])
    assert sorted(rows(drop_ignored(df))) == sorted(kept)


def excluded(path, globs):
    """Any component, the path itself, or any parent up to the root matches any glob."""
    pure = PurePosixPath(path)
    names = [*pure.parts, str(pure), *map(str, pure.parents)]
    return any(fnmatch(n, g) for n in names for g in globs)


def test_excludes_equal_plain_python(corpus):
    rng = random.Random(4)
    names = ["tests", "test", "fixtures", "a.py", "b_test.py", "migrations", "x"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(200)})
    df = corpus([(p, "") for p in paths])
    for globs in (["migrations"], ["*_test.py"], ["tests/fixtures"], ["test*", "x"], ["tests/*/x"], ["?"], ["*"], ["[a-m]*"]):
        wanted = [p for p in paths if not excluded(p, globs)]
        assert sorted(rows(exclude_paths(df, globs))) == wanted, globs
    assert exclude_paths(df, []).count() == len(paths)


def test_exclude_relative_to_base(corpus):
    df = corpus([("/repo/tests/fixtures/a", ""), ("/repo/src/a", ""), ("/tests/fixtures/a", "")])
    assert sorted(rows(exclude_paths(df, ["tests/fixtures"], base="/repo"))) == ["/repo/src/a", "/tests/fixtures/a"]


def test_includes(corpus):
    df = corpus([("src/a", ""), ("src2/a", ""), ("lib", ""), ("lib/b/c", "")])
    assert sorted(rows(include_paths(df, ["src/", "./lib"]))) == ["lib", "lib/b/c", "src/a"]
    assert include_paths(df, None).count() == include_paths(df, ["."]).count() == 4


def test_a_flat_folder_of_many_files_and_a_deep_one(spark, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(5000):
        (flat / f"{i}.py").touch()
    deep = flat.joinpath(*"abcdef")
    deep.mkdir(parents=True)
    (deep / "last.py").write_text("end")
    (tmp_path / "flat/a/.git").mkdir()
    (tmp_path / "flat/a/.git/x.py").write_text("no")
    levels = list_tree(spark, f"file://{flat}", str(flat))
    assert [level.count() for level in levels] == [5001, 1, 1, 1, 1, 1, 1]
    read = read_text_files(spark, str(flat))
    assert read.count() == 5001 and read.filter("path = 'a/b/c/d/e/f/last.py'").first()["content"] == "end"


def test_written_files_are_read_back(spark, tmp_path):
    data = [("a/b.py", "x\r\ny"), ("_u.py", ""), ("c.py", "one"), ("c.py", "two"), (None, "n"), ("d.py", None), ("e.txt", "t")]
    frame = spark.createDataFrame(data, "path string, content string")
    assert write_text_files(frame, str(tmp_path / "out")) == 4
    assert rows(read_text_files(spark, str(tmp_path / "out"))) == {"a/b.py": "x\ny", "_u.py": "", "c.py": "two"}
    assert write_text_files(frame.limit(0), str(tmp_path / "none")) == 0


def test_small_inputs_are_moved_in_parts_of_bounded_size(spark, corpus, monkeypatch):
    rows = materialize(corpus([(f"{i}.py", f"{i} x") for i in range(200)]), "rows")
    assert sources.spread_small(rows, "path").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(sources, "SPREAD_BYTES", 50)
    spread = sources.spread_small(rows, "path")
    assert spread.rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism
    assert sorted(spread.collect()) == sorted(rows.collect())
