from datetime import datetime, timedelta
from pathlib import Path

import pytest

from rulelens.plans import generations
from rulelens.plans.generations import CacheStore
from rulelens.schemas import CACHE

NOW = datetime(2024, 5, 1)


def entries(spark, keys, hours=0):
    rows = [(f"f{k}", f"r{k % 3}", [], NOW + timedelta(hours=hours)) for k in keys]
    return spark.createDataFrame(rows, CACHE)


def content(df):
    return sorted((r["file_hash"], r["created_at"]) for r in df.collect())


def size_of(folder):
    return sum(len(list(p.glob("*.parquet"))) for p in Path(folder).glob("data/*/part=*"))


def test_puts_reads_and_rewrites(spark, tmp_path, monkeypatch):
    store = CacheStore(spark, str(tmp_path / "cache"), 8)
    assert store.read().count() == 0 and store.version() == 0
    store.put(entries(spark, range(200)))
    before = {row["generation"] for row in store.manifest()}
    store.put(entries(spark, [3, 500], 5))
    assert store.version() == 2 and before < {row["generation"] for row in store.manifest()}
    written = {row["part"]: row["rows"] for row in store.manifest() if row["generation"] not in before}
    assert sum(written.values()) == 2  # a small put writes little
    want = {f"f{k}": NOW for k in range(200)} | {"f3": NOW + timedelta(hours=5), "f500": NOW + timedelta(hours=5)}
    assert content(store.read()) == sorted(want.items())
    some = entries(spark, [3, 7, 999])
    assert content(store.read(some)) == [("f3", NOW + timedelta(hours=5)), ("f7", NOW)]
    monkeypatch.setattr(generations, "MAX_GENERATIONS", 2)
    for step in range(3):
        store.put(entries(spark, [3], 6 + step))
    assert len([row for row in store.manifest() if row["part"] in written]) <= 3 * len(written)
    assert dict(content(store.read()))["f3"] == NOW + timedelta(hours=8) and store.read().count() == 201
    store.put(spark.createDataFrame([], CACHE))
    assert store.read().count() == 201


def test_expiry_and_vacuum(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "cache"), 4)
    store.put(entries(spark, range(20)))
    store.put(entries(spark, range(20, 30), 100))
    store.expire(NOW + timedelta(hours=150), 100)
    assert [k for k, _ in content(store.read())] == sorted(f"f{k}" for k in range(20, 30))
    generations_before = len(list((tmp_path / "cache/data").iterdir()))
    store.vacuum()
    assert len(list((tmp_path / "cache/data").iterdir())) < generations_before
    assert store.read().count() == 10 and len(list((tmp_path / "cache/manifest").iterdir())) == 1


def test_a_run_that_dies_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    store = CacheStore(spark, str(tmp_path / "cache"), 4)
    store.put(entries(spark, range(10)))
    before = content(store.read())

    def die(rows, version):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_commit", die)
    with pytest.raises(RuntimeError):
        store.put(entries(spark, range(50), 1))
    monkeypatch.undo()
    assert content(store.read()) == before and store.version() == 1
    (tmp_path / "cache/manifest/version=2").mkdir()  # begun, never finished
    assert store.version() == 1 and content(store.read()) == before
    files = size_of(tmp_path / "cache")
    store.vacuum()
    assert size_of(tmp_path / "cache") < files and content(store.read()) == before
