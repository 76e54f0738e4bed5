from datetime import datetime, timedelta

from helpers import finding, findings_df
from pyspark.sql import functions as F

from rulelens.functions.findings import cached_form
from rulelens.operators.cache import (
    cache_clear,
    cache_lookup,
    cache_misses,
    cache_put,
    cache_stats,
    exact_duplicates,
    fresh_entries,
    latest_entries,
    triage,
    with_cache_key,
    write_cache,
    write_cache_table,
)
from rulelens.plans.storage import run_dir
from rulelens.schemas import CACHE

NOW = datetime(2024, 5, 1)


def entries(spark, rows):
    """Cache entries from `(file_hash, rules_hash, hours old, title)`."""
    whole = [(f, r, NOW - timedelta(hours=h), *finding(title=t)) for f, r, h, t in rows]
    found = findings_df(spark, [w[3:] for w in whole]).select("title", F.struct("*").alias("s"))
    keys = spark.createDataFrame([(w[0], w[1], w[2], w[3:][8]) for w in whole], "file_hash string, rules_hash string, created_at timestamp, title string")
    return keys.join(found, "title").withColumn("findings", F.array(cached_form(F.col("s")))).select(CACHE.fieldNames())


def titles(df):
    return sorted(r["findings"][0]["title"] for r in df.collect())


def keyed(spark, rows):
    return spark.createDataFrame(rows, "path string, file_hash string, rules_hash string, rule_ids array<string>")


def test_ttl_edge_is_neither_fresh_nor_cleared(spark):
    cache = entries(spark, [("a", "r", 167, "young"), ("b", "r", 168, "edge"), ("c", "r", 169, "old")])
    assert titles(fresh_entries(cache, NOW)) == ["young"]
    kept, gone = cache_clear(cache, NOW, 168)
    assert titles(kept) == ["edge", "young"] and titles(gone) == ["old"]
    everything = cache_clear(cache, NOW)
    assert everything[0].count() == 0 and everything[1].count() == 3


def test_put_replaces_and_inserts(spark):
    old = entries(spark, [("a", "r", 1, "old"), ("b", "r", 1, "kept")])
    new = entries(spark, [("a", "r", 5, "new"), ("a", "s", 5, "other")])
    assert titles(cache_put(old, new)) == ["kept", "new", "other"]


def test_latest_entry_per_key(spark):
    assert titles(latest_entries(entries(spark, [("a", "r", 3, "x"), ("a", "r", 1, "y"), ("a", "r", 2, "z")]))) == ["y"]


def test_triage_and_lookup(spark):
    rows = [("hit", "a", "r", ["x"]), ("other rules", "a", "s", ["x"]), ("other text", "b", "r", ["x"]), ("none", "a", "r", []), ("stale", "c", "r", ["x"])]
    cache = entries(spark, [("a", "r", 1, "t"), ("a", "r", 2, "older"), ("c", "r", 500, "s")])
    got = {r["path"]: r["status"] for r in triage(keyed(spark, rows), cache, NOW).collect()}
    assert got == {"hit": "cached", "other rules": "analyze", "other text": "analyze", "none": "skip", "stale": "analyze"}
    hits = cache_lookup(keyed(spark, rows), cache, NOW).collect()
    assert [(r["path"], r["findings"][0]["title"]) for r in hits] == [("hit", "t")]
    assert {r["path"] for r in cache_misses(keyed(spark, rows), cache, NOW).collect()} == {"other rules", "other text", "stale"}
    assert {r["status"] for r in triage(keyed(spark, rows)).collect()} == {"analyze", "skip"}


def test_keys(corpus):
    rows = corpus([("a", "x \n"), ("b", "x"), ("c", " x")]).withColumn("rule_ids", F.array(F.lit("r")))
    got = {r["path"]: (r["file_hash"], r["rules_hash"]) for r in with_cache_key(rows).collect()}
    assert got["a"] == got["b"] != got["c"]
    salted = {r["path"]: r["rules_hash"] for r in with_cache_key(rows, "v2").collect()}
    assert salted["a"] != got["a"][1]


def test_duplicates(corpus):
    got = [tuple(r)[1:] for r in exact_duplicates(corpus([("b", "x"), ("a", "x  "), ("c", "y")])).collect()]
    assert got == [(2, "a")]


def test_stats_and_storage(spark):
    cache = entries(spark, [("a", "r", 3, "x"), ("b", "r", 1, "y")])
    row = cache_stats(cache).first()
    assert row["entries"] == 2 and row["oldest_entry"] == NOW - timedelta(hours=3) and row["newest_entry"] == NOW - timedelta(hours=1)
    assert row["size_bytes"] > 100
    assert cache_stats(cache.limit(0)).first()["size_bytes"] == 0
    folder = run_dir(spark, "cache")
    write_cache(cache, folder)
    assert titles(spark.read.parquet(folder)) == ["x", "y"]


def test_bucketed_table_joins_without_shuffling_the_cache(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS verdicts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_cache_table(entries(spark, [("a", "r", 3, "x")]), "verdicts", 4)
        rows = keyed(spark, [("p", "a", "r", ["x"])])
        joined = rows.join(spark.table("verdicts"), ["file_hash", "rules_hash"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS verdicts")
