import pytest
from pyspark.sql import functions as F

from rulelens.plans.joins import keep_listed, lookup_join, semi_by_key
from rulelens.plans.storage import materialize, shared_dir
from rulelens.plans.topn import first_n


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_is_exact_for_hot_keys(spark, how):
    # A third of all rows has one key, which is split over tasks.
    left = spark.range(3000).select(
        F.col("id").cast("string").alias("path"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k")
    )
    right = spark.range(-1, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup_join(left, right, ["k"], how, rows_per_task=100)
    wanted = left.join(right, "k", how)
    assert got.count() == wanted.count() and got.select(wanted.columns).exceptAll(wanted).count() == 0


def test_hot_key_is_spread(spark):
    left = spark.range(1000).select(F.col("id").cast("string").alias("path"), F.lit(1).alias("k"))
    right = spark.range(1, 2).select(F.col("id").cast("int").alias("k"), F.lit("v").alias("v"))
    for name, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(name, value)
    try:
        joined = lookup_join(left, right, ["k"], "left", rows_per_task=10)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and max(s["count"] for s in sizes) < 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("n", [0, 1, 7, 333, 999, 1000, 5000])
def test_first_n_by_ranges(spark, n):
    df = spark.range(1000).select(F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("path"), "id")
    wanted = [r["id"] for r in df.orderBy("path", "id").limit(n).collect()]
    assert sorted(r["id"] for r in first_n(df, n, ["path", "id"], small_n=0).collect()) == sorted(wanted)
    assert sorted(r["id"] for r in first_n(df, n, ["path", "id"]).collect()) == sorted(wanted)


def test_lists_are_broadcast_only_when_short(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big, keys = spark.range(100), spark.range(10)
        for how, size in (("left_semi", 10), ("left_anti", 90)):
            for limit, word in ((10, "BroadcastHashJoin"), (9, "SortMergeJoin")):
                got = semi_by_key(big, keys, ["id"], how, max_rows=limit)
                assert got.count() == size and word in got._jdf.queryExecution().executedPlan().toString()
        assert keep_listed(big, keys, ["id"]).count() == 10 and keep_listed(big, keys, ["id"], 9).count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_go_to_the_shared_folder(spark):
    folder = shared_dir(spark)
    assert folder == spark.sparkContext.getCheckpointDir()
    stored = materialize(spark.range(3), "three")
    assert stored.count() == 3 and all(f.replace("file:///", "file:/").startswith(folder) for f in stored.inputFiles())
