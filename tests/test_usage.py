from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rulelens.functions.models import model_name, model_provider
from rulelens.operators.usage import (
    append_totals,
    append_usage,
    conform_log,
    cost_by_model,
    cost_summary,
    cost_summary_kept,
    find_call,
    price_calls,
    price_table,
    recent_calls,
    usage_rows,
)
from rulelens.plans.storage import run_dir
from rulelens.schemas import USAGE

NOW = datetime(2024, 5, 31)


def log(spark, rows):
    """Rows of `(id, days old, model, prompt tokens, completion tokens, cost, findings)`."""
    full = [
        (i, NOW - timedelta(days=d), m, "p", ["f", "g"], p, c, p + c, cost, 5, n, False) for i, d, m, p, c, cost, n in rows
    ]
    return spark.createDataFrame(full, USAGE)


def test_summary(spark):
    df = log(spark, [("a", 1, "m", 1000, 500, 0.01, 3), ("b", 2, "m", 800, 400, 0.008, 2), ("edge", 30, "m", 1, 1, 1.0, 1)])
    row = cost_summary(df, NOW).first()
    assert (row["total_calls"], row["total_tokens"], row["total_issues"]) == (2, 2700, 5)
    assert abs(row["total_cost"] - 0.018) < 1e-12 and abs(row["avg_cost_per_call"] - 0.009) < 1e-12
    assert set(cost_summary(df.limit(0), NOW).first()) == {0, 0.0}


def test_cube(spark):
    df = log(spark, [("a", 1, "X/m", 1, 0, 0.5, 0), ("b", 1, "x/m", 1, 0, 0.25, 0), ("c", 2, "m", 1, 0, 1.0, 0)])
    got = {(r["provider"], r["model_name"], r["grouping"]): r["total_cost"] for r in cost_by_model(df).filter("grouping > 0").collect()}
    assert got[("x", None, 3)] == 0.75 and got[(None, "m", 5)] == 1.75 and got[(None, None, 7)] == 1.75


def test_model_names(spark):
    df = spark.createDataFrame([("A/b/c",), ("plain",), ("/x",)], "m string")
    got = [tuple(r) for r in df.select(model_provider(F.col("m")), model_name(F.col("m"))).collect()]
    assert got == [("a", "b/c"), ("openai", "plain"), ("", "x")]


def test_recent_and_find(spark):
    df = log(spark, [(f"{c}{'0' * 10}", d, "m", 1, 1, 0.0, 0) for c, d in zip("abcab", range(5))])
    assert [(r["id"], r["files"]) for r in recent_calls(df, 2).collect()] == [("a0000000", 2), ("b0000000", 2)]
    assert recent_calls(df).first()["timestamp"] == "2024-05-31 00:00:00"
    assert find_call(df, "b").first()["id"].startswith("b") and find_call(df, "_").count() == find_call(df, "%").count() == 0


def test_rows_are_priced_and_stable(spark):
    calls = spark.createDataFrame([("p", 10, 4, 7, 2)], "path string, prompt_tokens int, completion_tokens int, duration_ms int, issues_found int")
    prices = {"m": (0.5, 0.25)}
    one = usage_rows(calls, "r", NOW, "m", "k", prices).first()
    assert one["cost_usd"] == 6.0 and one["total_tokens"] == 14 and one["files"] == ["p"] and not one["cached"]
    assert usage_rows(calls, "r", NOW, "m", "k", prices).first()["id"] == one["id"]
    assert usage_rows(calls, "r2", NOW, "m", "k", prices).first()["id"] != one["id"]
    assert usage_rows(calls, "r", NOW, "unknown", "k", prices).first()["cost_usd"] == 0.0
    given = calls.withColumn("cost_usd", F.lit(2.5))
    assert usage_rows(given, "r", NOW, "m", "k", prices).first()["cost_usd"] == 2.5


def test_pricing_a_log(spark):
    df = log(spark, [("a", 1, "m", 2, 4, None, 0), ("b", 1, "other", 2, 4, None, 0), ("c", 1, "m", 2, 4, 9.0, 0)])
    got = price_calls(df, price_table(spark, {"m": (0.5, 0.25)})).collect()
    assert {r["id"]: r["cost_usd"] for r in got} == {"a": 2.0, "b": 0.0, "c": 9.0}


def test_old_logs_conform_and_repeated_appends_change_nothing(spark):
    df = log(spark, [("a", 1, "m", 1, 1, 0.0, 0), ("b", 2, "m", 1, 1, 0.0, 0)])
    old = df.withColumns({"prompt_text": F.lit("x"), "response_text": F.lit("y")})
    assert conform_log(old).columns == conform_log(conform_log(old)).columns == USAGE.fieldNames()
    assert conform_log(old).count() == 2
    folder = run_dir(spark, "usage")
    for run_id in ("one", "two", "one"):
        append_usage(df, folder, run_id)
    back = spark.read.parquet(folder)
    assert back.count() == 4 and conform_log(back).columns == USAGE.fieldNames()


def test_kept_sums_equal_a_whole_recount(spark):
    home = run_dir(spark, "totals")
    rows = [(str(i), i / 5, f"m{i % 2}", i, 1, 0.5 * i, i % 3) for i in range(60)]
    parts = [log(spark, rows[:20]), log(spark, rows[20:45]), log(spark, rows[45:])]
    append_totals(log(spark, rows[:7]), home, 0)  # the rest of the run comes late
    for i in (0, 1, 2, 1):
        append_totals(parts[i], home, i)
    kept, whole = spark.read.parquet(home), log(spark, rows)
    for as_of in (NOW, NOW - timedelta(hours=7), NOW + timedelta(days=40)):
        for days in (0, 1, 3, 30):
            assert cost_summary_kept(kept, whole, as_of, days).first() == cost_summary(whole, as_of, days).first()
