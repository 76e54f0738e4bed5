from datetime import datetime, timedelta
from pathlib import Path
from shutil import copyfile

from helpers import finding, findings_df
from pyspark.sql import functions as F
from test_review import ALL, ROWS, RULES, SCORER, options, plain

from queries import streams as queries
from rulelens.operators.scorer import python_scorer
from rulelens.plans.storage import materialize, run_dir, shared_dir
from rulelens.schemas import CACHE, FINDINGS
from rulelens.streaming.streams import (
    read_stream,
    review_batches,
    stream_dedup,
    stream_review,
    stream_usage,
    write_available,
)

START = datetime(2024, 1, 1)


def test_review_of_arriving_rows_reuses_verdicts(spark, corpus):
    home = run_dir(spark, "arrivals")

    def arrive(rows):
        corpus(rows).coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = read_stream(spark, f"{home}/in", "path string, content string")
        query = stream_review(stream, RULES, SCORER, lambda b: options(run_id=f"b{b}"), f"{home}/out", f"{home}/ck")
        query.awaitTermination()

    arrive(ROWS[:2])
    arrive(ROWS[2:])
    found = spark.read.schema(FINDINGS).parquet(f"{home}/out/findings")
    assert plain(found) == ALL
    # e.py has the text of a.py, so the second batch only scored d.txt.
    usage = spark.read.parquet(f"{home}/out/usage")
    assert {(r["batch_id"], r["files"][0]) for r in usage.collect()} == {(0, "a.py"), (0, "b.py"), (1, "d.txt")}
    assert spark.read.schema(CACHE).parquet(f"{home}/out/cache").count() == 3


def test_replayed_batch_changes_nothing(spark, corpus):
    home = run_dir(spark, "replay")
    run = review_batches(RULES, SCORER, lambda b: options(), home)
    for batch_id in (0, 1, 1, 0):
        run(corpus(ROWS[:2] if batch_id == 0 else ROWS[2:]), batch_id)
    assert plain(spark.read.schema(FINDINGS).parquet(f"{home}/findings")) == ALL


def test_rows_over_budget_or_failed_come_back(spark, corpus):
    home = run_dir(spark, "budget")
    run = review_batches(RULES, SCORER, lambda b: options(budget=10), home)
    rows = [(f"{i:02}.py", f"TODO {i}") for i in range(30)]
    run(corpus(rows), 0)
    for batch_id in (1, 2, 2):
        assert spark.read.parquet(f"{home}/pending/batch_id={batch_id - 1}").count() == 30 - 10 * batch_id
        run(corpus([]), batch_id)
    assert len(plain(spark.read.schema(FINDINGS).parquet(f"{home}/findings"))) == 30
    assert spark.read.parquet(f"{home}/pending/batch_id=2").count() == 0

    def broken(prompts):
        raise RuntimeError("no answer")

    # Nothing that a batch stored on its way is left: only the outputs stand in the shared folder.
    stored = Path(shared_dir(spark).removeprefix("file:")) / "rulelens"
    assert not [p for p in stored.iterdir() if p.name.startswith("run-")]

    failing = run_dir(spark, "failing")
    review_batches(RULES, python_scorer(broken), lambda b: options(), failing)(corpus(rows[:3]), 0)
    assert {r["reject_reason"] for r in spark.read.parquet(f"{failing}/rejected").collect()} == {"call_failed"}
    review_batches(RULES, SCORER, lambda b: options(), failing)(corpus(rows[3:4]), 1)
    assert len(plain(spark.read.schema(FINDINGS).parquet(f"{failing}/findings"))) == 4


def test_dedup_within_the_delay(spark):
    home = run_dir(spark, "dedup")

    def arrive(rows):
        df = findings_df(spark, [finding(title=t) for t, _ in rows])
        times = spark.createDataFrame([(t, START + timedelta(minutes=m)) for t, m in rows], "title string, detected_at timestamp")
        df.join(times, "title").coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = read_stream(spark, f"{home}/in", spark.read.parquet(f"{home}/in").schema)
        write_available(stream_dedup(stream), f"{home}/out", f"{home}/ck")

    arrive([("a", 0), ("b", 5)])
    arrive([("a", 10), ("c", 11)])
    arrive([("d", 600)])
    arrive([("a", 601)])
    got = sorted(r["title"] for r in spark.read.parquet(f"{home}/out").collect())
    assert got == ["a", "a", "b", "c", "d"]


def test_usage_windows_close_behind_the_watermark(spark):
    home = run_dir(spark, "windows")
    rows = [("m", 0, 1), ("m", 23, 2), ("n", 5, 4), ("m", 25, 8)]
    calls = spark.createDataFrame([(m, START + timedelta(hours=h), t, 0.5) for m, h, t in rows], "model string, timestamp timestamp, total_tokens long, cost_usd double")
    calls.write.parquet(f"{home}/in")
    stream = read_stream(spark, f"{home}/in", calls.schema)
    write_available(stream_usage(stream), f"{home}/out", f"{home}/ck")
    got = spark.read.parquet(f"{home}/out").withColumn("day", F.to_date("window.start"))
    assert sorted((str(r["day"]), r["model"], r["calls"], r["total_tokens"], r["total_cost"]) for r in got.collect()) == [
        ("2024-01-01", "m", 2, 3, 1.0), ("2024-01-01", "n", 1, 4, 0.5),
    ]


def test_streamed_queries_read_tables_of_one_file_and_of_many(spark):
    home = run_dir(spark, "tables")
    rows = [(i, "src0", "en", "mail\nme@example.com" if i % 2 else "plain") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    docs.repartition(4).write.parquet(f"{home}/many/documents.parquet")
    docs.coalesce(1).write.parquet(f"{home}/part")
    (Path(home.removeprefix("file:")) / "one").mkdir()
    (part,) = (Path(home.removeprefix("file:")) / "part").glob("*.parquet")
    copyfile(part, Path(home.removeprefix("file:")) / "one" / "documents.parquet")
    for run in (queries.deduped_stream, queries.reviewed_stream):
        many, one = ({tuple(r) for r in run(spark, f"{home}/{kind}").collect()} for kind in ("many", "one"))
        assert many == one
        assert {row[0] for row in many} == {f"src0/en/{i}.txt" for i in (1, 3, 5, 7)}


def test_a_batch_arrives_as_many_files(spark):
    home = run_dir(spark, "order")
    rows = spark.range(40).repartition(4).withColumn("_batch", F.when(F.col("id") % 10 == 0, 2).otherwise(0))
    seen = []

    def start(stream):
        write_available(stream, f"{home}/out", f"{home}/ck")
        seen.append((len(list((Path(home.removeprefix("file:")) / "in").glob("*.parquet"))), spark.read.parquet(f"{home}/out").count()))

    queries._arrive_in_order(materialize(rows, "rows"), home, 3, start)
    assert [n for _, n in seen] == [36, 36, 40] and seen[0][0] > 1
