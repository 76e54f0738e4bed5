"""Streams replayed from the given tables."""

from pyspark.sql import functions as F

from queries.base import DOCS, FINDINGS, PACK_NAME, RULES, applicable_sql, document_findings, query, table
from queries.reviews import _OUT, RESPONSES, SCORER, _answers_sql, _plain, options
from queries.usage import LOG, event_calls
from rulelens.operators.match import detect_lines
from rulelens.plans.storage import materialize, run_dir
from rulelens.schemas import EMPTY_ANSWER
from rulelens.schemas import FINDINGS as FINDINGS_SCHEMA
from rulelens.sources.corpus import documents_corpus
from rulelens.streaming.state import OUTCOME, findings_of_outcomes, keyed_state, review_outcomes
from rulelens.streaming.streams import (
    read_stream,
    stream_dedup,
    stream_review,
    stream_usage,
    write_available,
)


def _stream(spark, sf, name):
    # As a glob, the name stands for a table that is one file and for one that is a folder of files.
    return read_stream(spark, f"{sf}/{{{name}}}.parquet", table(spark, sf, name).schema)


def _arrive_in_order(rows, home, batches, start):
    """Let stored `rows` arrive by their `_batch`, each batch as many files; `start` takes the stream of them on to its end.

    The stream is stopped after each batch and goes on from its checkpoint. Batches without rows of their own follow only the
    last one, so that the times of a batch count as in a stream that was never stopped.
    """
    spark, name = rows.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    schema, before = rows.drop("_batch").schema, spark.conf.get(name)
    try:
        for number in range(batches):
            rows.filter(F.col("_batch") == number).drop("_batch").write.mode("append").parquet(f"{home}/in")
            spark.conf.set(name, before if number == batches - 1 else "false")
            start(read_stream(spark, f"{home}/in", schema))
    finally:
        spark.conf.set(name, before)


@query("stream_review", f"WITH {DOCS}, {applicable_sql('docs')}, {_answers_sql('docs')} SELECT {_OUT} FROM fresh_findings")
def reviewed_stream(spark, sf):
    home = run_dir(spark, "stream-review")
    corpus = documents_corpus(_stream(spark, sf, "documents"))
    running = stream_review(
        corpus, RULES, SCORER, lambda batch_id: options(run_id=f"batch-{batch_id}"), f"{home}/out", f"{home}/ck"
    )
    running.awaitTermination()
    return _plain(spark.read.schema(FINDINGS_SCHEMA).parquet(f"{home}/out/findings"))


def _first_response(responses, empty):
    """The canned answers as a function of prompts; defined here so that it travels to tasks as code."""

    def answer(prompts):
        return [next((text for key, text in responses.items() if key in prompt), empty) for prompt in prompts]

    return answer


@query(
    "stream_review_state",
    f"""WITH {DOCS}, {applicable_sql('docs')}, {_answers_sql('docs')}
SELECT DISTINCT path, rule_id, level, CAST(start_line AS BIGINT) AS start_line, title FROM fresh_findings""",
)
def reviewed_by_state(spark, sf):
    """Documents arrive in three batches; texts that were answered in one are not asked for in the next."""
    home = run_dir(spark, "stream-state")
    docs = documents_corpus(table(spark, sf, "documents")).select("path", "content")
    docs = docs.withColumn("_batch", F.pmod(F.xxhash64("path"), F.lit(3)))

    def go_on(stream):
        outcomes = review_outcomes(stream, RULES, _first_response(RESPONSES, EMPTY_ANSWER))
        write_available(outcomes, f"{home}/out", f"{home}/ck")

    with keyed_state(spark):
        _arrive_in_order(docs, home, 3, go_on)
    found = findings_of_outcomes(spark.read.schema(OUTCOME).parquet(f"{home}/out"), PACK_NAME)
    return found.select("path", "rule_id", "level", F.col("start_line").cast("bigint"), "title").distinct()


@query("stream_dedup", FINDINGS + " SELECT path, start_line, rule_id, issue_id FROM findings")
def deduped_stream(spark, sf):
    home = run_dir(spark, "stream-dedup")
    found = detect_lines(documents_corpus(_stream(spark, sf, "documents")), RULES)
    # Each finding is delivered twice, ten minutes apart.
    number = F.split_part(F.split_part("path", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).cast("bigint")
    twice = found.withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "detected_at", F.timestamp_seconds(1704067200 + number * 60 + F.col("_again") * 600)
    )
    write_available(stream_dedup(twice.drop("_again")), f"{home}/out", f"{home}/ck")
    kept = spark.read.parquet(f"{home}/out")
    return kept.select("path", F.col("start_line").cast("bigint"), "rule_id", "issue_id")


@query(
    "stream_usage",
    LOG
    + """ SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS day, model, CAST(count(*) AS BIGINT) AS calls,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 6) AS total_cost
FROM log WHERE date_trunc('day', timestamp) + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM log) - INTERVAL 10 MINUTE
GROUP BY 1, 2""",
)
def usage_stream(spark, sf):
    home = run_dir(spark, "stream-usage")
    write_available(stream_usage(event_calls(_stream(spark, sf, "events"))), f"{home}/out", f"{home}/ck")
    closed = spark.read.parquet(f"{home}/out")
    return closed.select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"),
        "model",
        "calls",
        "total_tokens",
        F.round("total_cost", 6).alias("total_cost"),
    )


# Calls arrive by day in three batches; every ninth call of the first two thirds only comes with the last one, and is counted
# if its day had not been closed by the batch before (a batch closes days by the times of the batches before it).
@query(
    "stream_usage_late",
    LOG
    + """, spread AS (SELECT min(epoch_us(timestamp)) AS a, max(epoch_us(timestamp)) AS b FROM log),
dealt AS (SELECT log.*, CASE WHEN epoch_us(timestamp) - a < (b - a) / 3 THEN 0 WHEN epoch_us(timestamp) - a < 2 * ((b - a) / 3) THEN 1
  ELSE 2 END AS third FROM log, spread),
placed AS (SELECT *, CASE WHEN third < 2 AND total_tokens % 9 = 0 THEN 2 ELSE third END AS batch FROM dealt),
marks AS (SELECT b AS batch, (SELECT max(timestamp) FROM placed WHERE batch < b) - INTERVAL 10 MINUTE AS mark FROM range(0, 4) r(b))
SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS day, model, CAST(count(*) AS BIGINT) AS calls,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM placed p JOIN marks m ON m.batch = greatest(p.batch - 1, 0)
WHERE (mark IS NULL OR date_trunc('day', timestamp) + INTERVAL 1 DAY > mark)
  AND date_trunc('day', timestamp) + INTERVAL 1 DAY <= (SELECT mark FROM marks WHERE batch = 3) GROUP BY 1, 2""",
)
def late_usage(spark, sf):
    home = run_dir(spark, "stream-late")
    log = materialize(event_calls(table(spark, sf, "events")), "calls")
    first, last = log.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    at, third = F.unix_micros("timestamp") - first, (last - first) / 3
    batch = F.when(at < third, 0).when(at < 2 * third, 1).otherwise(2)
    batch = F.when((batch < 2) & (F.col("total_tokens") % 9 == 0), 2).otherwise(batch)
    _arrive_in_order(
        log.withColumn("_batch", batch), home, 3, lambda stream: write_available(stream_usage(stream), f"{home}/out", f"{home}/ck")
    )
    closed = spark.read.parquet(f"{home}/out")
    return closed.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "model", "calls", "total_tokens")


# Findings arrive in the order of their documents; each comes again with the next batch, and every seventh document's only ten
# batches late, when its time is past.
@query(
    "stream_dedup_late",
    FINDINGS
    + """, numbered AS (SELECT *, CAST(split_part(split_part(path, '/', 3), '.', 1) AS BIGINT) AS number FROM findings),
top AS (SELECT max(number) AS n FROM numbered WHERE number % 7 <> 0)
SELECT path, start_line, rule_id, issue_id FROM numbered, top WHERE number % 7 <> 0 OR number >= n - 60""",
)
def late_findings(spark, sf):
    home = run_dir(spark, "stream-dedup-late")
    number = F.split_part(F.split_part("path", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).cast("bigint")
    found = materialize(document_findings(spark, sf).withColumn("_number", number), "findings")
    found = found.withColumn("detected_at", F.timestamp_seconds(1704067200 + F.col("_number") * 60))
    last = (F.col("_number") % 7 == 0).cast("int")
    twice = found.withColumn("_batch", F.explode(F.when(last == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))))
    # A repeat comes a minute after the first, within the delay.
    _arrive_in_order(
        twice.drop("_number"), home, 3, lambda stream: write_available(stream_dedup(stream), f"{home}/out", f"{home}/ck")
    )
    return spark.read.parquet(f"{home}/out").select("path", F.col("start_line").cast("bigint"), "rule_id", "issue_id")
