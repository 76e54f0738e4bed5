"""The batch operators on arriving rows."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rulelens.functions.text import content_hash
from rulelens.plans.joins import semi_by_key
from rulelens.plans.review import review
from rulelens.plans.storage import materialize, run_scope
from rulelens.schemas import CACHE
from rulelens.sources.corpus import spread_small


# Stored entries carry the batch that wrote them as a folder name.
_STORED_CACHE = StructType([*CACHE.fields, StructField("batch_id", LongType())])
_STORED_PENDING = StructType(
    [StructField("path", StringType()), StructField("content", StringType()), StructField("batch_id", LongType())]
)


def read_stream(spark, folder, schema, name_glob=None, **options):
    """Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema).options(**options)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.parquet(folder)


def _read_or_empty(spark, folder, schema):
    """A stored table, empty if its folder is not there yet; any other fault is raised."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def review_batches(rules, scorer, options_for, out):
    """A `foreachBatch` function that reviews each micro-batch and keeps findings, cache, usage, `deferred` and
    `rejected` below `out`.

    Rows over budget and rows whose call failed are kept whole in `pending` and offered again with the next batch, before
    its own rows are: none is lost. Each batch rewrites what is pending after it.

    Each batch writes its own `batch_id=` folders and replaces them when it is replayed, so a restart neither
    loses nor repeats rows. The cache only grows by the new entries of a batch; a batch reads the entries of
    earlier batches, and the newest entry of a key wins.
    """

    def run(batch, batch_id):
        spark = batch.sparkSession
        batch = spread_small(batch, "path")
        waiting = _read_or_empty(spark, f"{out}/pending", _STORED_PENDING)
        last = waiting.filter(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
        batch = batch.select("path", "content")
        if last is not None:
            batch = waiting.filter(F.col("batch_id") == last).select("path", "content").unionByName(batch)
        stored = _read_or_empty(spark, f"{out}/cache", _STORED_CACHE)
        cache = stored.filter(F.col("batch_id") < batch_id).select(CACHE.fieldNames())
        with run_scope(spark):  # what the review stores on its way goes with the batch
            result = review(batch, rules, scorer, options_for(batch_id), cache)
            for name in ("findings", "new_cache", "usage", "deferred", "rejected"):
                folder = "cache" if name == "new_cache" else name
                getattr(result, name).write.mode("overwrite").parquet(f"{out}/{folder}/batch_id={batch_id}")
            key = ["path", "file_hash"]
            failed = result.rejected.filter("reject_reason = 'call_failed'").select(*key)
            left = materialize(result.deferred.select(*key).union(failed).distinct(), "left")
            hashed = batch.withColumn("file_hash", content_hash(F.col("content")))
            pending = semi_by_key(hashed, left, key).dropDuplicates(key).select("path", "content")
            pending.write.mode("overwrite").parquet(f"{out}/pending/batch_id={batch_id}")

    return run


def stream_review(corpus_stream, rules, scorer, options_for, out, checkpoint):
    """Start the stream over what is available now; the caller awaits it and reads `out`."""
    writer = corpus_stream.writeStream.foreachBatch(review_batches(rules, scorer, options_for, out))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _first_in_batch(key):
    """Tasks: drop repeats of a key inside each Arrow batch."""

    def run(batches):
        for batch in batches:
            yield batch.drop_duplicates(key)

    return run


def stream_dedup(findings_stream, delay="1 hour", event_time="detected_at"):
    """First finding per id among those that arrive within the delay; state is dropped behind the watermark.

    Repeats are first thinned out where they are read, since streaming dedup sends every row of an id to the
    one task that holds its state.
    """
    thinned = findings_stream.mapInPandas(_first_in_batch("issue_id"), findings_stream.schema)
    return thinned.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["issue_id"])


def stream_usage(calls_stream, delay="10 minutes", window="1 day"):
    """Calls, tokens and cost per window and model; a window is emitted once the watermark has passed it."""
    grouped = calls_stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", window), "model")
    return grouped.agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_usd").alias("total_cost"),
    )


def write_available(stream, folder, checkpoint):
    """Append a stream's available rows to Parquet and wait for the end."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
