"""The usage log: one row per scorer call, and the summaries over it."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulelens.functions.models import model_name, model_provider
from rulelens.functions.text import short_sha
from rulelens.schemas import (
    DEFAULT_RECENT_CALLS,
    DEFAULT_SUMMARY_DAYS,
    HASH_CHARS,
    RETIRED_USAGE_COLUMNS,
    USAGE,
)


def price_table(spark, prices):
    """Prices per token from `{model: (prompt price, completion price)}`, which lives on the driver."""
    rows = [(model, float(p), float(c)) for model, (p, c) in prices.items()]
    return spark.createDataFrame(rows, "model string, prompt_price double, completion_price double")


def price_calls(calls, prices):
    """Add `cost_usd` where it is missing; an unknown model costs nothing."""
    cost = F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")
    given = F.col("cost_usd") if "cost_usd" in calls.columns else F.lit(None).cast("double")
    joined = calls.join(prices, "model", "left")
    priced = joined.withColumn("cost_usd", F.coalesce(given, cost, F.lit(0.0)))
    return priced.drop("prompt_price", "completion_price")


def usage_rows(calls, run_id, timestamp, model, pack, prices=None):
    """Log rows for scored rows (`path`, token counts, `duration_ms`, `issues_found`), all of one model.

    `prices` is `{model: (prompt price, completion price)}`; a given `cost_usd` wins, an unknown model costs
    nothing. The id is a hash of run, path and, where there is one, the text's hash, so writing a run again gives the same ids
    and two texts of one path have two.
    """
    named = [F.coalesce(F.col(c), F.lit("")) for c in ("path", "file_hash") if c in calls.columns]
    prompt_price, completion_price = (prices or {}).get(model, (0.0, 0.0))
    prompt, completion = F.col("prompt_tokens").cast("bigint"), F.col("completion_tokens").cast("bigint")
    given = F.col("cost_usd") if "cost_usd" in calls.columns else F.lit(None).cast("double")
    estimated = prompt * F.lit(float(prompt_price)) + completion * F.lit(float(completion_price))
    return calls.select(
        short_sha(F.concat_ws("|", F.lit(run_id), *named), HASH_CHARS).alias("id"),
        F.lit(timestamp).cast("timestamp").alias("timestamp"),
        F.lit(model).alias("model"),
        F.lit(pack).alias("pack"),
        F.array("path").alias("files"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
        F.coalesce(given, estimated).alias("cost_usd"),
        F.col("duration_ms").cast("bigint").alias("duration_ms"),
        F.col("issues_found").cast("bigint").alias("issues_found"),
        F.lit(False).alias("cached"),
    )


def append_usage(rows, path, run_id):
    """Add the rows of a run to the log: one folder per run, replaced if the run is repeated.

    All rows of a run share a timestamp, so a time window skips other runs by their file statistics.
    """
    rows.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def conform_log(log):
    """An old log in today's columns: retired ones dropped, all rows kept. Running it again changes nothing."""
    return log.drop(*RETIRED_USAGE_COLUMNS).select(USAGE.fieldNames())


def cost_summary(log, as_of, days=DEFAULT_SUMMARY_DAYS):
    """Calls, tokens, cost, findings and mean cost per call, strictly after `as_of - days`."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days")
    calls = F.count(F.lit(1))
    cost = F.coalesce(F.sum("cost_usd"), F.lit(0.0))
    return log.filter(F.col("timestamp") > since).agg(
        calls.alias("total_calls"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        cost.alias("total_cost"),
        F.coalesce(F.sum("issues_found"), F.lit(0)).cast("bigint").alias("total_issues"),
        (cost / F.greatest(calls, F.lit(1))).alias("avg_cost_per_call"),
    )


def usage_totals(log):
    """Mergeable sums of a log by day and model: `(day, model, calls, total_tokens, total_cost, total_issues)`."""
    return log.groupBy(F.to_date("timestamp").alias("day"), "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("issues_found"), F.lit(0)).cast("bigint").alias("total_issues"),
    )


def append_totals(rows, path, run_id):
    """Add a run's sums to those kept below `path`: one folder per run, replaced if the run is repeated or gets late rows.

    `rows` are all rows of the run, or of a part of it that has an id of its own.
    """
    usage_totals(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def cost_summary_kept(totals, log, as_of, days=DEFAULT_SUMMARY_DAYS):
    """As `cost_summary`, from kept sums: whole days are added up from them; of the log only the day the period begins in is read."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    since = as_of.cast("timestamp") - F.expr(f"interval {int(days)} days")
    edge = F.to_date(since)
    first = log.filter((F.col("timestamp") > since) & (F.col("timestamp") < F.date_add(edge, 1).cast("timestamp")))
    sums = ["calls", "total_tokens", "total_cost", "total_issues"]
    rows = totals.filter(F.col("day") > edge).select(*sums).unionByName(usage_totals(first).select(*sums))
    total = {name: F.coalesce(F.sum(name), F.lit(0)) for name in sums}
    return rows.agg(
        total["calls"].cast("bigint").alias("total_calls"),
        total["total_tokens"].cast("bigint").alias("total_tokens"),
        total["total_cost"].cast("double").alias("total_cost"),
        total["total_issues"].cast("bigint").alias("total_issues"),
        (total["total_cost"] / F.greatest(total["calls"], F.lit(1))).alias("avg_cost_per_call"),
    )


def cost_by_model(log):
    """Calls, tokens and cost for every combination of provider, model and day, with subtotals."""
    fine = log.groupBy(
        model_provider(F.col("model")).alias("provider"),
        model_name(F.col("model")).alias("model_name"),
        F.to_date("timestamp").alias("day"),
    ).agg(
        F.count(F.lit(1)).alias("_calls"), F.sum("total_tokens").alias("_tokens"), F.sum("cost_usd").alias("_cost")
    )
    return fine.cube("provider", "model_name", "day").agg(
        F.grouping_id().cast("bigint").alias("grouping"),
        F.sum("_calls").cast("bigint").alias("calls"),
        F.sum("_tokens").cast("bigint").alias("total_tokens"),
        F.sum("_cost").alias("total_cost"),
    )


def recent_calls(log, n=DEFAULT_RECENT_CALLS):
    """The n newest calls in display form."""
    newest = log.orderBy(F.desc("timestamp"), "id").limit(n)
    return newest.select(
        F.left("id", F.lit(8)).alias("id"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "model",
        "pack",
        F.size("files").cast("bigint").alias("files"),
        "total_tokens",
        "cost_usd",
        "issues_found",
    )


def find_call(log, prefix):
    """The call with the smallest id that starts with the literal prefix."""
    return log.filter(F.col("id").startswith(prefix)).orderBy("id").limit(1)
