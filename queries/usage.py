"""The usage log, made from the events table."""

from pyspark.sql import functions as F

from queries.base import AS_OF, DOCS, documents, query, table
from rulelens.operators.usage import (
    append_totals,
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

PRICES = {"acme/fast": (0.000001, 0.000002), "acme/deep": (0.00001, 0.00003), "Zeta/large": (0.000005, 0.000015)}

_MODEL = """CASE event_type WHEN 'click' THEN 'acme/fast' WHEN 'view' THEN 'acme/deep' WHEN 'purchase' THEN 'Zeta/large'
  WHEN 'signup' THEN 'zeta/large/v2' ELSE 'small' END"""


def event_calls(events):
    """Events as calls of a scorer; works on a table and on a stream."""
    event = F.col("event_id")
    prompt = 100 + event * 37 % 900
    completion = event * 13 % 400
    return events.select(
        F.md5(event.cast("string")).alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.expr(_MODEL).alias("model"),
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("pack"),
        F.transform(F.sequence(F.lit(0), event % 3), lambda i: F.concat(F.lit("f"), i)).alias("files"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
        (F.col("value") / 1000).alias("cost_usd"),
        (event % 5000).alias("duration_ms"),
        (event % 7).alias("issues_found"),
        (event % 10 == 0).alias("cached"),
    )


def usage_log(spark, sf):
    """As an old log would be: with the two retired columns, in today's schema after conforming."""
    log = event_calls(table(spark, sf, "events"))
    old = log.withColumns({"prompt_text": F.lit("p"), "response_text": F.lit("r")})
    return conform_log(old).select(USAGE.fieldNames())


LOG = f"""WITH log AS (SELECT md5(CAST(event_id AS VARCHAR)) AS id, ts AS timestamp, {_MODEL} AS model,
  'p' || (user_id % 3) AS pack, event_id % 3 + 1 AS files, 100 + event_id * 37 % 900 AS prompt_tokens,
  event_id * 13 % 400 AS completion_tokens, 100 + event_id * 37 % 900 + event_id * 13 % 400 AS total_tokens,
  value / 1000 AS cost_usd, event_id % 7 AS issues_found FROM events)"""


@query(
    "cost_summary",
    LOG
    + f""" SELECT CAST(count(*) AS BIGINT) AS total_calls, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
  round(coalesce(sum(cost_usd), 0), 6) AS total_cost, CAST(coalesce(sum(issues_found), 0) AS BIGINT) AS total_issues,
  round(coalesce(sum(cost_usd), 0) / greatest(count(*), 1), 6) AS avg_cost_per_call
FROM log WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""",
)
def summed(spark, sf):
    one = cost_summary(usage_log(spark, sf), AS_OF, 7)
    rounded = {c: F.round(c, 6) for c in ("total_cost", "avg_cost_per_call")}
    return one.withColumns(rounded)


@query(
    "cost_summary_kept",
    LOG
    + f""" SELECT CAST(count(*) AS BIGINT) AS total_calls, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
  round(coalesce(sum(cost_usd), 0), 6) AS total_cost, CAST(coalesce(sum(issues_found), 0) AS BIGINT) AS total_issues
FROM log WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 9 DAY - INTERVAL 7 HOUR""",
)
def summed_from_kept(spark, sf):
    """The log arrives in three runs, the second of them twice and at first in part; a period that begins within a day."""
    log, home = usage_log(spark, sf), run_dir(spark, "totals")
    run = F.pmod(F.xxhash64("id"), F.lit(3))
    append_totals(log.filter(run == 1).filter("total_tokens % 2 = 0"), home, 1)
    for number in range(3):
        append_totals(log.filter(run == number), home, number)
    as_of = F.expr(f"timestamp'{AS_OF}' - interval 7 hours")
    one = cost_summary_kept(spark.read.parquet(home), log, as_of, 9)
    return one.select("total_calls", "total_tokens", F.round("total_cost", 6).alias("total_cost"), "total_issues")


@query(
    "cost_by_model",
    LOG
    + """, named AS (SELECT *, CASE WHEN contains(model, '/') THEN lower(split_part(model, '/', 1)) ELSE 'openai' END AS provider,
  CASE WHEN contains(model, '/') THEN substr(model, instr(model, '/') + 1) ELSE model END AS model_name,
  CAST(timestamp AS DATE) AS d FROM log)
SELECT provider, model_name, strftime(d, '%Y-%m-%d') AS day, CAST(GROUPING(provider, model_name, d) AS BIGINT) AS grouping,
  CAST(count(*) AS BIGINT) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 6) AS total_cost
FROM named GROUP BY CUBE (provider, model_name, d)""",
)
def cubed(spark, sf):
    cube = cost_by_model(usage_log(spark, sf))
    return cube.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "total_cost": F.round("total_cost", 6)})


@query(
    "price_calls",
    LOG
    + f""", prices(model, p, c) AS (VALUES {", ".join(f"('{m}', {p!r}, {c!r})" for m, (p, c) in PRICES.items())})
SELECT id, l.model, total_tokens, round(coalesce(prompt_tokens * p + completion_tokens * c, 0), 8) AS cost_usd
FROM log l LEFT JOIN prices ON prices.model = l.model""",
)
def priced(spark, sf):
    calls = usage_log(spark, sf).drop("cost_usd")
    return price_calls(calls, price_table(spark, PRICES)).select(
        "id", "model", "total_tokens", F.round("cost_usd", 8).alias("cost_usd")
    )


@query(
    "recent_calls",
    LOG
    + """ SELECT left(id, 8) AS id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, model, pack,
  CAST(files AS BIGINT) AS files, CAST(total_tokens AS BIGINT) AS total_tokens, cost_usd, CAST(issues_found AS BIGINT) AS issues_found
FROM log ORDER BY log.timestamp DESC, log.id LIMIT 20""",
)
def recent(spark, sf):
    return recent_calls(usage_log(spark, sf))


@query(
    "find_call",
    LOG + " SELECT id, model, CAST(total_tokens AS BIGINT) AS total_tokens FROM log WHERE starts_with(id, 'a') ORDER BY id LIMIT 1",
)
def found(spark, sf):
    return find_call(usage_log(spark, sf), "a").select("id", "model", "total_tokens")


@query(
    "usage_rows",
    f"""WITH {DOCS}, calls AS (SELECT path, length(content) // 4 AS prompt_tokens, length(content) // 40 AS completion_tokens,
  length(content) % 5 AS issues_found FROM docs)
SELECT left(sha256('run-1|' || path), 32) AS id, '{AS_OF}' AS timestamp, 'acme/deep' AS model, 'prose' AS pack, path AS file,
  CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(completion_tokens AS BIGINT) AS completion_tokens,
  CAST(prompt_tokens + completion_tokens AS BIGINT) AS total_tokens,
  round(CAST(prompt_tokens * 0.00001 + completion_tokens * 0.00003 AS DOUBLE), 8) AS cost_usd, CAST(issues_found AS BIGINT) AS issues_found
FROM calls""",
)
def rows(spark, sf):
    size = F.length("content")
    calls = documents(spark, sf).select(
        "path",
        F.floor(size / 4).alias("prompt_tokens"),
        F.floor(size / 40).alias("completion_tokens"),
        F.lit(3).alias("duration_ms"),
        (size % 5).alias("issues_found"),
    )
    log = usage_rows(calls, "run-1", AS_OF, "acme/deep", "prose", PRICES)
    return log.select(
        "id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "model",
        "pack",
        F.element_at("files", 1).alias("file"),
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        F.round("cost_usd", 8).alias("cost_usd"),
        "issues_found",
    )
