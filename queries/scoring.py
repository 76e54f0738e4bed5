"""Prompts, the canned scorer, answers and their checks, and the budget."""

from pyspark.sql import functions as F

from queries.base import DOCS, RULES, applicable_sql, documents, query, quoted, table
from queries.cache import TRIAGE_SQL, document_statuses
from rulelens.operators.match import match_rules
from rulelens.operators.scorer import (
    canned_answer,
    parse_responses,
    prompt_stats,
    python_scorer,
    rule_line,
    score_with,
    validate_findings,
    with_prompt,
)
from rulelens.plans.review import apply_budget
from rulelens.plans.storage import materialize
from rulelens.sources.corpus import spread_small


@query(
    "prompt_stats",
    f"""WITH {DOCS}, {applicable_sql('docs')}, texts(rule_id, line) AS (VALUES
  {", ".join(f"('{r.rule_id}', {quoted(rule_line(r))})" for r in RULES)}),
listed AS (SELECT d.path, d.content, count(a.rule_id) AS rules, coalesce(sum(length(t.line) + 1), 1) - 1 AS chars
  FROM docs d LEFT JOIN applicable a ON a.path = d.path LEFT JOIN texts t ON t.rule_id = a.rule_id GROUP BY 1, 2),
sized AS (SELECT *, length('Review the text below against the listed rules. Answer with JSON.') + 2
  + length('Path: ') + length(path) + 2 + length('Rules:') + 1 + chars + 2 + length('Text:') + 1
  + length(content) + 1 AS n FROM listed)
SELECT path, CAST(n AS BIGINT) AS prompt_chars, CAST(n // 4 AS BIGINT) AS prompt_tokens,
  CAST(rules AS BIGINT) AS rules, false AS truncated FROM sized""",
)
def prompts(spark, sf):
    return prompt_stats(with_prompt(match_rules(documents(spark, sf), RULES), RULES))


# Answers keyed by words of the text; the first key that occurs wins.
CANNED = {
    "worthless": '{"issues":[{"rule_id":"tone/insult","level":"major"}]}',
    "License": '{"issues":[{"rule_id":"legal/license-line","level":"info"}]}',
    " the ": '{"issues":[{"rule_id":"style/article","level":"minor"}]}',
    "que": '{"issues":[{"rule_id":"style/que","level":"minor"}]}',
}


def _answer_sql(column):
    arms = " ".join(f"WHEN contains({column}, '{key}') THEN '{answer}'" for key, answer in CANNED.items())
    return f"CASE {arms} ELSE '{{\"issues\":[]}}' END"


@query("canned_scorer", f"WITH {DOCS} SELECT path, {_answer_sql('content')} AS response_json FROM docs")
def canned(spark, sf):
    answer = canned_answer(F.col("content"), CANNED)
    return documents(spark, sf).select("path", answer.alias("response_json"))


# Every kind of answer, by document number: good, two issues, unknown level, long title, bad confidence, missing
# field, broken text, no issues.
_ANSWERS = """CASE doc_id % 8
 WHEN 0 THEN '{"issues":[{"rule_id":"a/one","level":"major","location":{"start_line":' || (doc_id % 90 + 1) || ',"end_line":' || (doc_id % 90 + 3) || '},"title":"t' || doc_id || '","why":"w","do":["x","y"],"confidence":0.5,"tags":["p"]}]}'
 WHEN 1 THEN '{"issues":[{"rule_id":"a/two","level":"minor","location":{"start_line":1},"title":"t","why":"w","do":[]},{"rule_id":"b/three","level":"blocker","location":{"start_line":2,"end_line":null},"title":"u","why":"w","do":["x"]}]}'
 WHEN 2 THEN '{"issues":[{"rule_id":"a/four","level":"fatal","location":{"start_line":1},"title":"t","why":"w","do":[]},{"rule_id":"a/five","level":"info","location":{"start_line":7},"title":"t","why":"w","do":[]}]}'
 WHEN 3 THEN '{"issues":[{"rule_id":"a/six","level":"info","location":{"start_line":1},"title":"' || repeat('x', CAST(77 + doc_id % 5 AS INT)) || '","why":"w","do":[]}]}'
 WHEN 4 THEN '{"issues":[{"rule_id":"a/seven","level":"info","location":{"start_line":1},"title":"t","why":"w","do":[],"confidence":' || (CASE WHEN doc_id % 3 = 0 THEN '1.2' WHEN doc_id % 3 = 1 THEN '-0.1' ELSE '1.0' END) || '}]}'
 WHEN 5 THEN '{"issues":[{"rule_id":"a/eight","level":"info","location":{"start_line":1},"title":"t","do":[]}]}'
 WHEN 6 THEN '{"issues":[{"rule_id":'
 ELSE '{"issues":[]}' END"""


def answers(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt"))
    return spread_small(docs.select(path.alias("path"), F.expr(_ANSWERS).alias("response_json")), "path")


_PARSED = f"""WITH {DOCS}, answers AS (SELECT path, doc_id, {_ANSWERS} AS js FROM docs),
items AS (SELECT path, js, unnest(json_extract(js, '$.issues[*]')) AS item,
  generate_subscripts(json_extract(js, '$.issues[*]'), 1) - 1 AS ordinal FROM answers WHERE json_valid(js)),
parsed AS (SELECT path, CAST(ordinal AS BIGINT) AS ordinal, item ->> '$.rule_id' AS rule_id, item ->> '$.level' AS level,
  CAST(item ->> '$.location.start_line' AS BIGINT) AS start_line, CAST(item ->> '$.location.end_line' AS BIGINT) AS end_line,
  item ->> '$.title' AS title, item ->> '$.why' AS why, CAST(json_array_length(item, '$.do') AS BIGINT) AS actions,
  coalesce(CAST(item ->> '$.confidence' AS DOUBLE), 0.9) AS confidence FROM items)"""
_FIELDS = """path, ordinal, rule_id, level, start_line, coalesce(end_line, 0) AS end_line, title, why, actions,
  confidence"""


def _flat(df):
    return df.select(
        "path",
        F.col("ordinal").cast("bigint"),
        "rule_id",
        "level",
        F.col("start_line").cast("bigint"),
        F.coalesce(F.col("end_line").cast("bigint"), F.lit(0)).alias("end_line"),
        "title",
        "why",
        F.size("do").cast("bigint").alias("actions"),
        "confidence",
    )


@query("parse_responses", f"{_PARSED} SELECT {_FIELDS} FROM parsed")
def parsed(spark, sf):
    return _flat(parse_responses(answers(spark, sf)))


_FAULTS = f"""{_PARSED}, faults AS (
  SELECT a.path, CASE WHEN NOT json_valid(a.js) THEN 'malformed'
    WHEN bool_or(p.why IS NULL AND p.path IS NOT NULL) THEN 'missing_field'
    WHEN bool_or(length(p.title) > 80) THEN 'title_too_long'
    WHEN bool_or(p.confidence < 0 OR p.confidence > 1) THEN 'confidence_range' END AS fault
  FROM answers a LEFT JOIN parsed p ON p.path = a.path GROUP BY a.path, a.js)"""
_KNOWN = "('blocker', 'critical', 'major', 'minor', 'info')"


@query(
    "validate_findings",
    f"""{_FAULTS} SELECT {_FIELDS} FROM parsed p WHERE level IN {_KNOWN}
AND path IN (SELECT path FROM faults WHERE fault IS NULL)""",
)
def validated(spark, sf):
    return _flat(validate_findings(answers(spark, sf))[0])


@query(
    "rejected_findings",
    f"""{_FAULTS} SELECT path, CAST(-1 AS BIGINT) AS ordinal, fault AS reject_reason FROM faults WHERE fault IS NOT NULL
UNION ALL SELECT path, ordinal, 'unknown_level' FROM parsed WHERE level NOT IN {_KNOWN}
  AND path IN (SELECT path FROM faults WHERE fault IS NULL)""",
)
def rejected(spark, sf):
    bad = validate_findings(answers(spark, sf))[1]
    return bad.select(
        "path", F.coalesce(F.col("ordinal"), F.lit(-1)).cast("bigint").alias("ordinal"), "reject_reason"
    )


_LONG_TEXTS = '{"issues":[{"rule_id":"quality/long","level":"minor","location":{"start_line":1},"title":"Long","why":"w","do":[]}]}'


@query(
    "score_with",
    f"""WITH {DOCS} SELECT path, CASE WHEN length(content) + length(path) + 8 > 2000 THEN '{_LONG_TEXTS}'
  ELSE '{{"issues":[]}}' END AS response_json, CAST((length(content) + length(path) + 8) // 4 AS BIGINT) AS prompt_tokens,
  CAST(NULL AS VARCHAR) AS error FROM docs""",
)
def scored(spark, sf):
    # The answers of this scorer do not depend on wording, so a bare prompt keeps the check readable.
    answers_for = _LONG_TEXTS

    def flag_long(prompts):
        return [answers_for if len(p) > 2000 else '{"issues":[]}' for p in prompts]

    rows = documents(spark, sf).withColumn("prompt", F.concat(F.lit("Review: "), "path", "content"))
    return score_with(rows, python_scorer(flag_long)).select(
        "path", "answer.response_json", "answer.prompt_tokens", "answer.error"
    )


# The budget of these queries grows with the corpus: a third of what is due.
_CHOSEN = TRIAGE_SQL + """, due AS (SELECT path, row_number() OVER (ORDER BY path) AS n FROM statuses WHERE status = 'analyze'),
chosen AS (SELECT path FROM due WHERE n <= (SELECT count(*) // 3 FROM due))"""


@query("apply_budget", _CHOSEN + " SELECT path FROM chosen")
def budget(spark, sf):
    misses = materialize(document_statuses(spark, sf).filter("status = 'analyze'"), "misses")
    return apply_budget(misses, misses.count() // 3)[0].select("path")


@query(
    "deferred",
    _CHOSEN + " SELECT path FROM statuses WHERE status = 'analyze' AND path NOT IN (SELECT path FROM chosen)",
)
def over_budget(spark, sf):
    misses = materialize(document_statuses(spark, sf).filter("status = 'analyze'"), "misses")
    return apply_budget(misses, misses.count() // 3)[1].select("path")
