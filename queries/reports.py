"""Scores, counts, coverage and report documents over the findings of all documents."""

from pyspark.sql import functions as F

from queries.base import (
    CAPPED,
    PARTED,
    DOCS,
    FINDINGS,
    RULES,
    WEIGHT,
    applicable_sql,
    document_findings,
    documents,
    findings_sql,
    query,
    rules_sql,
)
from queries.cache import TRIAGE_SQL, document_statuses
from rulelens.operators.findings import limit_per_path
from rulelens.operators.match import applicable_rules, detect_lines
from rulelens.operators.score import (
    counts_by_level,
    rule_coverage,
    run_meta,
    score,
    score_by,
    score_rollup,
    summary,
)
from rulelens.plans.review import apply_budget
from rulelens.plans.storage import materialize
from rulelens.sinks import findings_document, findings_jsonl
from rulelens.sources.rules import rules_df

_SOURCE = ("source", "split_part(path, '/', 1)")
_LANG = ("lang", "split_part(path, '/', 2)")


@query(
    "score_total",
    f"""{FINDINGS} SELECT CAST(greatest(0, 100 - coalesce(sum({WEIGHT}), 0)) AS BIGINT) AS score FROM findings""",
)
def total(spark, sf):
    return score(document_findings(spark, sf))


_SCORED = f"""CAST(count(DISTINCT d.path) AS BIGINT) AS corpus_rows, CAST(count(f.issue_id) AS BIGINT) AS findings,
  CAST(coalesce(sum(f.w), 0) AS BIGINT) AS penalty,
  CAST(greatest(0, 100 - coalesce(sum(f.w), 0)) AS BIGINT) AS score"""
_WEIGHTED = f"{FINDINGS}, {CAPPED}, weighted AS (SELECT path, issue_id, {WEIGHT} AS w FROM capped)"


@query("score_by_path", f"{_WEIGHTED} SELECT d.path, {_SCORED} FROM docs d LEFT JOIN weighted f ON f.path = d.path GROUP BY d.path")
def by_path(spark, sf):
    return score_by(limit_per_path(document_findings(spark, sf)), documents(spark, sf), ["path"])


@query(
    "score_rollup",
    f"""{_WEIGHTED} SELECT d.source, d.lang, {_SCORED} FROM docs d LEFT JOIN weighted f ON f.path = d.path
GROUP BY ROLLUP (d.source, d.lang)""",
)
def rolled_up(spark, sf):
    return score_rollup(limit_per_path(document_findings(spark, sf)), documents(spark, sf), [_SOURCE, _LANG])


@query("counts_by_level", f"{FINDINGS} SELECT level, CAST(count(*) AS BIGINT) AS findings FROM findings GROUP BY level")
def counts(spark, sf):
    return counts_by_level(document_findings(spark, sf))


@query(
    "summary",
    f"""{FINDINGS}, {CAPPED} SELECT CAST(greatest(0, 100 - coalesce(sum({WEIGHT}), 0)) AS BIGINT) AS score,
  CAST(100 AS BIGINT) AS max_score, CAST(count(*) AS BIGINT) AS total_issues,
  CAST(count(*) FILTER (level = 'blocker') AS BIGINT) AS blocker, CAST(count(*) FILTER (level = 'critical') AS BIGINT) AS critical,
  CAST(count(*) FILTER (level = 'major') AS BIGINT) AS major, CAST(count(*) FILTER (level = 'minor') AS BIGINT) AS minor,
  CAST(count(*) FILTER (level = 'info') AS BIGINT) AS info FROM capped""",
)
def summed_up(spark, sf):
    one = summary(limit_per_path(document_findings(spark, sf)))
    per_level = [
        F.coalesce(F.try_element_at("counts", F.lit(name)), F.lit(0)).cast("bigint").alias(name)
        for name in ("blocker", "critical", "major", "minor", "info")
    ]
    return one.select("score", "max_score", "total_issues", *per_level)


@query(
    "run_meta",
    TRIAGE_SQL
    + """, due AS (SELECT path, row_number() OVER (ORDER BY path) AS n FROM statuses WHERE status = 'analyze'),
calls AS (SELECT path, 0.25 AS cost FROM due WHERE n <= (SELECT count(*) // 3 FROM due))
SELECT CAST(count(*) AS BIGINT) AS files_analyzed, CAST(count(*) FILTER (status = 'skip') AS BIGINT) AS skipped,
  CAST(count(*) FILTER (status = 'cached') AS BIGINT) AS cache_hits, CAST(count(c.path) AS BIGINT) AS llm_calls,
  CAST(count(*) FILTER (status = 'analyze') - count(c.path) AS BIGINT) AS deferred,
  CAST(coalesce(sum(c.cost), 0) AS DOUBLE) AS cost_usd FROM statuses s LEFT JOIN calls c ON c.path = s.path""",
)
def meta(spark, sf):
    statuses = materialize(document_statuses(spark, sf), "statuses")
    due = statuses.filter("status = 'analyze'")
    calls = apply_budget(due, due.count() // 3)[0].withColumn("cost_usd", F.lit(0.25))
    return run_meta(statuses, calls)


@query(
    "rule_coverage",
    f"""WITH {DOCS}, {applicable_sql('docs')}, {findings_sql()}, {rules_sql()},
per_rule AS (SELECT r.pack, r.rule_id,
  (SELECT count(*) FROM applicable a WHERE a.rule_id = r.rule_id) AS applies_to,
  (SELECT count(*) FROM findings f WHERE f.rule_id = r.rule_id) AS findings,
  (SELECT count(DISTINCT path) FROM findings f WHERE f.rule_id = r.rule_id) AS rows_hit FROM rules r)
SELECT pack, rule_id, CAST(count(*) AS BIGINT) AS rules, CAST(sum(applies_to) AS BIGINT) AS applies_to,
  CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(rows_hit) AS BIGINT) AS rows_hit,
  CAST(count(*) FILTER (findings = 0) AS BIGINT) AS silent_rules FROM per_rule GROUP BY ROLLUP (pack, rule_id)""",
)
def coverage(spark, sf):
    docs = documents(spark, sf)
    return rule_coverage(applicable_rules(docs, RULES), detect_lines(docs, RULES), rules_df(spark, RULES))


_TAGS = "rules AS (SELECT * FROM (VALUES {}) t(rule_id, tags, actions))".format(
    ", ".join(f"('{r.rule_id}', {list(r.tags)!r}, {list(r.checklist)!r})" for r in RULES)
)
_ISSUE = """{'issue_id': issue_id, 'rule_id': f.rule_id, 'level': level, 'location': {'path': path, 'start_line': start_line,
  'end_line': CAST(NULL AS INT), 'start_col': CAST(NULL AS INT), 'end_col': CAST(NULL AS INT)}, 'title': title, 'why': why,
  'do': r.actions, 'pack': pack, 'source': 'regex', 'confidence': CAST(1.0 AS DOUBLE), 'tags': r.tags,
  'snippet': CAST(NULL AS VARCHAR), 'context': CAST(NULL AS VARCHAR)}"""


@query(
    "findings_document",
    f"""{FINDINGS}, {PARTED}, {_TAGS},
issues AS (SELECT path, part, level, start_line, f.rule_id, issue_id, CAST(to_json({_ISSUE}) AS VARCHAR) AS js
  FROM parted f JOIN rules r ON r.rule_id = f.rule_id),
levels AS (SELECT path, part, level, count(*) AS n FROM issues GROUP BY 1, 2, 3),
counts AS (SELECT path, part, string_agg('"' || level || '":' || n, ',' ORDER BY level) AS js FROM levels GROUP BY 1, 2)
SELECT i.path, i.part, '{{"issues":[' || string_agg(i.js, ',' ORDER BY CASE level WHEN 'blocker' THEN 0 WHEN 'critical' THEN 1
    WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END, start_line, rule_id, issue_id)
  || '],"summary":{{"score":' || greatest(0, 100 - sum({WEIGHT})) || ',"total_issues":' || count(*) || ',"counts":{{'
  || any_value(c.js) || '}}}},"meta":{{"run":"r1"}}}}' AS document
FROM issues i JOIN counts c ON c.path = i.path AND c.part = i.part GROUP BY i.path, i.part""",
)
def documents_out(spark, sf):
    return findings_document(document_findings(spark, sf), {"run": "r1"}).withColumn("part", F.col("part").cast("bigint"))


@query(
    "findings_jsonl",
    f"""{FINDINGS}, {CAPPED}, {_TAGS} SELECT CAST(0 AS BIGINT) AS ordinal, '{{"type":"summary","score":'
  || greatest(0, 100 - coalesce(sum({WEIGHT}), 0)) || ',"issues_count":' || count(*) || '}}' AS value FROM capped
UNION ALL SELECT 1, '{{"type":"issue",' || substr(CAST(to_json({_ISSUE}) AS VARCHAR), 2)
FROM capped f JOIN rules r ON r.rule_id = f.rule_id""",
)
def lines_out(spark, sf):
    kept = limit_per_path(document_findings(spark, sf))
    return findings_jsonl(kept, summary(kept)).select(F.col("ordinal").cast("bigint"), "value")
