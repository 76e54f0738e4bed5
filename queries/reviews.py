"""Whole review runs."""

from pyspark.sql import functions as F

from queries.base import (
    AS_OF,
    CHATS,
    DOCS,
    PACK_NAME,
    PAGES,
    RULES,
    applicable_sql,
    chats,
    documents,
    hash_sql,
    pages,
    query,
)
from queries.cache import CACHE_SQL, document_cache, keyed_documents
from queries.changes import _LATER, EDITED, edited, later
from queries.usage import PRICES
from rulelens.functions.text import estimate_tokens
from rulelens.operators.cache import with_cache_key
from rulelens.operators.match import match_rules
from rulelens.operators.scorer import canned_scorer
from rulelens.plans.joins import semi_by_key
from rulelens.plans.review import Options, apply_budget, review, review_changed
from rulelens.plans.storage import materialize

# (rule asked for, [(rule reported, level, start line, title)]): the first rule listed in the prompt answers.
# A level that is unknown loses its finding; a title over 80 characters loses the whole answer.
ANSWERS = [
    ("security/hardcoded-token", [("security/hardcoded-token", "blocker", 1, "Token in the open")]),
    ("privacy/email", [("privacy/email", "critical", 1, "Address"), ("privacy/email", "fatal", 1, "Lost")]),
    ("tone/insult", [("tone/insult", "major", 2, "Insult"), ("tone/insult", "major", 2, "Insult")]),
    ("quality/symbol-junk", [("quality/symbol-junk", "minor", 1, "x" * 81)]),
    ("legal/license-line", [("legal/license-line", "info", 1, "License"), ("general/reviewed", "minor", 1, "Seen")]),
    ("html/tracking-call", [("html/tracking-call", "critical", 1, "Tracks"), ("html/ad-block", "minor", 1, "Ad")]),
    ("chat/system-turn", [("chat/system-turn", "major", 1, "System turn")]),
]


def _issue(rule_id, level, line, title):
    return (
        f'{{"rule_id":"{rule_id}","level":"{level}","location":{{"start_line":{line}}},"title":"{title}",'
        '"why":"see rule","do":["act"]}'
    )


RESPONSES = {f'"rule": "{asked}"': '{"issues":[' + ",".join(_issue(*i) for i in issues) + "]}" for asked, issues in ANSWERS}
SCORER = canned_scorer(RESPONSES)


def _answers_sql(source):
    """CTEs: which answer each row of `source` gets, and the findings that survive the checks."""
    pick = " ".join(
        f"WHEN bool_or(a.rule_id = '{asked}') THEN '{asked}'" for asked, _ in ANSWERS
    )
    good = sorted(
        {
            (asked, *issue)
            for asked, issues in ANSWERS
            for issue in issues
            if issue[1] != "fatal" and all(len(i[3]) <= 80 for i in issues)
        }
    )
    values = ", ".join(f"('{a}', '{r}', '{lv}', {n}, '{t}')" for a, r, lv, n, t in good)
    return f"""picked AS (SELECT s.path, CASE {pick} END AS asked FROM {source} s JOIN applicable a ON a.path = s.path GROUP BY 1),
issues(asked, rule_id, level, start_line, title) AS (VALUES {values}),
fresh_findings AS (SELECT p.path, i.rule_id, i.level, i.start_line, i.title FROM picked p JOIN issues i ON i.asked = p.asked)"""


_IDENTIFIED = "left(sha256(rule_id || ':' || path || ':' || start_line || ':' || title), 12) AS issue_id"
_OUT = f"path, rule_id, level, CAST(start_line AS BIGINT) AS start_line, title, {_IDENTIFIED}"


def _plain(findings):
    return findings.select("path", "rule_id", "level", F.col("start_line").cast("bigint"), "title", "issue_id")


def options(**changed):
    given = {
        "as_of": AS_OF,
        "run_id": "run-1",
        "pack_name": PACK_NAME,
        "model": "acme/deep",
        "prices": PRICES,
        "budget": None,
    }
    return Options(**{**given, **changed})


def review_with_cache(spark, sf, budgeted=True, **changed):
    """A review with a filled cache; its budget grows with the corpus: one call for every fifteen documents."""
    keyed = keyed_documents(spark, sf)
    cache = materialize(document_cache(keyed), "cache")
    budget = keyed.count() // 15 if budgeted else None
    return review(documents(spark, sf), RULES, SCORER, options(budget=budget, **changed), cache)


_PLACED = """(SELECT path, row_number() OVER (ORDER BY path) AS n FROM missed)"""
_BUDGETED = f"""{CACHE_SQL}, hit AS (SELECT k.path, f.first_rule AS rule_id, 'minor' AS level, 1 AS start_line, f.title
  FROM keyed k JOIN fresh f ON f.file_hash = k.file_hash AND f.rules_hash = k.rules_hash WHERE k.rules > 0),
missed AS (SELECT path FROM keyed k WHERE rules > 0 AND NOT EXISTS (
  SELECT 1 FROM fresh f WHERE f.file_hash = k.file_hash AND f.rules_hash = k.rules_hash)),
chosen AS (SELECT path FROM {_PLACED} WHERE n <= (SELECT count(*) // 15 FROM keyed)), {_answers_sql('chosen')},
final AS (SELECT * FROM hit UNION ALL SELECT * FROM fresh_findings)"""


_WHOLE = _BUDGETED.replace(" WHERE n <= (SELECT count(*) // 15 FROM keyed)", "")


@query("review_documents", f"{_WHOLE} SELECT {_OUT} FROM final")
def review_documents(spark, sf):
    return _plain(review_with_cache(spark, sf, budgeted=False).findings)


@query("review_budgeted", f"{_BUDGETED} SELECT {_OUT} FROM final")
def review_budgeted(spark, sf):
    return _plain(review_with_cache(spark, sf).findings)


@query(
    "review_filtered",
    f"""WITH {DOCS}, {applicable_sql('docs', [r for r in RULES if 'legal' in r.rule_id])}, {_answers_sql('docs')}
SELECT {_OUT} FROM fresh_findings WHERE rule_id LIKE '%legal%'""",
)
def review_filtered(spark, sf):
    opts = options(rule_filter=("legal",), disabled_rules=("general/reviewed",))
    return _plain(review(documents(spark, sf), RULES, SCORER, opts).findings)


@query(
    "review_run_meta",
    f"""{_BUDGETED} SELECT CAST(count(*) AS BIGINT) AS files_analyzed, CAST(count(*) FILTER (rules = 0) AS BIGINT) AS skipped,
  CAST((SELECT count(*) FROM hit) AS BIGINT) AS cache_hits, CAST((SELECT count(*) FROM chosen) AS BIGINT) AS llm_calls,
  CAST((SELECT count(*) FROM missed) - (SELECT count(*) FROM chosen) AS BIGINT) AS deferred FROM keyed""",
)
def review_run_meta(spark, sf):
    return review_with_cache(spark, sf, snippets=False).run_meta.drop("cost_usd")


@query(
    "review_deferred",
    f"{_BUDGETED} SELECT path FROM missed WHERE path NOT IN (SELECT path FROM chosen)",
)
def review_deferred(spark, sf):
    return review_with_cache(spark, sf, snippets=False).deferred.select("path")


@query(
    "review_new_cache",
    f"""{_BUDGETED}, kept AS (SELECT k.file_hash, k.rules_hash, k.path, (SELECT count(*) FROM issues i WHERE i.asked = p.asked)
    + CASE WHEN p.asked = 'tone/insult' THEN 1 ELSE 0 END AS n
  FROM chosen c JOIN keyed k ON k.path = c.path JOIN picked p ON p.path = c.path
  WHERE p.asked IS NULL OR p.asked <> 'quality/symbol-junk')
SELECT file_hash, rules_hash, CAST(max(n) AS BIGINT) AS findings FROM kept GROUP BY 1, 2""",
)
def review_new_cache(spark, sf):
    entries = review_with_cache(spark, sf, snippets=False).new_cache
    return entries.select("file_hash", "rules_hash", F.size("findings").cast("bigint").alias("findings"))


_META_SQL = """SELECT CAST(count(*) AS BIGINT) AS files_analyzed, CAST(count(*) FILTER (rules = 0) AS BIGINT) AS skipped,
  CAST((SELECT count(*) FROM hit) AS BIGINT) AS cache_hits, CAST((SELECT count(*) FROM missed) AS BIGINT) AS llm_calls,
  CAST(0 AS BIGINT) AS deferred FROM keyed"""


@query("review_run_meta_whole", f"{_WHOLE} {_META_SQL}")
def review_run_meta_whole(spark, sf):
    return review_with_cache(spark, sf, budgeted=False, snippets=False).run_meta.drop("cost_usd")


@query(
    "review_new_cache_whole",
    f"""{_WHOLE}, kept AS (SELECT k.file_hash, k.rules_hash, k.path, (SELECT count(*) FROM issues i WHERE i.asked = p.asked)
    + CASE WHEN p.asked = 'tone/insult' THEN 1 ELSE 0 END AS n
  FROM missed c JOIN keyed k ON k.path = c.path JOIN picked p ON p.path = c.path
  WHERE p.asked IS NULL OR p.asked <> 'quality/symbol-junk')
SELECT file_hash, rules_hash, CAST(max(n) AS BIGINT) AS findings FROM kept GROUP BY 1, 2""",
)
def review_new_cache_whole(spark, sf):
    entries = review_with_cache(spark, sf, budgeted=False, snippets=False).new_cache
    return entries.select("file_hash", "rules_hash", F.size("findings").cast("bigint").alias("findings"))


@query(
    "review_pages",
    f"""WITH {PAGES}, {applicable_sql('web')}, {_answers_sql('web')},
lines AS (SELECT path, unnest(string_split(content, chr(10))[1:3]) AS line,
  generate_subscripts(string_split(content, chr(10))[1:3], 1) AS n FROM web),
snips AS (SELECT path, string_agg(CASE n WHEN 1 THEN '>' ELSE ' ' END || '    ' || n || ' | ' || line, chr(10) ORDER BY n) AS snippet
  FROM lines GROUP BY 1)
SELECT {_OUT.replace('path,', 'f.path,', 1).replace('|| path ||', '|| f.path ||')}, sha256(snippet) AS snippet_sha
FROM fresh_findings f JOIN snips s ON s.path = f.path""",
)
def review_pages(spark, sf):
    found = review(pages(spark, sf), RULES, SCORER, options()).findings
    return found.select(
        "path",
        "rule_id",
        "level",
        F.col("start_line").cast("bigint"),
        "title",
        "issue_id",
        F.sha2("snippet", 256).alias("snippet_sha"),
    )


@query("review_chats", f"WITH {CHATS}, {applicable_sql('chats')}, {_answers_sql('chats')} SELECT {_OUT} FROM fresh_findings")
def review_chats(spark, sf):
    return _plain(review(chats(spark, sf), RULES, SCORER, options()).findings)


@query(
    "review_changed",
    f"""WITH {DOCS}, later AS ({_LATER}), changed AS (SELECT n.path, n.content FROM later n LEFT JOIN docs o ON o.path = n.path
  WHERE o.path IS NULL OR rtrim(o.content) <> rtrim(n.content)), {applicable_sql('changed')}, {_answers_sql('changed')}
SELECT {_OUT} FROM fresh_findings""",
)
def review_of_changes(spark, sf):
    result = review_changed(documents(spark, sf), later(spark, sf), RULES, SCORER, options())
    return _plain(result.findings)


@query(
    "review_changed_lines",
    f"""WITH {EDITED}, changed AS (SELECT DISTINCT path, array_to_string(ls, chr(10)) AS content, is_new FROM changed_lines),
{applicable_sql('changed')}, {_answers_sql('changed')}
SELECT f.path, is_new, rule_id, CAST(start_line AS BIGINT) AS start_line, title FROM fresh_findings f JOIN changed c ON c.path = f.path
WHERE EXISTS (SELECT 1 FROM changed_lines x WHERE x.path = f.path AND x.line = f.start_line)""",
)
def review_of_changed_lines(spark, sf):
    """The canned answers point at lines 1 and 2; only those on lines that were edited or are new stay."""
    result = review_changed(documents(spark, sf), edited(spark, sf), RULES, SCORER, options(), changed_lines_only=True)
    found = result.findings.join(result.changes.select("path", "is_new"), "path")
    return found.select("path", "is_new", "rule_id", F.col("start_line").cast("bigint").alias("start_line"), "title")


# Many texts under one path, and texts without a path: a row is its path and its text.
_REPEATED = f"""WITH {DOCS}, dup AS (
  SELECT CASE WHEN doc_id % 17 <> 0 THEN source || '/' || lang || '.txt' END AS path, content, doc_id FROM docs),
{applicable_sql('dup').replace('SELECT path,', 'SELECT doc_id,')},
keyed AS (SELECT DISTINCT path, CASE WHEN n > 0 THEN {hash_sql('content')} END AS file_hash, coalesce(n, 0) > 0 AS due
  FROM dup LEFT JOIN (SELECT doc_id, count(*) AS n FROM applicable GROUP BY 1) USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY due ORDER BY path NULLS FIRST, file_hash) AS n FROM keyed),
judged AS (SELECT path, file_hash, CASE WHEN NOT due THEN 'skip' WHEN n <= (SELECT count(*) // 3 FROM keyed) THEN 'scored' ELSE 'deferred' END
  AS outcome FROM placed)"""


def _review_repeated(spark, sf):
    docs = documents(spark, sf)
    doc_id = F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("bigint")
    path = F.when(doc_id % 17 != 0, F.regexp_replace("path", r"/[0-9]+\.txt$", ".txt"))
    corpus = materialize(docs.select(path.alias("path"), "content"), "repeated")
    keyed = with_cache_key(match_rules(corpus, RULES)).select("path", "file_hash").distinct()
    return review(corpus, RULES, SCORER, options(budget=keyed.count() // 3, snippets=False))


@query("review_repeated_paths", f"{_REPEATED} SELECT path, file_hash, outcome FROM judged")
def review_repeated_paths(spark, sf):
    """Every row has one outcome: skipped, scored or deferred."""
    result = _review_repeated(spark, sf)
    late = F.lit("deferred").alias("outcome")
    deferred = materialize(result.deferred, "deferred")
    rest = semi_by_key(result.statuses, deferred, ["path", "file_hash"], "left_anti")
    rest = rest.select("path", "file_hash", F.when(F.col("status") == "skip", "skip").otherwise("scored").alias("outcome"))
    return rest.unionByName(deferred.select("path", "file_hash", late))


@query(
    "review_repeated_meta",
    f"""{_REPEATED} SELECT CAST(count(*) AS BIGINT) AS files_analyzed, CAST(count(*) FILTER (outcome = 'skip') AS BIGINT) AS skipped,
  CAST(0 AS BIGINT) AS cache_hits, CAST(count(*) FILTER (outcome = 'scored') AS BIGINT) AS llm_calls,
  CAST(count(*) FILTER (outcome = 'deferred') AS BIGINT) AS deferred, CAST(count(*) FILTER (outcome = 'scored') AS BIGINT) AS usage_ids
FROM judged""",
)
def review_repeated_meta(spark, sf):
    """The run's counters, and how many different ids its calls have in the usage log."""
    result = _review_repeated(spark, sf)
    ids = result.usage.agg(F.countDistinct("id").alias("usage_ids"))
    return result.run_meta.drop("cost_usd").join(F.broadcast(ids))


# The dearest sources first, as far as the summed tokens of their texts go.
@query(
    "review_token_budget",
    f"""WITH {DOCS}, {applicable_sql('docs')},
due AS (SELECT path, doc_id % 4 AS priority, length(content) // 4 AS tokens FROM docs WHERE path IN (SELECT path FROM applicable)),
summed AS (SELECT path, tokens, sum(tokens) OVER (ORDER BY priority, path) AS upto, sum(tokens) OVER () AS whole FROM due)
SELECT path, CAST(tokens AS BIGINT) AS tokens FROM summed WHERE upto <= whole // 3""",
)
def review_token_budget(spark, sf):
    """Which rows a third of all tokens pays for, by priority and path."""
    docs = documents(spark, sf)
    doc_id = F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("bigint")
    matched = match_rules(docs.withColumn("priority", doc_id % 4), RULES).filter(F.size("rule_ids") > 0)
    due = materialize(matched.select("path", "priority", estimate_tokens(F.col("content")).alias("tokens")), "due")
    whole = due.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    chosen, _ = apply_budget(due, order=("priority", "path"), tokens=whole // 3)
    return chosen.select("path", "tokens")
