"""Registry, table access and the SQL fragments that several checks share."""

from rulelens.operators.match import detect_lines
from rulelens.packs import HOUSE, PACKS
from rulelens.sources.corpus import conversations_corpus, documents_corpus, pages_corpus, spread_small
from rulelens.sources.rules import compose_rules

REGISTRY = {}

PACK_NAME, RULES = compose_rules(PACKS, [HOUSE])
AS_OF = "2024-01-31 00:00:00"


def query(name, sql=None):
    """Register `(spark, sf_dir) -> DataFrame` under a name, with its checking SQL if there is one."""

    def register(run):
        REGISTRY[name] = (run, sql)
        return run

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    return spread_small(documents_corpus(table(spark, sf, "documents")), "path")


def pages(spark, sf):
    return spread_small(pages_corpus(table(spark, sf, "pages")), "path")


def chats(spark, sf):
    return spread_small(conversations_corpus(table(spark, sf, "conversations")), "path")


def document_findings(spark, sf):
    return detect_lines(documents(spark, sf), RULES)


# ---- SQL fragments ----

DOCS = """docs AS (
  SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, doc_id, source, lang
  FROM documents)"""
PAGES = """web AS (
  SELECT 'web/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '.' || page_id
         || '.html' AS path, html AS content, page_id FROM pages)"""
CHATS = """chats AS (
  SELECT 'chat/' || conv_id || '/' || turn || '.' || role AS path, text AS content, conv_id, turn, role
  FROM conversations)"""
LINES = """lines AS (
  SELECT path, unnest(string_split(content, chr(10))) AS line,
         generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM docs)"""

WEIGHT = "CASE level WHEN 'blocker' THEN 25 WHEN 'critical' THEN 15 WHEN 'major' THEN 8 WHEN 'minor' THEN 3 ELSE 0 END"
RANK = (
    "CASE level WHEN 'blocker' THEN 0 WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 "
    "WHEN 'info' THEN 4 ELSE 5 END"
)


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _likes(globs):
    """Our globs only use stars, which is what LIKE's % does."""
    if not globs:
        return "true"
    return "(" + " OR ".join(f"path LIKE {quoted(g.replace('*', '%'))}" for g in globs) + ")"


def _regexes(column, patterns):
    if not patterns:
        return "true"
    # The end of the text is `\\Z` in our rules and `\\z` here.
    tests = [f"regexp_matches({column}, {quoted(p.replace(chr(92) + 'Z', chr(92) + 'z'))})" for p in patterns]
    return "(" + " OR ".join(tests) + ")"


def applicable_sql(source, rules=None, name="applicable", by_path=True, by_content=True):
    """CTE `(path, rule_id)` of the rules that apply to the rows of `source`."""
    arms = [
        f"SELECT path, {quoted(r.rule_id)} AS rule_id FROM {source} WHERE "
        f"{_likes(r.file_patterns) if by_path else 'true'} AND "
        f"{_regexes('content', r.code_patterns) if by_content else 'true'}"
        for r in (RULES if rules is None else rules)
    ]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(arms) + ")"


def findings_sql(rules=None):
    """CTEs `lines` and `findings` of the line detector over `docs`."""
    arms = [
        f"SELECT path, line_no, {quoted(r.rule_id)} AS rule_id, {quoted(r.level)} AS level, "
        f"{quoted(r.name)} AS title, {quoted(r.description)} AS why, {quoted(r.pack)} AS pack "
        f"FROM lines WHERE {_likes(r.file_patterns)} AND {_regexes('line', r.code_patterns)}"
        for r in (RULES if rules is None else rules)
        if r.code_patterns
    ]
    hits = "hits AS (\n  " + "\n  UNION ALL ".join(arms) + ")"
    return f"""{LINES},
{hits},
findings AS (
  SELECT left(sha256(rule_id || ':' || path || ':' || line_no || ':' || title), 12) AS issue_id,
         CAST(line_no AS BIGINT) AS start_line, rule_id, path, level, title, why, pack FROM hits)"""


FINDINGS = f"WITH {DOCS},\n{findings_sql()}"

CAPPED = f"""capped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY {RANK}, start_line, rule_id, issue_id) AS rn
    FROM findings) WHERE rn <= 10)"""

PARTED = f"""parted AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY path ORDER BY {RANK}, start_line, rule_id, issue_id) - 1) // 10000
            AS BIGINT) AS part FROM findings)"""


def rules_sql(rules=None):
    """CTE `rules` with the rule table."""
    rows = ",\n  ".join(
        f"({quoted(r.rule_id)}, {quoted(r.pack)}, {quoted(r.name)}, {quoted(r.level)}, {quoted(r.category)}, "
        f"{quoted(r.fix)}, {quoted(','.join(r.tags))})"
        for r in (RULES if rules is None else rules)
    )
    return f"rules(rule_id, pack, name, level, category, fix, tags) AS (VALUES\n  {rows})"


def hash_sql(column):
    """Normalised content hash; the tables hold no line breaks other than LF and no blanks other than space."""
    return (
        f"left(sha256(rtrim(regexp_replace({column}, '[ \\t]+(\\n|$)', '\\1', 'g'), chr(10)) || chr(10)), 32)"
    )
