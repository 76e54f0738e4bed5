"""Corpus scans, path filters, rule matching and text scalars."""

from pyspark.sql import functions as F

from queries.base import (
    CHATS,
    DOCS,
    FINDINGS,
    PAGES,
    RULES,
    applicable_sql,
    chats,
    document_findings,
    documents,
    hash_sql,
    pages,
    query,
    table,
)
from rulelens.functions.findings import level_norm, level_rank, level_weight
from rulelens.functions.text import cache_key, content_hash, line_count, normalize_text, rules_hash
from rulelens.operators.cache import exact_duplicates
from rulelens.operators.match import applicable_rules, content_matches, match_rules, path_matches
from rulelens.plans.storage import run_dir
from rulelens.sources.corpus import drop_ignored, exclude_paths, include_paths
from rulelens.sources.files import read_text_files, write_text_files


def _everything(spark, sf):
    return documents(spark, sf).union(pages(spark, sf)).union(chats(spark, sf))


ALL_ROWS = f"""WITH {DOCS}, {PAGES}, {CHATS}, everything AS (
  SELECT path, content FROM docs UNION ALL SELECT path, content FROM web UNION ALL SELECT path, content FROM chats)
"""


@query(
    "corpus_scan",
    ALL_ROWS
    + """SELECT path, CAST(length(content) AS BIGINT) AS n_chars,
  CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS n_lines,
  sha256(content) AS sha FROM everything""",
)
def corpus_scan(spark, sf):
    content = F.col("content")
    return _everything(spark, sf).select(
        "path",
        F.length(content).cast("bigint").alias("n_chars"),
        line_count(content).cast("bigint").alias("n_lines"),
        F.sha2(content, 256).alias("sha"),
    )


# Paths with hidden, vendored and navigation components, derived from the document number.
_SPOILT = """CASE CAST(split_part(split_part(path, '/', 3), '.', 1) AS BIGINT) % 8
  WHEN 0 THEN '.git/' WHEN 1 THEN 'a/__pycache__/' WHEN 2 THEN 'node_modules/x/' WHEN 3 THEN 'venv/'
  WHEN 4 THEN './' WHEN 5 THEN '../' WHEN 6 THEN 'a/.venv/' ELSE 'venv2/' END || path"""


@query(
    "drop_ignored",
    f"""WITH {DOCS}, spoilt AS (SELECT {_SPOILT} AS path FROM docs)
SELECT path FROM spoilt WHERE NOT regexp_matches(path, '(^|/)\\.[^./]')
  AND NOT regexp_matches(path, '(^|/)(__pycache__|node_modules|venv)(/|$)')""",
)
def drop_ignored_paths(spark, sf):
    spoilt = documents(spark, sf).select(F.expr(_SPOILT).alias("path"))
    return drop_ignored(spoilt)


@query(
    "exclude_paths",
    f"""WITH {DOCS} SELECT path FROM docs
WHERE source <> 'src3' AND NOT (source LIKE 'src1%' AND lang = 'fr') AND doc_id % 10 <> 9
  AND NOT (source = 'src5' AND lang = 'es')""",
)
def excluded(spark, sf):
    globs = ["src3", "src1*/fr", "*9.txt", "src[5]/?s/*"]
    return exclude_paths(documents(spark, sf).select("path"), globs)


@query(
    "include_paths",
    f"""WITH {DOCS} SELECT path FROM docs WHERE (source = 'src1' AND lang = 'en') OR source = 'src12'""",
)
def included(spark, sf):
    return include_paths(documents(spark, sf).select("path"), ["src1/en", "./src12/"])


@query(
    "applicable_rules",
    ALL_ROWS + f", {applicable_sql('everything')} SELECT path, rule_id FROM applicable",
)
def applicable(spark, sf):
    return applicable_rules(_everything(spark, sf), RULES)


@query(
    "applicable_rules_batches",
    ALL_ROWS + f", {applicable_sql('everything')} SELECT path, rule_id FROM applicable",
)
def applicable_in_batches(spark, sf):
    """Few rules to a projection, so that several follow each other."""
    return applicable_rules(_everything(spark, sf), RULES, chunk=4)


@query(
    "path_trigger",
    ALL_ROWS + f", {applicable_sql('everything', by_content=False)} SELECT path, rule_id FROM applicable",
)
def by_path(spark, sf):
    return path_matches(_everything(spark, sf), RULES)


@query(
    "content_trigger",
    ALL_ROWS + f", {applicable_sql('everything', by_path=False)} SELECT path, rule_id FROM applicable",
)
def by_content(spark, sf):
    return content_matches(_everything(spark, sf), RULES)


@query("detect_lines", FINDINGS + " SELECT path, start_line, rule_id, level, title, pack, issue_id FROM findings")
def detected(spark, sf):
    found = document_findings(spark, sf)
    return found.select(
        "path", F.col("start_line").cast("bigint"), "rule_id", "level", "title", "pack", "issue_id"
    )


# Text with every kind of trailing blank, to give the normaliser something to do.
@query(
    "normalize_text",
    f"""WITH {DOCS} SELECT path,
  CAST(length(rtrim(content, chr(10)) || chr(10)) AS BIGINT) AS n_chars,
  sha256(rtrim(content, chr(10)) || chr(10)) AS sha FROM docs""",
)
def normalized(spark, sf):
    untidy = F.concat(F.replace("content", F.lit("\n"), F.lit(" \t\r\n")), F.lit("　\n\n \n"))
    tidy = normalize_text(untidy)
    return documents(spark, sf).select(
        "path", F.length(tidy).cast("bigint").alias("n_chars"), F.sha2(tidy, 256).alias("sha")
    )


@query("content_hash", ALL_ROWS + f"SELECT path, {hash_sql('content')} AS file_hash FROM everything")
def hashed(spark, sf):
    return _everything(spark, sf).select("path", content_hash(F.col("content")).alias("file_hash"))


@query(
    "exact_duplicates",
    ALL_ROWS
    + f"""SELECT {hash_sql('content')} AS file_hash, CAST(count(*) AS BIGINT) AS copies, min(path) AS first_path
FROM everything GROUP BY 1 HAVING count(*) > 1""",
)
def duplicates(spark, sf):
    return exact_duplicates(_everything(spark, sf))


_RULE_IDS = """ids AS (
  SELECT e.path, e.content, coalesce(string_agg(a.rule_id, ',' ORDER BY a.rule_id), '') AS ids
  FROM everything e LEFT JOIN applicable a ON a.path = e.path GROUP BY 1, 2)"""


@query(
    "rules_hash",
    ALL_ROWS + f", {applicable_sql('everything')}, {_RULE_IDS} SELECT path, left(sha256(ids), 32) AS rules_hash FROM ids",
)
def hashed_rules(spark, sf):
    matched = match_rules(_everything(spark, sf), RULES)
    return matched.select("path", rules_hash(F.col("rule_ids")).alias("rules_hash"))


@query(
    "cache_key",
    ALL_ROWS
    + f""", {applicable_sql('everything')}, {_RULE_IDS}
SELECT path, {hash_sql('content')} || ':' || left(sha256(ids), 32) AS cache_key FROM ids""",
)
def keys(spark, sf):
    matched = match_rules(_everything(spark, sf), RULES)
    return matched.select("path", cache_key(F.col("content"), F.col("rule_ids")).alias("cache_key"))


_RAW_LEVEL = """CASE doc_id % 7 WHEN 0 THEN 'BLOCKER' WHEN 1 THEN 'Critical' WHEN 2 THEN 'major' WHEN 3 THEN 'minor'
  WHEN 4 THEN '' WHEN 5 THEN 'fatal' END"""


@query(
    "level_norm",
    f"""WITH raw AS (SELECT doc_id, {_RAW_LEVEL} AS raw FROM documents), norm AS (SELECT doc_id,
  CASE WHEN lower(raw) IN ('blocker','critical','major','minor','info') THEN lower(raw) ELSE 'info' END AS level FROM raw)
SELECT doc_id, level,
  CAST(CASE level WHEN 'blocker' THEN 0 WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END AS BIGINT) AS rank,
  CAST(CASE level WHEN 'blocker' THEN 25 WHEN 'critical' THEN 15 WHEN 'major' THEN 8 WHEN 'minor' THEN 3 ELSE 0 END AS BIGINT) AS weight
FROM norm""",
)
def levels(spark, sf):
    norm = table(spark, sf, "documents").select("doc_id", level_norm(F.expr(_RAW_LEVEL)).alias("level"))
    return norm.select(
        "doc_id",
        "level",
        level_rank(F.col("level")).cast("bigint").alias("rank"),
        level_weight(F.col("level")).cast("bigint").alias("weight"),
    )


# Every document as a file; of ten one each lies in a hidden folder, in an ignored folder, is named with an underscore, has
# another suffix, is hidden itself, or is no UTF-8.
@query(
    "corpus_tree",
    """WITH named AS (SELECT doc_id, text, 'src/' || source || '/' || CASE doc_id % 10 WHEN 0 THEN '.hidden/' WHEN 1 THEN 'node_modules/'
  WHEN 2 THEN '_' WHEN 4 THEN '.' ELSE '' END || doc_id || CASE doc_id % 10 WHEN 3 THEN '.md' ELSE '.py' END AS path FROM documents)
SELECT path, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_sha FROM named
WHERE doc_id % 10 NOT IN (0, 1, 3, 4, 5)""",
)
def corpus_tree(spark, sf):
    doc_id = F.col("doc_id")
    kind = doc_id % 10
    folder = F.when(kind == 0, ".hidden/").when(kind == 1, "node_modules/").when(kind == 2, "_").when(kind == 4, ".").otherwise("")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), folder, doc_id.cast("string"), F.when(kind == 3, ".md").otherwise(".py"))
    text = F.col("text").cast("binary")
    content = F.when(kind == 5, F.concat(text, F.lit(b"\xff"))).otherwise(text)
    root = run_dir(spark, "tree")
    write_text_files(table(spark, sf, "documents").select(path.alias("path"), content.alias("content")), root)
    found = read_text_files(spark, root)
    return found.select("path", F.sha2("content", 256).alias("content_sha"))
