"""The verdict cache, built from all documents over 30 days, against the same corpus."""

from pyspark.sql import functions as F

from queries.base import AS_OF, DOCS, RULES, applicable_sql, documents, hash_sql, query, table
from rulelens.operators.cache import (
    cache_clear,
    cache_lookup,
    cache_misses,
    cache_put,
    cache_stats,
    fresh_entries,
    latest_entries,
    triage,
    with_cache_key,
)
from rulelens.operators.match import match_rules
from rulelens.plans.generations import CacheStore
from rulelens.plans.storage import materialize, run_dir
from rulelens.schemas import CACHE, CACHED_FINDING
from rulelens.sources.corpus import spread_small

# The first entry of the cache; with AS_OF and a TTL of 168 hours, hour 552 is the edge.
_FIRST = "2024-01-01 00:00:00"
_HOURS = "doc_id * 7 % 720"


def with_doc_id(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt"))
    return spread_small(docs.select("doc_id", path.alias("path"), F.col("text").alias("content")), "path")


def keyed_documents(spark, sf):
    """Keys of all documents, stored once: the cache operators read them more than once."""
    matched = with_cache_key(match_rules(with_doc_id(spark, sf), RULES))
    return materialize(matched.drop("content"), "keyed")


def _entry_findings():
    given = {
        "rule_id": F.element_at("rule_ids", 1),
        "level": F.lit("minor"),
        "location": F.struct(
            F.col("path").alias("path"),
            F.lit(1).alias("start_line"),
            *[F.lit(None).cast("int").alias(c) for c in ("end_line", "start_col", "end_col")],
        ),
        "title": F.concat(F.lit("stored "), F.col("doc_id")),
        "why": F.lit("seen before"),
        "do": F.array(F.lit("look again")),
        "pack": F.lit("prose"),
        "source": F.lit("llm"),
        "confidence": F.lit(0.9),
        "tags": F.array().cast("array<string>"),
    }
    return F.array(F.struct(*[given[n].alias(n) for n in CACHED_FINDING.fieldNames()]))


def log_of_entries(keyed, hours=_HOURS, min_rules=1):
    """Cache entries of all documents with rules; copies of a text give several entries with one key."""
    entries = keyed.filter(F.size("rule_ids") >= min_rules)
    created = F.expr(f"timestamp'{_FIRST}' + make_interval(0, 0, 0, 0, {hours})")
    return entries.withColumns({"findings": _entry_findings(), "created_at": created}).select(CACHE.fieldNames())


def document_cache(keyed):
    return latest_entries(log_of_entries(keyed))


KEYED = f"""WITH {DOCS}, {applicable_sql('docs')}, keyed AS (
  SELECT d.path, any_value(d.doc_id) AS doc_id, count(a.rule_id) AS rules, min(a.rule_id) AS first_rule,
    any_value({hash_sql('d.content')}) AS file_hash,
    left(sha256(coalesce(string_agg(a.rule_id, ',' ORDER BY a.rule_id), '')), 32) AS rules_hash
  FROM docs d LEFT JOIN applicable a ON a.path = d.path GROUP BY d.path)"""


def entries_sql(name, hours=_HOURS, min_rules=1):
    return f"""{name} AS (SELECT file_hash, rules_hash, first_rule, path AS entry_path, 'stored ' || doc_id AS title,
  TIMESTAMP '{_FIRST}' + to_hours(CAST({hours} AS INTEGER)) AS created_at FROM keyed WHERE rules >= {min_rules})"""


CACHE_SQL = f"""{KEYED}, {entries_sql('entries')}, cache AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY file_hash, rules_hash ORDER BY created_at DESC, entry_path DESC) AS rn FROM entries) WHERE rn = 1),
fresh AS (SELECT * FROM cache WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR)"""
_SEEN = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"


def _entry(df):
    return df.select(
        "file_hash",
        "rules_hash",
        F.element_at("findings", 1)["title"].alias("title"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@query("cache_fresh", CACHE_SQL + f" SELECT file_hash, rules_hash, title, {_SEEN} FROM fresh")
def fresh(spark, sf):
    return _entry(fresh_entries(document_cache(keyed_documents(spark, sf)), AS_OF))


@query(
    "cache_hits",
    CACHE_SQL
    + """ SELECT k.path, f.first_rule AS rule_id, f.title FROM keyed k JOIN fresh f
ON f.file_hash = k.file_hash AND f.rules_hash = k.rules_hash WHERE k.rules > 0""",
)
def hits(spark, sf):
    keyed = keyed_documents(spark, sf)
    found = cache_lookup(keyed, document_cache(keyed), AS_OF)
    return found.select("path", F.explode("findings").alias("f")).select("path", "f.rule_id", "f.title")


@query(
    "cache_misses",
    CACHE_SQL
    + """ SELECT path, file_hash, rules_hash FROM keyed k WHERE rules > 0 AND NOT EXISTS (
  SELECT 1 FROM fresh f WHERE f.file_hash = k.file_hash AND f.rules_hash = k.rules_hash)""",
)
def misses(spark, sf):
    keyed = keyed_documents(spark, sf)
    return cache_misses(keyed, document_cache(keyed), AS_OF).select("path", "file_hash", "rules_hash")


TRIAGE_SQL = (
    CACHE_SQL
    + """, statuses AS (SELECT k.path, k.rules, CASE WHEN rules = 0 THEN 'skip' WHEN f.file_hash IS NULL THEN 'analyze'
  ELSE 'cached' END AS status
FROM keyed k LEFT JOIN fresh f ON f.file_hash = k.file_hash AND f.rules_hash = k.rules_hash)"""
)


def document_statuses(spark, sf):
    keyed = keyed_documents(spark, sf)
    return triage(keyed, document_cache(keyed), AS_OF)


@query("triage", TRIAGE_SQL + " SELECT path, status, CAST(rules AS BIGINT) AS rules FROM statuses")
def statuses(spark, sf):
    return document_statuses(spark, sf).select("path", "status", F.size("rule_ids").cast("bigint").alias("rules"))


# A later review of the documents that have more than one rule.
_NEWER = "doc_id * 11 % 900"


@query(
    "cache_upsert",
    f"""{CACHE_SQL}, {entries_sql('newer', _NEWER, 2)}, both_sides AS (
  SELECT *, 0 AS is_new FROM cache UNION ALL SELECT *, 1 FROM newer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_hash, rules_hash
  ORDER BY is_new DESC, created_at DESC, entry_path DESC) AS rn FROM both_sides)
SELECT file_hash, rules_hash, title, {_SEEN} FROM ranked WHERE rn = 1""",
)
def upserted(spark, sf):
    keyed = keyed_documents(spark, sf)
    return _entry(cache_put(document_cache(keyed), log_of_entries(keyed, _NEWER, 2)))


@query(
    "cache_generations",
    f"""{CACHE_SQL}, {entries_sql('newer', _NEWER, 2)}, both_sides AS (
  SELECT *, 0 AS is_new FROM cache UNION ALL SELECT *, 1 FROM newer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_hash, rules_hash
  ORDER BY is_new DESC, created_at DESC, entry_path DESC) AS rn FROM both_sides)
SELECT file_hash, rules_hash, title, {_SEEN} FROM ranked WHERE rn = 1 AND created_at > TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR""",
)
def stored_in_generations(spark, sf):
    """Two puts into a stored cache, then its old entries expire."""
    keyed = keyed_documents(spark, sf)
    store = CacheStore(spark, run_dir(spark, "cache-store"))
    store.put(document_cache(keyed))
    store.put(log_of_entries(keyed, _NEWER, 2))
    store.expire(AS_OF, 240)
    store.vacuum()
    return _entry(store.read())


@query(
    "cache_retained",
    CACHE_SQL
    + f""" SELECT file_hash, rules_hash, title, {_SEEN} FROM cache
WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR""",
)
def retained(spark, sf):
    return _entry(cache_clear(document_cache(keyed_documents(spark, sf)), AS_OF, 240)[0])


@query(
    "cache_cleared",
    CACHE_SQL + f" SELECT CAST(count(*) AS BIGINT) AS cleared FROM cache WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR",
)
def cleared(spark, sf):
    gone = cache_clear(document_cache(keyed_documents(spark, sf)), AS_OF, 240)[1]
    return gone.agg(F.count(F.lit(1)).alias("cleared"))


@query(
    "cache_stats",
    CACHE_SQL
    + """, texts AS (SELECT created_at, '[{"rule_id":"' || first_rule || '","level":"minor","location":{"path":"'
  || entry_path || '","start_line":1,"end_line":null,"start_col":null,"end_col":null},"title":"' || title
  || '","why":"seen before","do":["look again"],"pack":"prose","source":"llm","confidence":0.9,"tags":[]}]' AS js
  FROM cache)
SELECT CAST(count(*) AS BIGINT) AS entries, CAST(coalesce(sum(strlen(js)), 0) AS BIGINT) AS size_bytes,
  strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest_entry,
  strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest_entry FROM texts""",
)
def stats(spark, sf):
    one = cache_stats(document_cache(keyed_documents(spark, sf)))
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("oldest_entry", "newest_entry")]
    return one.select("entries", "size_bytes", *shown)
