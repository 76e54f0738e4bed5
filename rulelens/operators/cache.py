"""The verdict cache: `(file_hash, rules_hash)` -> findings, as a table."""

from pyspark.sql import functions as F

from rulelens.functions.findings import findings_to_json
from rulelens.functions.text import content_hash, rules_hash
from rulelens.plans.joins import keep_listed, lookup_join
from rulelens.schemas import CACHE, CACHE_KEY, DEFAULT_TTL_HOURS


def with_cache_key(matched, salt=None):
    """Add `file_hash` and `rules_hash` to rows that have `content` and `rule_ids`.

    A row without rules is never looked up, so its text is not hashed and `file_hash` is null. The key ignores
    rule texts; pass a `salt` (say, a rule-set version) to invalidate on those too.
    """
    ids = F.col("rule_ids")
    if salt is not None:
        ids = F.concat(ids, F.array(F.lit(f"salt={salt}")))
    file_hash = F.when(F.size("rule_ids") > 0, content_hash(F.col("content")))
    return matched.withColumns({"file_hash": file_hash, "rules_hash": rules_hash(ids)})


def _instant(value):
    return F.lit(value).cast("timestamp")


def _hours_before(as_of, hours):
    return _instant(as_of) - F.expr(f"interval {int(hours)} hours")


def latest_entries(entries, order=("created_at",)):
    """One entry per key, the last by the `order` columns and then by its own values.

    A map-side aggregate, so a key with very many versions is reduced before it is shuffled.
    """
    kept = [c for c in entries.columns if c not in CACHE_KEY and c not in order]
    newest = F.max(F.struct(*order, *kept)).alias("_e")
    return entries.groupBy(*CACHE_KEY).agg(newest).select(*CACHE_KEY, "_e.*")


def fresh_entries(cache, as_of, ttl_hours=DEFAULT_TTL_HOURS):
    """Entries created strictly after `as_of - ttl`."""
    return cache.filter(F.col("created_at") > _hours_before(as_of, ttl_hours))


def triage(keyed, cache=None, as_of=None, ttl_hours=DEFAULT_TTL_HOURS):
    """Status per row: `skip` (no rule applies), `cached` (a fresh verdict exists) or `analyze`.

    Only keys are joined: rows without rules never meet the cache, and no text or finding is shuffled. For a
    small batch the cache is cut to the batch's keys at its scan. `keyed` should be a stored table; the cache
    may hold several entries per key.
    """
    with_rules = F.size("rule_ids") > 0
    if cache is None:
        return keyed.withColumn("status", F.when(with_rules, "analyze").otherwise("skip"))
    entries = fresh_entries(cache, as_of, ttl_hours).select(*CACHE_KEY)
    known = keep_listed(entries, keyed.select(*CACHE_KEY), CACHE_KEY).distinct().withColumn("_known", F.lit(True))
    skipped = keyed.filter(~with_rules).withColumn("status", F.lit("skip"))
    looked_up = lookup_join(keyed.filter(with_rules), known, CACHE_KEY, "left").withColumn(
        "status", F.when(F.col("_known"), "cached").otherwise("analyze")
    )
    return skipped.unionByName(looked_up.drop("_known"))


def cache_lookup(keyed, cache, as_of, ttl_hours=DEFAULT_TTL_HOURS):
    """Rows with a fresh verdict, with the stored `findings` and `created_at`."""
    fresh = fresh_entries(cache, as_of, ttl_hours)
    fresh = latest_entries(keep_listed(fresh, keyed.select(*CACHE_KEY), CACHE_KEY))
    return lookup_join(keyed.filter(F.size("rule_ids") > 0), fresh, CACHE_KEY, "inner")


def cache_misses(keyed, cache, as_of, ttl_hours=DEFAULT_TTL_HOURS):
    """Rows with at least one rule and no fresh verdict."""
    return triage(keyed, cache, as_of, ttl_hours).filter("status = 'analyze'").drop("status")


def cache_put(cache, new):
    """Insert-or-replace on the key: the merged cache. Parquet has no MERGE, so write it to a new folder."""
    ranked = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_entries(ranked, ("_new", "created_at")).select(CACHE.fieldNames())


def write_cache(cache, path):
    """Write a merged cache clustered by key to a folder that must not exist yet."""
    cache.repartition("file_hash").sortWithinPartitions(*CACHE_KEY).write.parquet(path)


def write_cache_table(cache, table, buckets):
    """Save as a table bucketed by key, so later lookups read it without a shuffle of the cache."""
    writer = cache.write.bucketBy(buckets, *CACHE_KEY).sortBy(*CACHE_KEY)
    writer.format("parquet").saveAsTable(table)


def cache_clear(cache, as_of, older_than_hours=None):
    """`(retained, cleared)`: clear everything, or entries created strictly before `as_of - hours`."""
    if older_than_hours is None:
        return cache.limit(0), cache
    old = F.col("created_at") < _hours_before(as_of, older_than_hours)
    return cache.filter(~old), cache.filter(old)


def cache_stats(cache):
    """Entries, logical bytes of the stored findings, oldest and newest entry."""
    text = findings_to_json(F.col("findings"))
    return cache.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.min("created_at").alias("oldest_entry"),
        F.max("created_at").alias("newest_entry"),
    )


def exact_duplicates(corpus):
    """Groups of rows with the same normalised text: hash, size and smallest path."""
    hashed = corpus.select("path", content_hash(F.col("content")).alias("file_hash"))
    groups = hashed.groupBy("file_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")
    )
    return groups.filter("copies > 1")
