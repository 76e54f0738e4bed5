"""Scores, counts and coverage over findings."""

from pyspark.sql import functions as F

from rulelens.functions.findings import level_weight
from rulelens.schemas import MAX_SCORE


def _score(penalty):
    """Points left of the maximum; `greatest` skips a null, so no findings needs its own zero."""
    return F.greatest(F.lit(0), F.lit(MAX_SCORE) - F.coalesce(penalty, F.lit(0))).cast("bigint")


def score(findings):
    """One row: the score of all findings together; 100 without any."""
    return findings.agg(_score(F.sum(level_weight(F.col("level")))).alias("score"))


def _points(findings, corpus, keys):
    """Corpus and findings as one narrow table of penalty points, so that one aggregate covers both and rows
    without findings keep their full score. Texts are not read and nothing is joined."""
    base = corpus.select(*keys, F.lit(0).alias("_points"), F.lit(1).alias("_rows"), F.lit(0).alias("_found"))
    hits = findings.select(
        *keys, level_weight(F.col("level")).alias("_points"), F.lit(0).alias("_rows"), F.lit(1).alias("_found")
    )
    return base.unionByName(hits)


def score_by(findings, corpus, keys):
    """Score per key, for keys that occur in the corpus. `keys` are `(name, SQL expression)` pairs or column
    names; both must hold for findings and corpus alike."""
    named = [k if isinstance(k, str) else F.expr(k[1]).alias(k[0]) for k in keys]
    names = [k if isinstance(k, str) else k[0] for k in keys]
    grouped = _points(findings, corpus, named).groupBy(*names)
    return _scored(grouped).filter("corpus_rows > 0")


def score_rollup(findings, corpus, keys):
    """Scores for each prefix of the keys and the grand total, in one rollup."""
    named = [k if isinstance(k, str) else F.expr(k[1]).alias(k[0]) for k in keys]
    names = [k if isinstance(k, str) else k[0] for k in keys]
    # Pre-aggregate to the finest keys first, so the rollup expands few rows.
    fine = _points(findings, corpus, named).groupBy(*names).agg(
        *[F.sum(c).alias(c) for c in ("_points", "_rows", "_found")]
    )
    return _scored(fine.rollup(*names))


def _scored(grouped):
    return grouped.agg(
        F.sum("_rows").cast("bigint").alias("corpus_rows"),
        F.sum("_found").cast("bigint").alias("findings"),
        F.sum("_points").cast("bigint").alias("penalty"),
        _score(F.sum("_points")).alias("score"),
    )


def counts_by_level(findings):
    return findings.groupBy("level").agg(F.count(F.lit(1)).alias("findings"))


def summary(findings):
    """One row: score, maximum, total and a level -> count map."""
    per_level = counts_by_level(findings).withColumn("_w", level_weight(F.col("level")) * F.col("findings"))
    entries = F.array_sort(F.collect_list(F.struct("level", "findings")))
    return per_level.agg(
        _score(F.sum("_w")).alias("score"),
        F.lit(MAX_SCORE).cast("bigint").alias("max_score"),
        F.coalesce(F.sum("findings"), F.lit(0)).cast("bigint").alias("total_issues"),
        F.map_from_entries(entries).alias("counts"),
    )


def run_meta(statuses, calls=None):
    """One row of run counters over a status table and the scorer calls (`cost_usd` per call) of the run.

    All scanned rows count as analyzed, also those skipped or over budget. Both tables are stacked for one
    aggregate; an empty scan gives zeros.
    """
    rows = statuses.select("status", F.lit(0.0).alias("cost_usd"))
    if calls is not None:
        rows = rows.unionByName(calls.select(F.lit("call").alias("status"), F.col("cost_usd").cast("double")))
    status = F.col("status")
    return rows.agg(
        F.count_if(status != "call").alias("files_analyzed"),
        F.count_if(status == "skip").alias("skipped"),
        F.count_if(status == "cached").alias("cache_hits"),
        F.count_if(status == "call").alias("llm_calls"),
        (F.count_if(status == "analyze") - F.count_if(status == "call")).alias("deferred"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )


def rule_coverage(applicable, findings, rules):
    """Per pack and rule, with pack and grand totals: rows it applies to, findings, rows with a finding.

    `rules` is the rule table; rules that never fire stay in with zeros.
    """
    hits = findings.groupBy("rule_id", "path").agg(F.count(F.lit(1)).alias("_n"))
    per_rule = applicable.select("rule_id", F.lit(1).alias("_applies"), F.lit(0).alias("_n"), F.lit(0).alias("_hit"))
    per_rule = per_rule.unionByName(
        hits.select("rule_id", F.lit(0).alias("_applies"), "_n", F.lit(1).alias("_hit"))
    )
    per_rule = per_rule.groupBy("rule_id").agg(*[F.sum(c).alias(c) for c in ("_applies", "_n", "_hit")])
    # One row per rule on both sides by now.
    full = rules.select("pack", "rule_id").join(per_rule, "rule_id", "left")
    total = {"_applies": "applies_to", "_n": "findings", "_hit": "rows_hit"}
    return full.rollup("pack", "rule_id").agg(
        F.count(F.lit(1)).alias("rules"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for c, name in total.items()],
        F.count_if(F.coalesce(F.col("_n"), F.lit(0)) == 0).alias("silent_rules"),
    )
