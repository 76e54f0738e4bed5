"""Findings: selection, dedup, the per-path cap, joins with rules and text."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulelens.functions.findings import level_rank
from rulelens.functions.patterns import any_of
from rulelens.functions.text import content_hash, snippet, split_lines
from rulelens.plans.joins import keep_listed, lookup_join
from rulelens.plans.ranks import numbered
from rulelens.schemas import MAX_FINDINGS_PER_PATH

# Findings of one path that are put into one row.
PART_ROWS = 10_000


def filter_rules(findings, needles):
    """Keep findings whose rule id contains any needle; no needles keep all."""
    return findings.filter(any_of([F.col("rule_id").contains(n) for n in needles])) if needles else findings


def drop_disabled(findings, ids):
    """Drop findings of rules disabled by exact id."""
    return findings.filter(~F.col("rule_id").isin(list(ids))) if ids else findings


def findings_of_packs(findings, known, include=None, exclude=None):
    """Findings of the chosen packs; exclusion comes last, a name not in `known` is an error."""
    for name in include or ():
        if name not in known:
            raise ValueError(f"unknown pack: {name}")
    if include is not None:
        findings = findings.filter(F.col("pack").isin([n for n in include if n not in set(exclude or ())]))
    elif exclude:
        findings = findings.filter(~F.col("pack").isin(list(exclude)))
    return findings


def _of_rules(findings, rules, condition):
    """Findings of the rules that meet a condition. How the rule table gets there is left to its measured size."""
    return findings.join(rules.filter(condition).select("rule_id"), "rule_id", "left_semi")


def findings_by_tag(findings, rules, tag):
    return _of_rules(findings, rules, F.array_contains("tags", tag))


def findings_by_category(findings, rules, category):
    return _of_rules(findings, rules, F.col("category") == category)


def findings_by_level(findings, level):
    return findings.filter(F.col("level") == level)


def findings_for_rule(findings, needle):
    """Findings of a rule named by its id or by the part after a slash."""
    rule = F.col("rule_id")
    return findings.filter((rule == needle) | rule.endswith("/" + needle))


def all_findings(cached, fresh):
    """Cached and fresh findings together, marked by origin; nothing is deduplicated here."""
    return cached.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))


def dedup_findings(findings):
    """One finding per `(path, issue_id)`: cached before fresh, then higher confidence, then smallest values.

    A map-side minimum instead of a window: copies collapse before the shuffle, so a finding repeated any
    number of times never gathers in one task.
    """
    columns = findings.columns
    cached = F.col("cached") if "cached" in columns else F.lit(False)
    rest = [c for c in columns if c not in ("path", "issue_id")]
    best = F.min(F.struct((~cached).alias("_fresh"), (-F.col("confidence")).alias("_doubt"), *rest)).alias("_b")
    return findings.groupBy("path", "issue_id").agg(best).select("path", "issue_id", "_b.*").select(columns)


def limit_per_path(findings, n=MAX_FINDINGS_PER_PATH):
    """The n most severe findings of each path (all if n is None); ties go by line, rule and id.

    The rank filter lets Spark cut each task's groups to n rows before the shuffle.
    """
    order = [level_rank(F.col("level")), F.col("start_line"), F.col("rule_id"), F.col("issue_id")]
    if n is None:
        return findings
    ranked = findings.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*order)))
    return ranked.filter(F.col("_n") <= n).drop("_n")


def in_parts(findings, part_rows=PART_ROWS):
    """Number the parts (`part`, from 0) of each path's findings, most severe first: no group exceeds a part.

    Findings are ranked in ranges, so that the findings of one path, however many, are spread over tasks.
    """
    ranked = findings.withColumn("_level", level_rank(F.col("level")))
    placed = numbered(ranked, "path", ["_level", "start_line", "rule_id", "issue_id"], "_place")
    return placed.withColumn("part", F.floor(F.col("_place") / part_rows).cast("int")).drop("_level", "_place")


def findings_by_path(findings, part_rows=PART_ROWS):
    """All findings of each path, most severe first: `(path, part, findings, entries)`, one row unless they are very many."""
    kept = in_parts(findings, part_rows)
    entry = F.struct(
        level_rank(F.col("level")).alias("rank"), "start_line", "rule_id", "issue_id", "level", "title"
    )
    return kept.groupBy("path", "part").agg(
        F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_list(entry)).alias("entries")
    )


def attach_snippet(findings, corpus):
    """Fill `snippet` with the numbered lines around each finding.

    If few paths have findings, all other texts are dropped at the scan and never shuffled; a path with very
    many findings is split over tasks. `findings` is read several times, so pass a stored table. With a `file_hash`
    column the text is the one of that hash, else a path is taken to have one text.
    """
    on = ["path", "file_hash"] if "file_hash" in findings.columns else ["path"]
    hashed = corpus.withColumn("file_hash", content_hash(F.col("content")))
    texts = hashed.select(*on, split_lines(F.col("content")).alias("_lines"))
    reviewed = keep_listed(texts, findings.select(*on), on)
    # Of several texts the smallest is shown, so that no finding is multiplied.
    reviewed = reviewed.groupBy(*on).agg(F.min("_lines").alias("_lines"))
    joined = lookup_join(findings.drop("snippet"), reviewed, on, "left", spread=("issue_id",), rows_per_task=100_000)
    text = snippet(F.col("_lines"), F.col("start_line"), F.col("end_line"))
    return joined.withColumn("snippet", text).drop("_lines").select(findings.columns)


def enrich_findings(findings, rules):
    """Findings with their rule's name, category, fix and checklist, which are null for a rule that is not in the table."""
    extra = rules.select(
        "rule_id", F.col("name").alias("rule_name"), "category", "fix", F.col("checklist").alias("rule_checklist")
    )
    return findings.join(extra, "rule_id", "left")
