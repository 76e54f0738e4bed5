"""Which rules apply to which rows, and which lines they hit.

Rules are few and rows are many, so rules become literals of one projection: no join and no shuffle.
"""

from dataclasses import replace

from pyspark.sql import functions as F

from rulelens.functions.findings import with_issue_id
from rulelens.functions.patterns import content_trigger, java_pattern, path_trigger, sql_text
from rulelens.functions.text import split_lines
from rulelens.schemas import FINDING_COLUMNS, FINDINGS
from rulelens.sources.rules import rules_df

# Rules compiled into one projection; more rules take one projection after another over the same row.
CHUNK_RULES = 250


def _by_globs(rules):
    groups = {}
    for rule in rules:
        groups.setdefault(tuple(rule.file_patterns), []).append(rule)
    return groups


def _hits(tests):
    """SQL for the array of ids whose test holds; `tests` are `(predicate, id)`."""
    cases = ", ".join(f"CASE WHEN {test} THEN {sql_text(rule_id)} END" for test, rule_id in tests)
    return f"array_compact(array({cases}))"


def rule_ids_column(path, content, rules):
    """Sorted array of the ids of all rules that apply, from two column names. Each distinct glob list is
    tested once per row, and the regexes behind it only where it matches."""
    none = "cast(array() AS array<string>)"
    arrays = [
        f"CASE WHEN {path_trigger(path, globs)} THEN "
        + _hits((content_trigger(content, r.code_patterns), r.rule_id) for r in group)
        + f" ELSE {none} END"
        for globs, group in _by_globs(rules).items()
    ]
    return F.expr(f"array_sort(concat({', '.join(arrays)}))" if arrays else none)


def check_patterns(spark, rules):
    """Raise for a content regex that Spark cannot compile, naming its rule, before any row is read."""
    compile_pattern = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    for rule in rules:
        for pattern in rule.code_patterns:
            try:
                compile_pattern(java_pattern(pattern))
            except Exception as error:
                raise ValueError(f"rule {rule.rule_id}: pattern {pattern!r} cannot be compiled") from error


def match_rules(corpus, rules, chunk=CHUNK_RULES):
    """The corpus with the sorted `rule_ids` that apply. A null path or content meets no trigger that looks at it."""
    check_patterns(corpus.sparkSession, rules)
    columns = corpus.columns
    rows = corpus.withColumn("rule_ids", F.array().cast("array<string>"))
    for at in range(0, len(rules), chunk):
        ids = F.concat("rule_ids", rule_ids_column("path", "content", rules[at : at + chunk]))
        # A generated column is computed once: later filters on it cannot be pushed down into a second copy.
        rows = rows.select(*columns, F.explode(F.array(ids)).alias("rule_ids"))
    return rows.withColumn("rule_ids", F.array_sort("rule_ids")) if len(rules) > chunk else rows


def applicable_rules(corpus, rules, chunk=CHUNK_RULES):
    """`(path, rule_id)` for every rule whose path and content triggers both hold."""
    return match_rules(corpus, rules, chunk).select("path", F.explode("rule_ids").alias("rule_id"))


def path_matches(corpus, rules):
    """`(path, rule_id)` by path trigger alone."""
    return applicable_rules(corpus.select("path", F.lit("").alias("content")), [_only(r, "path") for r in rules])


def content_matches(corpus, rules):
    """`(path, rule_id)` by content trigger alone."""
    return applicable_rules(corpus, [_only(r, "content") for r in rules])


def _only(rule, side):
    return replace(rule, code_patterns=()) if side == "path" else replace(rule, file_patterns=())


def detect_lines(corpus, rules):
    """A deterministic analyzer: one finding per line and rule whose content regex is found in the line.

    Path triggers are tested once per row; rules without a content regex have no line to report.
    """
    spark = corpus.sparkSession
    rules = [r for r in rules if r.code_patterns]
    if not rules:
        return spark.createDataFrame([], FINDINGS)
    groups = list(_by_globs(rules).items())
    active = [F.expr(path_trigger("path", globs)).alias(f"_on{i}") for i, (globs, _) in enumerate(groups)]
    lines = corpus.select("path", *active, F.posexplode(split_lines(F.col("content"))).alias("_pos", "_line"))
    hits = _hits(
        (f"_on{i} AND {content_trigger('_line', rule.code_patterns)}", rule.rule_id)
        for i, (_, group) in enumerate(groups)
        for rule in group
    )
    found = lines.select(
        "path", (F.col("_pos") + 1).cast("int").alias("start_line"), F.explode_outer(F.expr(hits)).alias("rule_id")
    ).filter("rule_id is not null")
    table = rules_df(spark, rules).select(
        "rule_id",
        "level",
        F.col("name").alias("title"),
        F.col("description").alias("why"),
        F.col("checklist").alias("do"),
        "pack",
        "tags",
    )
    nulls = {
        name: F.lit(None).cast(FINDINGS[name].dataType)
        for name in ("end_line", "start_col", "end_col", "snippet", "context")
    }
    # The rule list lives on the driver, so its broadcast is bounded by construction.
    out = found.join(F.broadcast(table), "rule_id").withColumns(
        {**nulls, "source": F.lit("regex"), "confidence": F.lit(1.0)}
    )
    return with_issue_id(out).select(FINDING_COLUMNS)
