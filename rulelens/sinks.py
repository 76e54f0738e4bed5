"""Findings as JSON documents and JSON lines."""

from pyspark.sql import functions as F

from rulelens.functions.findings import level_rank, level_weight
from rulelens.operators.findings import PART_ROWS, in_parts
from rulelens.plans.storage import materialize
from rulelens.schemas import FINDING_COLUMNS, MAX_SCORE

_LOCATION = ["path", "start_line", "end_line", "start_col", "end_col"]


def issue_struct():
    """The serialised form of a finding: the flat columns with a nested location."""
    fields = []
    for name in FINDING_COLUMNS:
        if name == "path":
            fields.append(F.struct(*_LOCATION).alias("location"))
        elif name not in _LOCATION:
            fields.append(F.col(name))
    return F.struct(*fields)


def findings_document(findings, meta=None, part_rows=PART_ROWS):
    """`(path, part, document)`: all findings of a path as JSON with the path's score and counts, and the run's meta values.

    A path with more than `part_rows` findings has several documents; each has its own issues and the whole path's summary, which is
    added up from the parts' sums.
    """
    kept = in_parts(findings, part_rows)
    order = F.struct(level_rank(F.col("level")).alias("rank"), "start_line", "rule_id", "issue_id")
    grouped = kept.groupBy("path", "part").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("_order"), issue_struct().alias("issue")))).alias("_issues"),
        F.sum(level_weight(F.col("level"))).alias("_penalty"),
    )
    levels = F.transform("_issues", lambda x: x["issue"]["level"])
    grouped = materialize(grouped.withColumn("_levels", levels), "documents")
    by_level = grouped.select("path", F.explode("_levels").alias("level")).groupBy("path", "level").agg(F.count(F.lit(1)).alias("n"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", F.col("n").cast("int")))))
    totals = by_level.groupBy(F.col("path").alias("_path")).agg(counts.alias("_counts"), F.sum("n").cast("int").alias("_total"))
    penalties = grouped.groupBy(F.col("path").alias("_of")).agg(F.sum("_penalty").alias("_whole"))
    grouped = grouped.join(totals, F.col("path").eqNullSafe(F.col("_path"))).join(penalties, F.col("path").eqNullSafe(F.col("_of")))
    issues = F.transform("_issues", lambda x: x["issue"])
    score = F.greatest(F.lit(0), F.lit(MAX_SCORE) - F.col("_whole"))
    report = F.struct(
        issues.alias("issues"),
        F.struct(score.alias("score"), F.col("_total").alias("total_issues"), F.col("_counts").alias("counts")).alias("summary"),
        F.create_map(*[F.lit(str(x)) for kv in (meta or {}).items() for x in kv]).cast("map<string,string>").alias("meta"),
    )
    return grouped.select("path", "part", F.to_json(report, {"ignoreNullFields": "false"}).alias("document"))


def findings_jsonl(findings, summary):
    """JSON lines: one summary line, then one line per finding. `ordinal` 0 marks the summary.

    The summary is the first partition, so written parts start with it and no finding has to be moved.
    """
    head = summary.select(
        F.lit(0).alias("ordinal"),
        F.to_json(
            F.struct(F.lit("summary").alias("type"), F.col("score"), F.col("total_issues").alias("issues_count"))
        ).alias("value"),
    )
    issue = issue_struct()
    lines = findings.select(
        F.lit(1).alias("ordinal"),
        F.to_json(
            F.struct(F.lit("issue").alias("type"), *[issue[f].alias(f) for f in _issue_fields()]),
            {"ignoreNullFields": "false"},
        ).alias("value"),
    )
    return head.coalesce(1).unionByName(lines)


def _issue_fields():
    names = ["location" if c == "path" else c for c in FINDING_COLUMNS]
    return [c for c in names if c not in _LOCATION]


def write_jsonl(lines, folder):
    """Write JSON lines as text parts in partition order."""
    lines.select("value").write.text(folder)


def write_documents(documents, folder):
    documents.select(F.col("document").alias("value")).write.text(folder)
