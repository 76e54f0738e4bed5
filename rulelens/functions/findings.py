"""Expressions over findings: levels, locations, identity, serialised forms."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulelens.functions.text import short_sha
from rulelens.schemas import CACHED_FINDING, ISSUE_ID_CHARS, LEVEL_WEIGHTS, LEVELS


def level_norm(level):
    """Lower-case level; unknown, empty or null becomes info."""
    lowered = F.lower(level)
    return F.when(lowered.isin(LEVELS), lowered).otherwise(F.lit("info"))


def _by_level(level, values, default):
    out = None
    for name, value in values.items():
        out = F.when(level == name, value) if out is None else out.when(level == name, value)
    return out.otherwise(F.lit(default)).cast("int")


def level_rank(level):
    """0 for the most severe level; unknown levels come last."""
    return _by_level(level, {name: i for i, name in enumerate(LEVELS)}, len(LEVELS))


def level_weight(level):
    """Penalty points of a level; an unknown level costs nothing."""
    return _by_level(level, LEVEL_WEIGHTS, 0)


def location_str(path, start_line, end_line):
    """`path:start`, with `-end` only for a non-zero end that differs from the start."""
    shows_end = end_line.isNotNull() & (end_line != 0) & (end_line != start_line)
    tail = F.when(shows_end, F.concat(F.lit("-"), end_line.cast("string"))).otherwise(F.lit(""))
    return F.concat(path, F.lit(":"), start_line.cast("string"), tail)


def issue_id(rule_id, path, start_line, end_line, title):
    return short_sha(
        F.concat_ws(":", rule_id, location_str(path, start_line, end_line), title), ISSUE_ID_CHARS
    )


def with_issue_id(findings):
    return findings.withColumn(
        "issue_id",
        issue_id(F.col("rule_id"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("title")),
    )


def cached_form(x):
    """The struct a cache entry keeps of a flat finding (`x` is a struct column)."""
    location = F.struct(*[x[c].alias(c) for c in ("path", "start_line", "end_line", "start_col", "end_col")])
    kept = {name: x[name] for name in CACHED_FINDING.fieldNames() if name != "location"}
    kept["location"] = location
    return F.struct(*[kept[name].alias(name) for name in CACHED_FINDING.fieldNames()])


def findings_to_json(findings):
    """Array of cached-form findings as JSON text, nulls included."""
    return F.to_json(findings, {"ignoreNullFields": "false"})


def findings_from_json(text):
    """Inverse of findings_to_json; confidence defaults to 1.0 and tags to an empty array."""
    parsed = F.from_json(text, T.ArrayType(CACHED_FINDING))
    return F.transform(
        parsed,
        lambda x: x.withField("confidence", F.coalesce(x["confidence"], F.lit(1.0))).withField(
            "tags", F.coalesce(x["tags"], F.array().cast("array<string>"))
        ),
    )
