"""Sections and paragraphs of prose, and which of them a line lies in, from the text itself."""

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulelens.functions.text import content_hash, split_lines
from rulelens.plans.joins import keep_listed, lookup_join

# A heading: up to six number signs and a name.
_HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t#]*$")
OUTLINE = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("depth", T.IntegerType()),
     T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())]
)


def outline(lines):
    """`(kind, name, depth, first line, last line)` of sections, and of the paragraphs in them, in the order they begin.

    One sweep with a stack of open sections: a heading closes those of its depth and deeper. A paragraph is a run of lines
    that are neither blank nor headings; its name is that of the section it is in, its depth one more.
    """
    found, opened, at = [], [], 0
    heads = {i: head for i, line in enumerate(lines) if (head := _HEADING.match(line))}
    for kind, run in groupby(range(len(lines)), lambda i: ("head", i) if i in heads else "text" if lines[i].strip() else "blank"):
        run = list(run)
        if kind == "blank":
            continue
        if kind == "text":
            name, depth = (found[opened[-1]][1:3]) if opened else (None, 0)
            found.append(["paragraph", name, depth + 1, run[0] + 1, run[-1] + 1])
            continue
        at, depth = run[0], len(heads[run[0]][1])
        while opened and found[opened[-1]][2] >= depth:
            found[opened.pop()][4] = at
        opened.append(len(found))
        found.append(["section", heads[at][2], depth, at + 1, len(lines)])
    return found


def innermost(found, size):
    """For every line the place of the innermost span in `found` (as `outline` gives them), -1 for none.

    Spans are nested and in the order they begin, so a later one that covers a line lies in the earlier one.
    """
    inner = [-1] * size
    for place, (_, _, _, first, last) in enumerate(found):
        inner[first - 1 : last] = [place] * (last - first + 1)
    return inner


def _outlines(batches):
    for batch in batches:
        spans = [outline(list(lines)) for lines in batch["lines"]]
        inner = [innermost(found, len(lines)) for found, lines in zip(spans, batch["lines"])]
        keys = {c: batch[c] for c in batch.columns if c != "lines"}
        yield pd.DataFrame(keys | {"spans": [[tuple(s) for s in found] for found in spans], "inner": inner})


def outlines(corpus):
    """`(path, file_hash, spans, inner)` of every text: its sections and paragraphs, and the innermost one of every line.

    A null text has no row. Texts are read where they lie; other columns are not looked at.
    """
    lines = corpus.filter("content is not null").select("path", content_hash(F.col("content")).alias("file_hash"), split_lines(F.col("content")).alias("lines"))
    schema = T.StructType([*lines.schema.fields[:2], T.StructField("spans", T.ArrayType(OUTLINE)), T.StructField("inner", T.ArrayType(T.IntegerType()))])
    return lines.mapInPandas(_outlines, schema)


def prose_spans(corpus):
    """One row for each section and paragraph of every text: `(path, kind, name, depth, start_line, end_line)`."""
    return outlines(corpus).select("path", F.explode("spans").alias("span")).select("path", "span.*")


def section_context(findings, corpus):
    """Fill `context` with the section a finding's line is in, or null: `in section A / B` from the outermost down.

    Each text is swept once, and a finding looks its line up, so neither spans nor findings are paired with each other. A path with very many
    findings is split over tasks; of several texts of a path that of the finding's `file_hash` counts if it has one, else the
    one with the smallest hash. `findings` is read several times, so pass a stored table.
    """
    on = ["path", "file_hash"] if "file_hash" in findings.columns else ["path"]
    texts = keep_listed(corpus.select("path", "content"), findings.select("path"), ["path"])
    found = outlines(texts)
    found = found.groupBy(*on).agg(F.min_by(F.struct("spans", "inner"), "file_hash").alias("_o"))
    joined = lookup_join(findings.drop("context"), found, on, "left", spread=("issue_id",), rows_per_task=100_000)
    line = F.col("start_line")
    around = F.filter(
        F.col("_o.spans"), lambda s: (s["kind"] == "section") & (s["start_line"] <= line) & (s["end_line"] >= line)
    )
    inside = F.get(F.col("_o.inner"), line - 1) >= 0
    label = F.concat(F.lit("in section "), F.array_join(F.transform(around, lambda s: s["name"]), " / "))
    return joined.withColumn("context", F.when(inside & (F.size(around) > 0), label)).drop("_o").select(findings.columns)
