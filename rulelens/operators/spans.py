"""Named line ranges (classes, functions, sections) and which of them encloses a finding."""

from pyspark.sql import functions as F

from rulelens.plans.joins import lookup_join
from rulelens.schemas import SPANS

# Ranges are joined by equality on line buckets of this size, then by the exact bounds.
BUCKET_LINES = 64


def enclosing_labels(points, spans):
    """`(path, start_line, context)` for distinct points: the smallest class and function around each line.

    A method of that class gives `in class C.f()`, else the more specific of the two is named. Each point
    meets only the spans of its own line bucket, and pairs are reduced to two rows per point at once.
    """
    points = points.select("path", "start_line").distinct()
    bucket = F.floor(F.col("start_line") / BUCKET_LINES).cast("int")
    length = F.col("end_line") - F.col("first_line") + 1
    ranges = spans.withColumnRenamed("start_line", "first_line").withColumn("_len", length).withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor(F.col("first_line") / BUCKET_LINES).cast("int"),
                F.floor(F.col("end_line") / BUCKET_LINES).cast("int"),
            )
        ),
    )
    inside = (F.col("first_line") <= F.col("start_line")) & (F.col("start_line") <= F.col("end_line"))
    pairs = points.withColumn("_bucket", bucket).join(ranges, ["path", "_bucket"]).filter(inside)

    def smallest(kind):
        span = F.when(F.col("kind") == kind, F.struct("_len", "span_id", "parent_id", "name"))
        return F.min(span).alias(f"_{kind}")

    best = pairs.groupBy("path", "start_line").agg(smallest("class"), smallest("function"))
    cls, fn = F.col("_class"), F.col("_function")
    label = (
        F.when(
            cls.isNotNull() & (fn["parent_id"] == cls["span_id"]),
            F.concat(F.lit("in class "), cls["name"], F.lit("."), fn["name"], F.lit("()")),
        )
        .when(cls.isNull() | (fn["_len"] < cls["_len"]), F.concat(F.lit("in function "), fn["name"]))
        .otherwise(F.concat(F.lit("in class "), cls["name"]))
    )
    return best.select("path", "start_line", label.alias("context"))


def enclosing_span(findings, spans):
    """Fill `context` with the label of the enclosing span, or null. `findings` should be a stored table."""
    labels = enclosing_labels(findings, spans)
    joined = lookup_join(findings.drop("context"), labels, ["path", "start_line"], "left", spread=("issue_id",))
    return joined.select(findings.columns)


def _span_batches():
    """Tasks: `(path, content)` batches in, span rows out."""

    def run(batches):
        import ast
        from collections import deque

        import pandas as pd

        fields = ["path", "span_id", "parent_id", "kind", "name", "start_line", "end_line"]
        kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    tree = ast.parse(content)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                todo, number = deque([(tree, None)]), 0
                while todo:
                    node, parent = todo.popleft()
                    number += 1
                    kind = kinds.get(type(node))
                    if kind:
                        rows.append((path, number, parent, kind, node.name, node.lineno, node.end_lineno))
                    todo.extend((child, number) for child in ast.iter_child_nodes(node))
            yield pd.DataFrame(rows, columns=fields).astype({"parent_id": "Int32"})

    return run


def python_spans(corpus):
    """Classes and functions of Python texts, numbered breadth-first; a text that does not parse has none."""
    return corpus.select("path", "content").mapInPandas(_span_batches(), SPANS)
