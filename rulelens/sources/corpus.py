"""Corpora as `(path, content)` DataFrames and the filters over their paths."""

from pyspark.sql import functions as F

from rulelens.functions.patterns import any_of, path_trigger
from rulelens.schemas import IGNORED_DIRS
from rulelens.sources.files import read_text_files

# An input below this size is spread over all cores; larger ones already have enough splits.
SMALL_INPUT_BYTES = 1 << 30
# What is moved lies in parts of this estimated size at most, however few the cores are.
SPREAD_BYTES = 8 << 20


def spread_small(df, *keys):
    """Hash-repartition an input that is small enough to move, so that few row groups use all cores.

    Anything above SMALL_INPUT_BYTES (by the optimizer's estimate) keeps its own splits and is not shuffled.
    """
    if df.isStreaming:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > SMALL_INPUT_BYTES:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES)), *keys)


def corpus_scan(spark, path, glob="*.py"):
    """Text of a file, or of all files below a directory; ignored directories and bad UTF-8 are skipped."""
    return read_text_files(spark, path, glob)


def corpus_from_table(df, path, text, **extra):
    """Any table as a corpus: `path` and `text` are expressions, `extra` are further columns to keep."""
    columns = [path.alias("path"), text.alias("content")]
    return df.select(*columns, *[col.alias(name) for name, col in extra.items()])


def documents_corpus(documents):
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return corpus_from_table(documents, path, F.col("text"))


def pages_corpus(pages):
    """`web/<host><url path>.<page_id>.html`; query and fragment are cut."""
    bare = F.regexp_replace(F.regexp_replace(F.col("url"), r"^[a-z]+://", ""), r"[?#].*$", "")
    path = F.concat(F.lit("web/"), bare, F.lit("."), F.col("page_id"), F.lit(".html"))
    return corpus_from_table(pages, path, F.col("html"))


def conversations_corpus(conversations):
    path = F.concat(F.lit("chat/"), F.col("conv_id"), F.lit("/"), F.col("turn"), F.lit("."), F.col("role"))
    return corpus_from_table(conversations, path, F.col("text"))


def _components(path):
    return F.split(path, "/")


def drop_ignored(df, path="path"):
    """Drop rows with a hidden path component or one of the ignored directory names."""

    def ignored(part):
        hidden = part.startswith(".") & ~part.isin(".", "..")
        return hidden | part.isin(IGNORED_DIRS)

    return df.filter(~F.exists(_components(F.col(path)), ignored))


def exclude_paths(df, globs, base=None, path="path"):
    """Drop rows where a glob matches any single component, the path, or any parent of it.

    With `base`, paths below it are matched relative to it.
    """
    if not globs:
        return df
    full = F.col(path)
    if base:
        prefix = base.rstrip("/") + "/"
        full = F.when(full.startswith(prefix), F.substring(full, len(prefix) + 1, 1 << 30)).otherwise(full)
    parts = _components(full)
    parents = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    # Components, the path and all its parents, and the root they end in.
    names = df.withColumn("_names", F.concat(parts, parents, F.array(F.lit("."))))
    return names.filter(f"NOT exists(_names, n -> {path_trigger('n', globs)})").drop("_names")


def include_paths(df, roots, path="path"):
    """Keep rows at or below any root; no roots or `.` keep everything."""
    roots = [r[2:] if r.startswith("./") else r for r in roots or ["."]]
    roots = [r.rstrip("/") for r in roots if r]
    if not roots or "." in roots:
        return df
    col = F.col(path)
    return df.filter(any_of([(col == r) | col.startswith(r + "/") for r in roots]))
