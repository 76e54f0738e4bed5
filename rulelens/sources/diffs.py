"""Line diffs between two snapshots of a corpus, a changed path at a time."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rulelens.functions.linediff import changes, hunks
from rulelens.functions.patterns import path_trigger
from rulelens.functions.text import content_hash, split_lines
from rulelens.plans.joins import semi_by_key
from rulelens.plans.ranks import numbered
from rulelens.plans.storage import materialize
from rulelens.schemas import HUNK
from rulelens.sources.changes import changed_rows

# First and last new line of a change (from 1). Where lines were only removed, `last` is one less than `first`.
SPAN = T.StructType([T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType())])
DIFF = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("is_new", T.BooleanType()),
        T.StructField("hunks", T.ArrayType(HUNK)),
        T.StructField("changed", T.ArrayType(SPAN)),
    ]
)
CONTEXT = 3


# Results are handed on whenever they hold so many characters of hunks.
CHARS_TOGETHER = 4 << 20


def _diffs(context, together=CHARS_TOGETHER):
    def one(before, after):
        old = [] if before is None else list(before)
        new = list(after)
        found = changes(old, new)
        listed = []
        for first, end, _ in hunks(found, len(new), context):
            # As in a unified diff, a hunk without new lines is said to start at the line before it.
            listed.append((first + (end > first), end, "\n".join(new[first:end]), ""))
        return listed, [(j + 1, j_end) for _, _, j, j_end in found]

    def packed(batch, at, rows):
        part = batch.slice(at, len(rows))
        arrays = [part["path"], part["is_new"]]
        for k, field in enumerate(("hunks", "changed")):
            names = DIFF[field].dataType.elementType.fieldNames()
            values = [[dict(zip(names, entry)) for entry in row[k]] for row in rows]
            arrays.append(pa.array(values, to_arrow_type(DIFF[field].dataType)))
        return pa.RecordBatch.from_arrays(arrays, DIFF.fieldNames())

    def run(batches):
        # Lines become Python strings for one path at a time, and results go on in pieces.
        for batch in batches:
            before, after = batch["before"], batch["after"]
            at, rows, chars = 0, [], 0
            for i in range(batch.num_rows):
                rows.append(one(before[i].as_py(), after[i].as_py()))
                chars += sum(len(content) for _, _, content, _ in rows[-1][0])
                if chars >= together:
                    yield packed(batch, at, rows)
                    at, rows, chars = i + 1, [], 0
            if rows:
                yield packed(batch, at, rows)

    return run


def diff_hunks(old, new, globs=None, exclude=None, context=CONTEXT, changed=None):
    """`(path, is_new, hunks, changed)` of every path that was added or modified since `old`.

    A hunk is a range of new lines: changed ones and up to `context` unchanged lines around them; `content` is its text as it is
    now. `changed` are the ranges of changed lines alone. Edits of white space at line ends are no change of a path, but are one
    of a line of a path that has others. An added path is one hunk. Only texts of changed paths are shuffled,
    each diff sees the lines of one path. `changed` is the stored table of changed paths, if there is one already.
    """
    paths = changed
    if paths is None:
        paths = materialize(changed_rows(old, new, globs, exclude).select("path", "is_new"), "changed")
    sides = []
    for side, name in ((old, "before"), (new, "after")):
        lines = side.select("path", split_lines(F.col("content")).alias("lines"), content_hash(F.col("content")).alias("hash"))
        lines = semi_by_key(lines, paths.select("path"), ["path"])
        # As in `changed_rows`, of several texts of a path the one with the largest hash counts.
        sides.append(lines.groupBy("path").agg(F.max_by("lines", "hash").alias(name)))
    both = paths.join(sides[1], "path").join(sides[0], "path", "left")
    return both.select("path", "is_new", "before", "after").mapInArrow(_diffs(context), DIFF)


# Of the distinct lines of the smaller text so many percent must be shared by a pair that is taken as renamed.
LEAST_SHARED = 50


def _lines_of(side, paths, name):
    """`(name, line, many)`: distinct lines of the listed paths, and how many each path has."""
    lines = F.array_distinct(F.filter(split_lines(F.col("content")), lambda x: F.trim(x) != ""))
    rows = semi_by_key(side.select(F.col("path").alias(name), lines.alias("lines")), paths, [name])
    return rows.select(name, F.size("lines").alias(f"{name}_lines"), F.explode("lines").alias("line"))


def _only(rows, name):
    """Lines that only one path has."""
    rest = [F.first(c).alias(c) for c in (name, f"{name}_lines")]
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("_paths"), *rest).filter("_paths = 1").drop("_paths")


def renamed_rows(old, new, globs=None, exclude=None, least_shared=LEAST_SHARED):
    """`(old_path, path, shared)`: removed paths paired one to one with added ones.

    First by equal normalised text (`shared` 100); of several equal texts the first removed path goes with the first added
    one, and so on. Paths that are left are paired if each is the other's best: the one with which it shares most
    lines that no other removed and no other added path has (ties: the smaller path), and these are `shared` percent,
    `least_shared` at least, of the distinct lines of the smaller text. Blank lines do not count. Globs go for new paths.
    """
    found = changed_rows(old, new, None, exclude, keep_removed=True)
    found = materialize(found.select("path", "change"), "changed")
    sides = []
    for side, change, name in ((old, "removed", "old_path"), (new, "added", "path")):
        paths = found.filter(F.col("change") == change).select("path")
        if name == "path" and globs:
            paths = paths.filter(path_trigger("path", globs))
        hashed = side.select("path", content_hash(F.col("content")).alias("hash"))
        hashed = semi_by_key(hashed, paths, ["path"]).groupBy("path").agg(F.max("hash").alias("hash"))
        sides.append(numbered(hashed, "hash", ["path"]).withColumnRenamed("path", name))
    gone, come = sides
    same = materialize(gone.join(come, ["hash", "place"]).select("old_path", "path", F.lit(100).alias("shared")), "same")
    gone, come = (
        materialize(semi_by_key(rows.select(name), same.select(name), [name], "left_anti"), "left")
        for rows, name in ((gone, "old_path"), (come, "path"))
    )
    before, after = _only(_lines_of(old, gone, "old_path"), "old_path"), _only(_lines_of(new, come, "path"), "path")
    pairs = before.join(after, "line").groupBy("old_path", "path").agg(
        F.count(F.lit(1)).alias("lines"), F.min(F.least("old_path_lines", "path_lines")).alias("of")
    )
    pairs = materialize(pairs.withColumn("shared", F.floor(100 * F.col("lines") / F.col("of")).cast("int")), "pairs")
    best = pairs
    for mine, other in (("old_path", "path"), ("path", "old_path")):
        first = pairs.groupBy(mine).agg(F.min(F.struct(-F.col("lines"), other))[other].alias(other))
        best = best.join(first, [mine, other], "left_semi")
    return same.unionByName(best.filter(F.col("shared") >= least_shared).select("old_path", "path", "shared"))


def on_changed_lines(findings, diffs):
    """Findings whose lines meet a changed range of their path; `diffs` has one row for each path."""
    spans = diffs.select(F.col("path").alias("_path"), "changed")
    joined = findings.join(spans, F.col("path") == F.col("_path"))
    last = F.coalesce("end_line", "start_line")
    meets = F.exists("changed", lambda s: (s["first_line"] <= last) & (s["last_line"] >= F.col("start_line")))
    return joined.filter(meets).select(findings.columns)
