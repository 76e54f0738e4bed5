"""What changed between two snapshots of a corpus, and unified-diff text as hunks."""

from pyspark.sql import functions as F

from rulelens.functions.patterns import path_trigger
from rulelens.functions.text import content_hash
from rulelens.schemas import HUNK
from rulelens.plans.joins import MAX_BROADCAST_ROWS
from rulelens.plans.storage import materialize
from rulelens.sources.corpus import exclude_paths


def changed_rows(old, new, globs=None, exclude=None, keep_removed=False):
    """`(path, change, is_new)` for rows added or modified since `old`; optionally removed ones too.

    Whitespace-only edits are no change. Both snapshots are reduced to one hash per path with a map-side
    aggregate, so neither text nor a join is shuffled.
    """
    sides = [
        df.select("path", content_hash(F.col("content")).alias("hash"), F.lit(side).alias("side"))
        for df, side in ((old, "old"), (new, "new"))
    ]

    def pick(side):
        return F.max(F.when(F.col("side") == side, F.col("hash")))

    seen = sides[0].union(sides[1]).groupBy("path").agg(pick("old").alias("before"), pick("new").alias("after"))
    change = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    )
    out = seen.filter(~F.col("before").eqNullSafe(F.col("after"))).select(
        "path", change.alias("change"), F.col("before").isNull().alias("is_new")
    )
    if not keep_removed:
        out = out.filter("change <> 'removed'")
    if globs:
        out = out.filter(path_trigger("path", globs))
    return exclude_paths(out, exclude or [])


def mark_new(df, baseline):
    """Add `is_new`: the path is not in the baseline. A long baseline first meets the paths alone, not the text."""
    known = materialize(baseline.select("path").distinct().withColumn("_known", F.lit(True)), "baseline")
    if known.count() > MAX_BROADCAST_ROWS:
        known = materialize(known.join(df.select("path").distinct(), "path", "left_semi"), "known")
    short = known.count() <= MAX_BROADCAST_ROWS
    return df.join(F.broadcast(known) if short else known, "path", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


# The header of a hunk in a unified diff. A hunk starts at `@@ -<old range> +<new range> @@`; the split keeps what follows `@@ -`.
_HUNK_START = r"\n@@ -(?=\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"
_HUNK_FIELDS = r"\A\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@([^\n]*)"
_OLD_COUNT = r"\A\d+(?:,(\d+))?"


def _new_side(lines, old, new):
    """The lines of a hunk's new side without their marks: as many as its header says, whatever they begin with.

    A blank line without a mark is a blank line of context; `\\` begins a remark.
    """
    kept = F.array().cast("array<string>")

    def step(state, line):
        mark = F.when(line == "", " ").otherwise(F.left(line, F.lit(1)))
        on_new = mark.isin(" ", "+") & (state["new"] > 0)
        on_old = mark.isin(" ", "-") & (state["old"] > 0)
        return F.struct(
            (state["old"] - on_old.cast("int")).alias("old"),
            (state["new"] - on_new.cast("int")).alias("new"),
            F.when(on_new, F.array_append(state["kept"], F.substring(line, 2, 1 << 30))).otherwise(state["kept"]).alias("kept"),
        )

    start = F.struct(old.alias("old"), new.alias("new"), kept.alias("kept"))
    return F.aggregate(lines, start, step, lambda state: state["kept"])


def hunks_of(patch):
    """Array of hunks of one unified diff: new-side range, header text, context and added lines."""
    pieces = F.split(F.concat(F.lit("\n"), patch), _HUNK_START)
    chunks = F.slice(pieces, 2, F.size(pieces))

    def to_hunk(chunk):
        start = F.regexp_extract(chunk, _HUNK_FIELDS, 1).cast("int")
        count = F.coalesce(F.nullif(F.regexp_extract(chunk, _HUNK_FIELDS, 2), F.lit("")).cast("int"), F.lit(1))
        old = F.coalesce(F.nullif(F.regexp_extract(chunk, _OLD_COUNT, 1), F.lit("")).cast("int"), F.lit(1))
        lines = F.split(chunk, "\n")
        body = F.array_join(_new_side(F.slice(lines, 2, F.size(lines)), old, count), "\n")
        header = F.regexp_replace(F.regexp_extract(chunk, _HUNK_FIELDS, 3), r"(?U)\A\s+|\s+\z", "")
        return F.struct(
            start.alias("start_line"),
            (start + count - 1).alias("end_line"),
            body.alias("content"),
            header.alias("header"),
        )

    return F.transform(chunks, to_hunk).cast("array<" + HUNK.simpleString() + ">")


def parse_hunks(patches, patch="patch"):
    """One row per hunk: the path, the hunk's number in its patch (from 1) and its fields. No shuffle."""
    return patches.select(
        "path", F.posexplode(hunks_of(F.col(patch))).alias("pos", "hunk")
    ).select("path", (F.col("pos") + 1).alias("hunk_no"), "hunk.*")
