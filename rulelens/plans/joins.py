"""Joins that stay balanced when one key holds a large share of the rows, and size-checked broadcasts."""

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from rulelens.plans.storage import materialize

# A key with more rows than this is split over several tasks.
ROWS_PER_TASK = 1_000_000
# A table of keys may be broadcast up to this many rows.
MAX_BROADCAST_ROWS = 200_000


def lookup_join(left, right, on, how="left", spread=("path",), rows_per_task=ROWS_PER_TASK):
    """Join `left` with a table that has one row per key, exact for any distribution of `left` keys.

    Keys with more than `rows_per_task` rows on the left are found with a map-side count and stored. Usually there are
    none, and the join is a plain one that keeps whatever partitioning or bucketing the sides have. Otherwise only the rows
    of hot keys are salted: left rows by a hash of the `spread` columns, the matching right row repeated once per salt.
    The list of hot keys is broadcast only if its counted rows are few. `left` is read again for each part, so pass a
    stored table or a cheap projection.
    """
    on = list(on)
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_task)
    hot = materialize(counts.select(*on, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_parts")), "hot")
    many = hot.count()
    if not many:
        return left.join(right, on, how)
    if many <= MAX_BROADCAST_ROWS:
        hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")
    salted = left.join(hot, on).withColumn("_salt", salt).drop("_parts")
    copies = right.join(hot, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    joined = salted.join(copies, [*on, "_salt"], how).drop("_salt")
    return left.join(hot.drop("_parts"), on, "left_anti").join(right, on, how).unionByName(joined)


def semi_by_key(big, keys, on, how="left_semi", max_rows=MAX_BROADCAST_ROWS, known_rows=None):
    """Keep (or with `left_anti` drop) rows whose key is listed; the list is broadcast only if it is short.

    A null in a key meets a null in the list, so kept and dropped rows together are always all rows. `known_rows` is an
    upper bound the caller can prove (such as a limit); without it the list is counted, so it should be a stored table.
    """
    rows = keys.limit(max_rows + 1).count() if known_rows is None else known_rows
    if how not in ("left_semi", "left_anti"):
        return big.join(F.broadcast(keys) if rows <= max_rows else keys, on, how)
    named = keys.select(*[F.col(name).alias(f"_key{i}") for i, name in enumerate(on)])
    same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"_key{i}")) for i, name in enumerate(on)])
    return big.join(F.broadcast(named) if rows <= max_rows else named, same, how)


def keep_listed(big, keys, on, max_rows=MAX_BROADCAST_ROWS):
    """Prefilter for a join that follows: drop unlisted rows at the scan if the list is short, else nothing."""
    short = keys.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(keys), on, "left_semi") if short else big
