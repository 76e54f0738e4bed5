"""The first rows of a table by number or by summed cost, also when the cut is too far down for one task."""

from itertools import accumulate

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulelens.plans.storage import materialize

# Up to here a top-n is one sorted take, where every task hands its own first n rows to a single last task;
# beyond it the rows are cut by range.
SMALL_N = 1_000
# A range of more rows than this is cut into ranges again before its rows are numbered.
ROWS_PER_RANGE = 1_000_000


def first_n(df, n, order, small_n=SMALL_N):
    """Exactly the first `n` rows by the `order` columns."""
    if n <= 0:
        return df.limit(0)
    if n <= small_n:
        return df.orderBy(*order).limit(n)
    return first_within(df, n, F.lit(1), order)


def first_within(df, budget, cost, order, rows_per_range=ROWS_PER_RANGE):
    """The longest run of first rows by the `order` columns whose costs add up to `budget` at most.

    A null cost is nothing; costs must not be negative. Rows are cut by range, and only sums per range reach the driver: ranges
    wholly before the cut are kept, those behind it dropped. The range the cut falls in is cut into ranges again until it
    is small; only then are its rows added up one after the other. The order should tell all rows apart: rows
    that it does not are taken in any order.
    """
    left = df.withColumn("_cost", F.coalesce(cost, F.lit(0)).cast("bigint"))
    kept, rows_before = df.limit(0), None
    while True:
        stored = materialize(left.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
        sums = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), F.sum("_cost").alias("cost")).collect()
        sums = sorted((r["_range"], r["rows"], r["cost"]) for r in sums)
        upto = list(accumulate(c for _, _, c in sums))
        edge = next((i for i, total in enumerate(upto) if total > budget), None)
        before = stored if edge is None else stored.filter(F.col("_range") < sums[edge][0])
        kept = kept.unionByName(before.drop("_range", "_cost"))
        if edge is None:
            return kept
        part, rows, _ = sums[edge]
        budget -= upto[edge - 1] if edge else 0
        left = stored.filter(F.col("_range") == part)
        if rows <= rows_per_range or rows == rows_before:
            upto = F.sum("_cost").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            last = left.withColumn("_upto", upto).filter(F.col("_upto") <= budget)
            return kept.unionByName(last.drop("_upto", "_range", "_cost"))
        left, rows_before = left.drop("_range"), rows
