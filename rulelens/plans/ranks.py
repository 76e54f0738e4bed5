"""Places of rows in their groups, also where one group holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulelens.plans.storage import materialize


def numbered(rows, group, order, name="place"):
    """`rows`, stored, with a gapless number from 0 in each group, by the `order` columns.

    Rows are sorted by range, so a group lies in as many tasks as its size asks for, and a range's numbers start after those of
    the ranges before it. Only one row for each range and group is joined back. The order should end in columns that
    tell equal rows apart, so that they can be split too.
    """
    group = [group] if isinstance(group, str) else list(group)
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = materialize(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranged")
    runs = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                       F.col("_range").alias("_r"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = ranged.join(runs, same)
    columns = [c for c in ranged.columns if c not in ("_range", "_at")]
    return out.select(*columns, (F.col("_at") + F.col("_shift")).alias(name))
