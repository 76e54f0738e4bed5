"""Connected components of a link table, by alternating stars."""

from pyspark.sql import functions as F

from rulelens.plans.storage import materialize


def _star(edges, node, least):
    """Each node's rows with the smallest of its neighbours."""
    return edges.join(edges.groupBy(node).agg(F.min(least).alias("m")), node)


def components(edges, left="u", right="v"):
    """`(u, component)` for every node but the smallest of its component.

    Every round ties the larger neighbours of a node to its smallest one, then the smaller ones, so that chains halve
    and hot nodes keep one row per neighbour. Rounds end when the table stays as it is; only its row count and
    checksum reach the driver. Nulls and loops are left out.
    """
    u, v = F.col(left), F.col(right)
    edges = edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    stored, seen = materialize(edges, "edges"), None
    while True:
        sums = stored.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums[0] == 0 or sums == seen:
            return stored.select("u", F.col("v").alias("component"))
        seen = sums
        both = stored.unionByName(stored.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.distinct()
        tied = _star(large, "u", "v")
        tied = tied.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = tied.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct()
        stored = materialize(small, "edges")
