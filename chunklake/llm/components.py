"""Connected components of edges that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v), one row for each node with an edge: node, root (the smallest node that it reaches).

    Large-star and small-star steps in turn (Kiveris et al. 2014): the number of rounds grows with the logarithm of the
    longest path. Each round's edges are written to the shared folder, so lineage stays short. Nulls and loops are left
    out. A node of very high degree meets only a partial minimum and a join that adaptive execution can split.
    """
    now = written(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Now each u is larger than its v.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = written(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct(), "edges")
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
