"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Edges stay in the cluster. Each round is checkpointed in the shared folder, so
that neither the lineage nor a lost executor makes earlier rounds run again. The
least neighbours are stored too before they are joined: both sides of a join are
then plain shuffles, and AQE splits the edges of a hot root among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: (u, v) long, any order, repeats allowed. Returns (node, root): root is the least node.

    Roots themselves are left out, as are nodes without edges; u = v is no edge.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpoint(e)
    was = _signature(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpoint(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
