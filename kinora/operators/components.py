"""Connected components of an undirected graph, by alternating star contraction.

Each round points every vertex at the smallest vertex of its neighbourhood, first towards larger and then towards
smaller neighbours, until only stars are left: a few rounds even for long chains (Kiveris et al., Connected
Components in MapReduce and Beyond, 2014).  Every round is a table in the shared folder, so a lost executor costs one
round; the round before it is deleted.  Minima are combined before the shuffle; the join that hands them out is one
whose skewed side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinora.session import discard, stored


def _towards_larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _towards_smaller(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component), stored: the smallest id reachable, for every vertex that has an edge to another one.

    Self loops, repeated edges and either direction are allowed; rows with a null end are ignored.
    """
    a, b = F.col(src), F.col(dst)
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stored(now, "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == before or state.n == 0:
            break
        before = (state.n, state.s)
        following = stored(_towards_smaller(_towards_larger(now)), "edges")
        discard(now)
        now = following
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    found = stored(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
    discard(now)
    return found
