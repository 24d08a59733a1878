"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from junctura.llm.common import release, staged


def _settled(e: DataFrame) -> bool:
    """Every node has one parent and no parent has a parent: the edges are stars."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1")
    return bad.isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every end of ``edges``; the component is its lowest node.
    Nulls and loops are left out. Each round hooks larger and then smaller neighbours
    to the lowest node in sight (Kiveris et al., 2014), so rounds grow with the
    logarithm of the size; each is written to the shared folder. Lows are written
    before they are joined, so that adaptive execution can split a node with very many
    neighbours."""
    e = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
               .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    n = 2 * e.count()  # no step has more rows: an edge becomes at most one edge
    while n and not _settled(e):
        both = e.union(e.select("v", "u"))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low", n)
        large = staged(both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")), "large", n)
        low2 = staged(large.groupBy("u").agg(F.min("v").alias("low")), "low", n)
        small = large.join(low2, "u").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        new = staged(small.union(low2.select("u", F.col("low").alias("v"))).distinct(), "edges", n)
        release(e, low, large, low2)
        e = new
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
