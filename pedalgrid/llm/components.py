"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalgrid.session import cut_lineage, forget


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of every node on the least of them: those above the node (large star), or
    those below it together with the node itself (small star). ``edges`` hold a > b."""
    if small:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        up = around.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = up.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b): the least node that links lead to.

    Hubs are met by map-side minima and joins on them; each round is stored, so that a lost
    executor costs one round. The number of rounds grows with the logarithm of the chains' length.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.filter("a <> b").distinct(), "edges")
    before = None
    while True:
        last, edges = edges, cut_lineage(_star(_star(edges, small=False), small=True), "edges")
        forget(last)
        # sums in longs would overflow
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
