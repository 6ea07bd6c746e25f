"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over distinct ``(a, b)`` with ``a > b``.

    Small stars join a node's smaller neighbours to their minimum, large stars its
    larger ones.  Minima are partial aggregates, and a hub's links are joined back in
    slices, so no neighbour list is ever gathered in one task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; ``component`` is the
    smallest node reachable.  Nodes without a link have no row.

    Each round is written to the shared folder, which cuts the lineage; rounds grow with
    the logarithm of the longest path, and the driver sees only counts.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label
    )
    measure = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    before = None
    while True:
        edges = stage(_star(_star(edges, True), False), label)
        now = tuple(edges.agg(*measure).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
