"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge (u, v); root is the least node of its component.

    Each round ties every node's greater neighbours, then its smaller ones, to the
    least neighbour.  Both steps are aggregations with a map-side combine and a join,
    so a node with very many neighbours is never gathered.  Rounds follow the log of
    the component size; every round is written down, so a lost executor costs no more
    than one round.  Null ends and loops are dropped; no edges give no rows.
    """
    links = materialize(_tidy(edges), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _tidy(both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v"))
        up = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        head = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(head, "u").select(F.col("m").alias("u"), "v").unionByName(
            head.select(F.col("m").alias("u"), F.col("u").alias("v")))
        following = materialize(_tidy(small), "links")
        # Stars: no node is both a root and a leaf, and no leaf has two roots.
        ends = following.select("u").distinct().join(
            following.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        doubled = following.groupBy("v").count().where("count > 1").limit(1).count()
        links = following
        if not ends and not doubled:
            roots = links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            return links.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def _tidy(edges: DataFrame) -> DataFrame:
    """Distinct edges with the smaller end first."""
    return (edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .where("u <> v").distinct())
