"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.session import materialise

MOST_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links of each node moved to its least neighbour: the larger neighbours (large) or the smaller ones and itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of ``links`` (two columns of whole numbers); ``root`` is the least node reachable.

    Nodes only appear if they have a link to another node. Each round is a
    table in the shared folder, so a lost executor costs one round at most.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges, before = materialise(edges, "edges"), None
    for _ in range(MOST_ROUNDS):
        row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not row[0] or tuple(row) == before:
            break
        before = tuple(row)
        edges = materialise(_stars(_stars(edges, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    own = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own)
