"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, discard


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``, root the smallest node reachable, for every node of an edge.

    Large-star and small-star steps alternate until no edge changes.  Each
    step is one map-side combined minimum per node and one equi-join that AQE
    may split, so a hub with a third of all edges is no single task.  Every
    round is written to the shared folder.  Nulls in either column are
    ignored, as are loops and repeated edges; an empty table gives none.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "edges")
    before = None
    while True:
        # large-star: the larger neighbours of a node join the smallest node of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: the smaller neighbours and the node itself join the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        new = cut(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if now == before:
            out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
            out._tidemark_path = e._tidemark_path
            return out
        before = now
