"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktape.llm.common import written


def settled(edges: DataFrame) -> bool:
    """Whether each edge (a, b) leads to a root: no a has two edges, and no b is an a.

    Counts combine before the shuffle, so that a root of very many edges is a row for each task.
    """
    sides = edges.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    sides = sides.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sides.agg(F.max(F.col("out") + F.when(F.col("out") > 0, F.col("into")).otherwise(0))).first()[0] in (None, 1)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the smallest id reachable.

    Each round links the neighbours of a vertex to the smallest of them, which keeps the components and
    at least halves their depth.  Minimum aggregates combine before the shuffle and are written before they
    are joined, so both sides of a join are plain exchanges and a vertex with very many neighbours can be split.
    """
    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if settled(current):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        large = written(large)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        current = written(small.filter("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    # at rest each vertex but the roots has one edge, to its root
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
