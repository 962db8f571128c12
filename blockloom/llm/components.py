"""Connected components of an edge table by alternating large and small stars.

Every round hooks the neighbours of each node to the smallest one, first the larger and then
the smaller neighbours, until the edges form stars. Rounds are written to the shared scratch
folder: the lineage stays short, and a lost executor costs no earlier round. Only row counts and
a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _state(edges: DataFrame) -> tuple:
    # The sum of hashes does not depend on the order of rows; decimals do not overflow.
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, low: DataFrame, rest: Column) -> DataFrame:
    joined = edges.join(low, "a")
    return joined.filter(rest & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: ``root`` is the smallest node reachable.

    A node with very many neighbours is a frequent join key. Its minimum is found by a partial
    aggregate and stored, so the join is one of two plain inputs, which Spark splits when skewed.
    Edges from a node to itself and edges with a null are ignored; no edges give no rows.
    """
    greater = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = stored(greater.distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars")
        large = stored(_star(both, low, F.col("b") > F.col("a")).distinct(), "edges")
        # Every edge now points from a greater node to a smaller one.
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = _star(large, low, F.lit(True)).unionByName(low.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), "edges")
        before, state = state, _state(now)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
