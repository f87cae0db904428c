"""Connected components of an edge table by alternating star contractions.

Each round replaces edges by stars around smaller nodes: the large-star step
hangs a node's larger neighbours on its smallest neighbour, the small-star step
its smaller ones. Rounds end when the edges no longer change; every node then
points at the smallest node of its component. The edges never leave Spark, and
each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import write_shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` holds (a, b) with b < a."""
    down = edges.select("a", "b")
    both = down.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else down
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    hung = both.join(low, "a")
    if large:
        moved = hung.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = hung.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that is not itself its component's
    smallest node. ``edges`` has two columns of one ordered type."""
    a, b = edges.columns
    now = write_shared(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                       .distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = write_shared(_star(_star(now, True), False), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
