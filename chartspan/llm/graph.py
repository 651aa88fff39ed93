"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import checkpointed, side

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list ``(a, b)`` of longs.

    ``root`` is the least node of the component. Each round hangs every node's larger
    neighbours on the least neighbour, then its smaller ones; the number of rounds grows with
    the logarithm of the longest path. A round is two aggregations and two joins over the
    edges, written to the shared folder; only an edge count and a checksum reach the driver.
    Loops and repeated edges are ignored, null ends are dropped, no edges give no rows.
    """
    now = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = checkpointed(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def _hang(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Join pairs with the least neighbour of their first end; hot ends can be split."""
    return (pairs.withColumn("s", side(F.col("u")))
            .join(least.withColumn("s", side(F.col("u"))), ["u", "s"]))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = _hang(both, least).where("v > u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = _hang(edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
