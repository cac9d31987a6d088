"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.session import discard, written

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for all nodes of edges (a, b).

    Rounds of two star steps: each node hands its larger neighbours to its least
    neighbour, then its smaller ones. Edges keep to the size of the input, and a chain
    halves in each round; the result is a star around each component's least node. Each
    round is a table in the shared folder, which the next one's replaces.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    both = written(both, "pairs")
    state = _state(both)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        # neighbours above a node go to the least of the node and its neighbours
        each = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = each.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = each.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # neighbours below a node, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        previous, both = both, written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "star")
        discard(previous)
        before, state = state, _state(both)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return both.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(both.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Changes as long as a round changes edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())
