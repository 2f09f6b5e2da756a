"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as rt


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above u hangs on the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written first, so that the join below can split a node with many neighbours.
    least = rt.materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return rt.materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")


def _small(edges: DataFrame) -> DataFrame:
    """u and its neighbours below hang on the least of those."""
    least = rt.materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    lower = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rt.materialise(lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`node`, `root` (least node of its component) for each node of edges (a, b); a <> b.

    Every round is written to the shared folder and the former one deleted.
    Ends when a round changes nothing; the number of rounds grows with the
    logarithm of the longest path. An empty edge table gives an empty result.
    """
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = rt.materialise(state, "edges")
    sign = None
    for _ in range(rounds):
        after = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after[0] == 0 or after == sign:
            break
        sign = after
        with rt.passing():
            former, state = state, _small(_large(state))
        rt.discard(former)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def headed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """`node` and `head` (the least `first` of its component) for each row (node, first) of `nodes`."""
    linked = rt.materialise(nodes.join(roots, "node"), "linked")
    heads = rt.materialise(linked.groupBy("root").agg(F.min("first").alias("head")), "heads")
    alone = nodes.join(roots, "node", "left_anti").select("node", F.col("first").alias("head"))
    return linked.join(heads, "root").select("node", "head").unionByName(alone)
