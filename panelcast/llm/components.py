"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import join_spread, materialize


def _stars(pairs: DataFrame, total: int) -> DataFrame:
    """(node, other, least): each pair with the least of node and all its others; combines before the shuffle.

    The centre of a large star has many pairs: they are dealt to several tasks.
    """
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"), F.count("*").alias("pairs"))
    return join_spread(pairs, least, ["node"], "pairs", total, ["other"])


def _state(edges: DataFrame) -> tuple:
    """Count and hash sum: equal when a round has changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def components(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(node, root): the least node of each node's component; edges has the long columns a and b.

    Nodes without an edge to another node are not returned. The rounds grow with
    the logarithm of the longest path; more than max_rounds is an error. Every round is
    written to the shared folder, so a lost executor costs one round at most.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = _stars(both, 2 * before[0]).filter("other > node").select(F.col("other").alias("a"), F.col("least").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(low.select("a", F.col("least").alias("b")))
        now = materialize(small.filter("a <> b").distinct(), "edges")
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
