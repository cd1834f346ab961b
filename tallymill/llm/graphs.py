"""Connected components by alternating star contractions (large star, small star).

Every round is an aggregate (combined before the shuffle) and a join with one row per key, so a hub
with a third of all edges is met by partial aggregation on one side and by adaptive skew splitting on
the other; no neighbourhood is ever gathered in one task. Rounds grow with the logarithm of the
longest chain. Every round is cut by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v in both directions. Links every larger (or not larger) neighbour to the least one."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    keep = F.col("v") > F.col("u") if large else F.col("v") < F.col("u")
    linked = edges.filter(keep).join(least, "u").select(F.col("v"), F.col("m"))
    if not large:  # the node itself is one of those that are not larger
        linked = linked.union(least.select(F.col("u").alias("v"), "m"))
    return linked.filter("v <> m").distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges``; root is the least node of its component.

    Null ends and loops are ignored; repeated edges count once; an empty table gives an empty one.
    """
    start = edges.select(F.col(a).alias("v"), F.col(b).alias("m")).filter("v is not null and m is not null and v <> m")
    start = start.select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m")).distinct()
    state = cut(start, "edges")
    before = None
    for _ in range(rounds):
        for large in (True, False):
            both = state.select(F.col("v").alias("u"), F.col("m").alias("v")).union(state.select(F.col("m").alias("u"), F.col("v")))
            state = cut(_star(both, large), "edges", replaces=state)
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.expr("sum(cast(xxhash64(v, m) as decimal(38, 0)))").alias("h")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = state.select(F.col("m").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return state.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(roots)
