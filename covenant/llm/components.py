"""Connected components of a link table, by alternating star contractions.

Each round hangs, under the least neighbour of every node, first its larger
neighbours (large star) and then its smaller ones (small star); after a number of
rounds that grows with the logarithm of the largest component, every node hangs
under the least node of its component. Links stay in DataFrames throughout: a
hub's links are never gathered in one row, minima are partial aggregates, and the
joins on a hub are plain equi-joins of two checkpointed tables, which Spark's
adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 60


def _star(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every (v, u) of ``links`` with the least node ``m`` known at ``u``."""
    return links.alias("l").join(nodes.alias("n"), F.col("l.u") == F.col("n.u")).select("l.v", "l.u", "n.m")


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes of ``links`` (columns ``a`` and ``b``).

    ``component`` is the least node reachable. Nodes of any orderable type; null
    ends and self links make no link. No link: an empty table.
    """
    links = links.where(F.col("a") != F.col("b"))
    state = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    for _ in range(ROUNDS):
        # large star: larger neighbours move under the least one
        both = state.union(state.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(
            _star(both, least).where("v > u").select("v", F.col("m").alias("u")).distinct()
        )
        # small star: the other smaller neighbours of a node move under its least one
        least = cut(large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("u"), "m"))
        moved = (
            _star(large.select(F.col("u").alias("v"), F.col("v").alias("u")), least)
            .select("v", F.col("m").alias("u"))
            .where("v != u")
        )
        state = cut(moved.union(least.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct())
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = state.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return state.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
