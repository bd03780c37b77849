"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Nodes of more edges than this are joined by a broadcast of their least neighbours, ...
HEAVY = 100
#: ... of which there are at most so many: with more edges than that allows, HEAVY is larger in proportion.
BROADCAST_ROWS = 500_000


def _with_least(edges: DataFrame, heavy: int) -> DataFrame:
    """``u, v, m`` of the edges ``u, v``: m is the least v of u.

    Fewer than edges / heavy nodes have more than heavy edges, so they fit into a broadcast, and no
    task of the other join has more rows of a node than that.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > heavy).select("u", "m"))
    at_hubs = edges.join(hubs, "u")
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= heavy).select("u", "m"), "u")
    return at_hubs.unionByName(rest)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node, component`` for each node of the edges ``u, v``; component is its smallest node.

    Alternates the large-star and small-star steps until the edges stay as they are; the number of
    rounds grows with the logarithm of the longest path. A step is a minimum per node and a join
    with it; nodes with very many edges are joined by a broadcast, so that none of them is one task's
    work. Null ends and loops are ignored; an empty table has no components. The result reads a table
    of scratch.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.where(u.isNotNull() & v.isNotNull() & (u != v))
    e = e.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    before, turn = None, 0
    while True:
        e = scratch.store(e, f"{name}-{turn}")
        if turn:
            scratch.drop(f"{name}-{turn - 1}", f"{name}-large-{turn - 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(u.alias("node"), v.alias("component")).union(e.select(v, v)).distinct()
        before = now
        heavy = max(HEAVY, -(-2 * now[0] // BROADCAST_ROWS))
        both = e.union(e.select(v.alias("u"), u.alias("v")))
        large = _with_least(both, heavy).where(v > u).select(v.alias("u"), F.least("m", "u").alias("v")).distinct()
        large = scratch.store(large, f"{name}-large-{turn}")
        joined = _with_least(large, heavy)
        e = joined.select("u", F.col("m").alias("v")).union(joined.where(v != F.col("m")).select(v, "m")).distinct()
        turn += 1
