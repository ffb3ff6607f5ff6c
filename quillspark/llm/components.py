"""Connected components by alternating large-star and small-star steps, without gathering a neighbourhood."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut


def _star(edges: DataFrame, n: int, hub_edges: int) -> DataFrame:
    """edges (u, v), n of them, with each edge's least neighbour m of u (u itself included).

    The minima of nodes with more than hub_edges and a thousandth of all edges, fewer than a thousand rows, are
    broadcast, so that no task gets all edges of a hub; without so many edges there is no such node.
    """
    by = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("k"))
    least, hub = by.drop("k"), F.col("k") > max(hub_edges, n / 1000)
    if n <= hub_edges:
        return edges.join(least, "u")
    marked = edges.join(F.broadcast(by.where(hub).drop("k")), "u", "left")
    return marked.where("m IS NULL").drop("m").join(least, "u").unionByName(marked.where("m IS NOT NULL"))


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b", rows_per_task: int = 20_000, hub_edges: int = 20_000) -> DataFrame:
    """(node, root) for every node of edges: root is the least node that links reach.

    Loops, repeated edges and either direction are allowed; null ends are dropped; no edges give no rows.
    Both steps work on minima that combine before the shuffle and reach the edges of hubs by broadcast, so a
    hub is never gathered in one task; each round is cut, and rounds grow as the logarithm of the longest path. Edges are few next to the texts that
    made them, so tasks are merged until each has rows_per_task of them.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    now = cut(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(F.col("u") > F.col("v")).distinct())
    state = _state(now)
    while state[0]:
        tasks = math.ceil(state[0] / rows_per_task)
        few = now.coalesce(tasks)
        both = few.unionByName(few.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * state[0], hub_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").coalesce(tasks).distinct()
        small = _star(large, 2 * state[0], hub_edges)
        now = cut(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").coalesce(tasks).distinct().coalesce(tasks))
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
