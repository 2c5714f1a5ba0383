"""Connected components of an edge table: edges linked within tasks first, then alternating large and small stars.

A task links the edges that it has by union-find, LINKED nodes at a time, and passes on an edge from each
node to the least that it found for it; so there are as many edges as nodes and most paths are gone before
anything is shuffled. Every round then sends each node's neighbours to the least of them; edges never
outnumber those given, and stars need a number of rounds that grows with the logarithm of the longest path
that is left. All sizes take this same way; a round has a task for each LINKED edges. Minima are
pre-aggregated, so a node with very many neighbours costs one row per task; its edges meet its least
neighbour by a broadcast of such nodes, of which there are HUBS at most, and so stay where they are.
Nulls and loops are passed over; an empty table has no components. A round's edges are checkpointed:
a lost executor costs the round it was lost in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, counted, cut, taken

#: Nodes whose edges are joined by broadcast at most, and the least number of edges of such a node.
HUBS, HUB = 100_000, 1000
#: Nodes that a task links at a time, and edges that a round gives to a task.
LINKED = 200_000


def by_hot_key(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and in `n` how many rows of left have it (of `total` in all).

    Keys of more rows than HUB, and than total / HUBS, are broadcast, so that none of them fills a task. right is
    read three times: by exchanges that are made once, or from a checkpoint.
    """
    most = max(HUB, -(-total // HUBS))
    if total <= most:
        return left.join(right, key, how)
    hot = right.where(F.col(n) > most)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(n) <= most), key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def _star(edges: DataFrame, large: bool, total: int, tasks: int) -> DataFrame:
    """edges u > v. Large: of each node, larger neighbours link to the least of it and its neighbours; small: lesser ones and it do."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")).coalesce(tasks)
    linked = both.where("v > u") if large else both
    out = by_hot_key(linked, least, "u", "n", 2 * total).coalesce(tasks).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct().coalesce(tasks)


class Links:
    """Nodes and the least node that each is linked to."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up, way = self.up, []
        while (y := up.setdefault(x, x)) != x:
            way.append(x)
            x = y
        for y in way:
            up[y] = x
        return x

    def add(self, u: int, v: int) -> None:
        u, v = self.top(u), self.top(v)
        self.up[max(u, v)] = min(u, v)

    def edges(self) -> pa.RecordBatch:
        nodes = [x for x, y in self.up.items() if x != y]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.top(x) for x in nodes], pa.int64())], names=["u", "v"])


def _linked(edges: DataFrame) -> DataFrame:
    """As many edges as nodes at most from each task's LINKED nodes, u > v, with the same components."""

    def run(batches):
        links = Links()
        for batch in batches:
            for u, v in zip(np.asarray(batch.column(0)).tolist(), np.asarray(batch.column(1)).tolist()):
                links.add(u, v)
                if len(links.up) >= LINKED:
                    yield links.edges()
                    links = Links()
        if links.up:
            yield links.edges()

    return arrow(edges, run, "u long, v long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (its least node) for each node that has an edge to another. edges: u, v (long), in any order and direction.

    A path of over 2^rounds nodes would not settle, which raises an error.
    """
    now = cut(_linked(edges.where("u != v").select("u", "v")))
    count = counted(now)
    for _ in range(rounds):
        tasks = -(-count // LINKED) or 1
        now = cut(_linked(now.coalesce(tasks)))
        before = _sign(now)
        now = cut(_star(_star(now, True, before[0], tasks), False, before[0], tasks))
        count = (after := _sign(now))[0]
        if after == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _sign(edges: DataFrame) -> tuple:
    """The number of edges, and a sum that other edges have not."""
    return tuple(taken(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))))[0])
