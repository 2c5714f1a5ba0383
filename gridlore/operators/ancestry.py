"""Which revisions, and which runs, descend from a floor: reachability over (child, parent) edges with any number of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop
from .search import union


def descendants(edges: DataFrame, floors: DataFrame, child: str = "revision", parent: str = "parent") -> DataFrame:
    """The revisions (column `child`) that descend from some floor (column `child`), floors included, each once.

    Semi-naive: a round follows the edges from what the last round found, and no others. To the edges are added leaps along first
    parents over 2, 4, 8, ... revisions (pointer doubling), so that a line of n revisions takes log n rounds at most, and a history
    as many for each change from one line to another on the way. Each round is a table: a lost executor costs one round.
    Edges with a null end, and loops, are none; cycles end, as what was found is not found again. A revision that very many have
    for a parent is one key of a join, which Spark splits (adaptive skew join).
    """
    e = cut(edges.where(f"{child} is not null and {parent} is not null and {child} != {parent}").select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct())
    leaps = [cut(e.groupBy("c").agg(F.min("p").alias("p")))]
    n = leaps[0].count()
    while 1 << len(leaps) <= n:  # beyond it only cycles have any
        leap = cut(leaps[-1].join(leaps[-1].select(F.col("c").alias("p"), F.col("p").alias("q")), "p").select("c", F.col("q").alias("p")))
        leaps.append(leap)
        if leap.isEmpty():
            break
    hops = cut(union([e, *leaps[1:]]))
    drop(e, *leaps)
    fresh = cut(floors.where(f"{child} is not null").select(F.col(child).alias("c")).distinct())
    found = [fresh]
    while not fresh.isEmpty():
        near = hops.join(fresh.withColumnRenamed("c", "p"), "p", "left_semi").select("c").distinct()
        fresh = cut(near.join(union(found), "c", "left_anti"))
        found.append(fresh)
        if len(found) > 8:
            old, found = found, [cut(union(found[:-1])), fresh]
            drop(*old[:-1])
    drop(hops)
    return union(found).select(F.col("c").alias(child))


def descended(runs: DataFrame, edges: DataFrame, floors: DataFrame) -> DataFrame:
    """runs (revision and others) with descends: whether the revision descends from a floor. A null revision does not."""
    reached = descendants(edges, floors).withColumn("descends", F.lit(True))
    return runs.join(reached, "revision", "left").withColumn("descends", F.coalesce("descends", F.lit(False))).select(*runs.columns, "descends")


def selected(runs: DataFrame, number: int | None = None) -> DataFrame:
    """Of runs as `descended` gives them those to rebuild: all that descend, or the one of a number, which must be there and descend."""
    if number is None:
        return runs.where("descends")
    one = runs.where(F.col("number") == number)
    flags = {r.descends for r in one.select("descends").distinct().collect()}  # two at most
    if not flags:
        raise ValueError(f"there is no run {number}")
    if True not in flags:
        raise ValueError(f"run {number} does not descend from the floor")
    return one.where("descends")
