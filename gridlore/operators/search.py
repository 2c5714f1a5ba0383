"""Searches driven by measurements, of all groups at once: the next shape to measure, and refinement by intervals."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt, drop

# The share of the best rate that is near it, and the widest gap that is filled before the search goes on.
NEAR_BEST, SMALL_GAP = 0.98, 3
# Facts of a bucket, more or less, where they are dealt out by their search.
FACTS = 500_000


# the next shape
def measured(observations: DataFrame, by: list[str], shape: str, rate: str, order: str) -> DataFrame:
    """by, shape, rate: of each shape the last rate in order. Shapes and rates that are null or not above 0 are none."""
    rows = observations.where((F.col(shape) > 0) & (F.col(rate) > 0))
    return rows.groupBy(*by, F.col(shape).cast("long").alias("shape")).agg(F.max_by(F.col(rate).cast("double"), F.col(order)).alias("rate"))


def _middle(low: Column, high: Column) -> Column:
    """The whole number strictly between that is nearest to the geometric middle, the lower of equals; null if there is none."""
    product = low * high
    a = F.floor(F.sqrt(product.cast("double"))).cast("long")
    b = F.when(a * a == product, a).otherwise(a + 1)
    return F.when(high - low < 2, None).when(a <= low, b).when(b >= high, a).when(product <= a * b, a).otherwise(b)


def next_probe(groups: DataFrame, observations: DataFrame, by: list[str], near: float = NEAR_BEST) -> DataFrame:
    """groups with next_shape: the shape to measure next, or null where nothing is left to find out.

    groups: by, low, high, budget, thread_min (whole numbers, low from 1), one row each; observations: as `measured` gives
    them. Legal are shapes from low to the lesser of high and budget / thread_min. Measured are, one after another:
    the least and the greatest shape that divides the budget (the ends if none does); the lower part of a gap of
    up to SMALL_GAP between shapes that are both near the best; if the best lies between others, the nearer end of the near-best
    shapes around it, and nothing once both ends are measured; else the geometric middle of the wider interval beside
    the near-best shapes. A group's arrays hold its legal shapes at most.
    """
    g = groups.withColumns({c: F.col(c).cast("long") for c in ("low", "high", "budget", "thread_min")}).withColumn("_up", F.least("high", F.floor(F.col("budget") / F.col("thread_min")).cast("long")))
    legal = observations.join(g.select(*by, "low", "_up"), by).where(F.col("shape").between(F.col("low"), F.col("_up")))
    m = legal.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("shape", "rate"))).alias("_m"))
    low, up = F.col("low"), F.col("_up")
    g = g.join(m, by, "left").withColumn("_m", F.coalesce("_m", F.expr("cast(array() as array<struct<shape: bigint, rate: double>>)")))
    g = g.withColumn("_known", F.transform("_m", lambda x: x["shape"])).withColumn("_best", F.array_max(F.transform("_m", lambda x: x["rate"])))
    g = g.withColumn("_near", F.transform(F.filter("_m", lambda x: x["rate"] >= F.col("_best") * near), lambda x: x["shape"]))
    g = g.withColumn("_peak", F.array_min(F.transform(F.filter("_m", lambda x: x["rate"] == F.col("_best")), lambda x: x["shape"])))
    known, close, peak = F.col("_known"), F.col("_near"), F.col("_peak")

    common = F.when(low <= up, F.filter(F.sequence(low, up), lambda k: F.col("budget") % k == 0))
    first, last = F.coalesce(F.try_element_at(common, F.lit(1)), low), F.coalesce(F.try_element_at(common, F.lit(-1)), up)
    unknown = lambda k: ~F.array_contains(known, k)
    pairs = F.arrays_zip(F.slice(known, 1, F.greatest(F.size(known) - 1, F.lit(0))).alias("a"), F.slice(known, 2, F.greatest(F.size(known) - 1, F.lit(0))).alias("b"))
    gap = F.try_element_at(F.filter(pairs, lambda p: (p["b"] - p["a"]).between(2, SMALL_GAP) & F.array_contains(close, p["a"]) & F.array_contains(close, p["b"])), F.lit(1))["a"] + 1
    # the region of near-best shapes around the peak, and what lies beyond its ends
    left = F.array_max(F.filter(F.sequence(low - 1, peak - 1), lambda k: ~F.array_contains(close, k)))
    right = F.array_min(F.filter(F.sequence(peak + 1, up + 1), lambda k: ~F.array_contains(close, k)))
    left, right = F.when((left >= low) & unknown(left), left), F.when((right <= up) & unknown(right), right)
    edge = F.when(right.isNull() | (peak - left <= right - peak), left).otherwise(right)
    below, above = (F.array_max(F.filter(known, lambda k: k < close[0])), F.array_min(F.filter(known, lambda k: k > F.element_at(close, -1))))
    a, b = F.coalesce(below, low), F.coalesce(above, up)
    lower, upper = _middle(a, close[0]), _middle(F.element_at(close, -1), b)
    wide = F.when(upper.isNull() | (close[0] - a >= b - F.element_at(close, -1)), F.coalesce(lower, upper)).otherwise(upper)
    between = (known[0] < peak) & (F.element_at(known, -1) > peak)
    out = F.when((low > up) | (F.size(known) >= up - low + 1), None).when(unknown(first), first).when(unknown(last), last).when(gap.isNotNull(), gap).when(between, edge).otherwise(wide)
    return g.withColumn("next_shape", F.when(low <= up, out).cast("long")).select(*groups.columns, "next_shape")


# refinement
class lookup:
    """An evaluation of sets by the facts measured for them, null where there are none.

    known: key, dims, cost of each set once, dealt out by key when this is made. Sets that are dealt alike find their cost in place.
    """

    def __init__(self, facts: DataFrame, key: str, dims: list[str], cost: str):
        self.key, self.dims = key, dims
        self.buckets = max(facts.sparkSession.sparkContext.defaultParallelism, -(-facts.count() // FACTS))
        known = facts.select(key, *dims, F.col(cost).cast("double").alias("cost")).repartition(self.buckets, key).groupBy(key, *dims).agg(F.min("cost").alias("cost"))
        self.known = dealt(known, key, self.buckets, spread=False)

    def __call__(self, sets: DataFrame) -> DataFrame:
        known = self.known.select(F.col(self.key).alias("_key"), *(F.col(d).alias(f"_of_{d}") for d in self.dims), "cost")
        # two bounds for an equality, which would be one more key of the join, by which both sides would be dealt out anew
        same = [(F.col(d) >= F.col(f"_of_{d}")) & (F.col(d) <= F.col(f"_of_{d}")) for d in self.dims]
        return sets.hint("shuffle_hash").join(known, functools.reduce(lambda a, b: a & b, same, F.col(self.key) == F.col("_key")), "left").select(*sets.columns, "cost")


def domains(facts: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """Each search's distinct values of each dimension, in order, as arrays."""
    return facts.groupBy(key).agg(*(F.array_sort(F.collect_set(d)).alias(d) for d in dims))


def refine(starts: DataFrame, evaluate: Callable[[DataFrame], DataFrame], key: str, dims: list[str], passes: int = 3, radius: int = 1) -> DataFrame:
    """key, dims, cost of all sets that searches by intervals visit, many searches side by side; less cost is better.

    starts: key, the values of each dimension in order as arrays (no nulls, one value at least) under its name, and where the
    search starts (a place from 0) as start_<dimension>. A search takes its dimensions in turn. It looks at both ends and the middle
    of an interval of places, and goes on with the half of the best of them (the lower half if that is the middle) until three places
    are left; if one was better than the set it came from, it goes there. Once a pass changes nothing, or after `passes`, all sets within
    `radius` places follow. Ties go to what was there before, then to the lower place. `evaluate` gets rows with key and dims (and columns
    that it must keep), of all searches in one table and never a set of a search twice, and adds their cost; a null cost is worse than all others.

    The searches are a table, a row each with what it has seen so far, which is written anew for each dimension of a pass; a step between is one
    job that writes its interval and what it has found in this dimension, so a lost executor costs one step. Both are dealt out by key, as the facts
    of a `lookup` are, so that a step moves no rows but those that another `evaluate` moves. There are as many steps as passes x dimensions
    x the logarithm of the longest domain. Searches whose key is null are none.
    """
    kinds = ", ".join(f"{d}: {dict(starts.dtypes)[d][6:-1]}" for d in dims)
    seen_type, worst = f"array<struct<{kinds}, cost: double>>", F.lit(float("inf"))
    none = F.expr(f"cast(array() as {seen_type})")
    at = {d: F.element_at(F.col(f"_v_{d}"), F.col(f"_at_{d}") + 1) for d in dims}
    buckets = getattr(evaluate, "buckets", None) or int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = dealt(starts.where(F.col(key).isNotNull()).select(key, *(F.col(d).alias(f"_v_{d}") for d in dims), *(F.col(f"start_{d}").cast("int").alias(f"_at_{d}") for d in dims)), key, buckets)
    longest = first.agg(*(F.max(F.size(f"_v_{d}")).alias(d) for d in dims)).first()
    state = evaluate(first.select("*", *(c.alias(d) for d, c in at.items()))).withColumn("_seen", F.array(F.struct(*dims, F.col("cost").cast("double").alias("cost"))).cast(seen_type))
    state = dealt(state.withColumns({"_cost": F.coalesce(F.col("cost").cast("double"), worst), "_moves": F.lit(True), "_moved": F.lit(False)}).drop(*dims, "cost"), key, buckets, spread=False)
    drop(first)

    def same(a: Column, b: Column | None = None) -> Column:
        return functools.reduce(lambda x, y: x & y, (a[d] == (F.col(d) if b is None else b[d]) for d in dims))

    for _ in range(passes):
        for d in dims:
            size, steps, width = F.size(f"_v_{d}"), 1, (longest[d] or 1) - 1
            while width > 2:
                steps, width = steps + 1, -(-width // 2)
            line = None
            for step in range(steps):
                if line is None:
                    now = state.withColumns({"_lo": F.lit(0), "_hi": size - 1, "_k": F.col(f"_at_{d}"), "_c": F.col("_cost"), "_on": F.col("_moves") & (size > 1), "_more": none})
                else:
                    now = state.join(line, key)
                middle = F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("int")
                sets = F.transform(F.array_distinct(F.array("_lo", middle, "_hi")), lambda p: F.struct(p.alias("_p"), *(F.element_at(F.col(f"_v_{d}"), p + 1).alias(d) if x == d else c.alias(x) for x, c in at.items())))  # noqa: B023
                now = now.withColumns({"_sets": F.when(F.col("_on"), sets), "_all": F.concat("_seen", "_more")})
                new = F.filter("_sets", lambda s: ~F.exists("_all", lambda x: same(x, s)))
                old = F.filter(F.transform("_sets", lambda s: F.struct(F.filter("_all", lambda x: same(x, s)).alias("was"), s["_p"].alias("_p"))), lambda s: F.size(s["was"]) > 0)
                asked = evaluate(now.where("_on").select(key, F.explode(new).alias("_s")).select(key, "_s.*"))
                found = asked.groupBy(key).agg(F.collect_list(F.struct("_p", *dims, F.col("cost").cast("double").alias("cost"))).alias("_found"))
                now = now.withColumn("_old", F.transform(old, lambda s: F.struct(F.coalesce(s["was"][0]["cost"], worst).alias("cost"), s["_p"].alias("_p")))).drop("_sets", "_all").join(found, key, "left")
                costs = F.concat("_old", F.coalesce(F.transform("_found", lambda s: F.struct(F.coalesce(s["cost"], worst).alias("cost"), s["_p"].alias("_p"))), F.expr("cast(array() as array<struct<cost: double, _p: int>>)")))
                more = F.coalesce(F.transform("_found", lambda s: F.struct(*(s[x].alias(x) for x in dims), s["cost"].alias("cost"))).cast(seen_type), none)
                now = now.withColumns({"_b": F.array_min(costs), "_more": F.concat("_more", more)})
                c, p = F.col("_b.cost"), F.col("_b._p")
                go, better = F.col("_on") & (F.col("_hi") - F.col("_lo") > 2), F.col("_on") & (c < F.col("_c"))
                now = now.withColumns({
                    "_k": F.when(better, p).otherwise(F.col("_k")), "_c": F.when(better, c).otherwise(F.col("_c")), "_on": go,
                    "_lo": F.when(go & (p > middle), middle).otherwise(F.col("_lo")), "_hi": F.when(go & (p <= middle), middle).otherwise(F.col("_hi")),
                })
                if step < steps - 1:
                    read, line = line, dealt(now.select(key, "_lo", "_hi", "_k", "_c", "_on", "_more"), key, buckets, spread=False)
                    drop(*([read] if read else []))
            now = now.withColumns({"_moved": F.col("_moved") | (F.col("_k") != F.col(f"_at_{d}")), f"_at_{d}": F.col("_k"), "_cost": F.col("_c"), "_seen": F.concat("_seen", "_more")})
            if d == dims[-1]:
                now = now.withColumns({"_moves": F.col("_moved"), "_moved": F.lit(False)})
            old_state, state = state, dealt(now.select(*state.columns), key, buckets, spread=False)
            drop(old_state, *([line] if line else []))
        if state.where("_moves").isEmpty():
            break
    around = state.select(key, "_seen", *(F.slice(f"_v_{d}", F.greatest(F.col(f"_at_{d}") - radius, F.lit(0)) + 1, F.least(F.col(f"_at_{d}") + radius, F.size(f"_v_{d}") - 1) - F.greatest(F.col(f"_at_{d}") - radius, F.lit(0)) + 1).alias(d) for d in dims))
    for d in dims:
        around = around.withColumn(d, F.explode(d))
    around = around.where(~F.exists("_seen", lambda x: same(x))).select(key, *dims)
    return state.select(key, F.inline("_seen")).unionByName(evaluate(around).select(key, *dims, F.col("cost").cast("double").alias("cost")))


def union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)
