"""Operators over an order: running records, plateaus, retention, runs, sweep lines, histograms.

A running value over a long sequence is a two-level scan: the sequence is cut into ranges, the ranges'
own totals are scanned (they are few), and each range is scanned from its carry, so that no task
needs the whole sequence even if a group holds most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def running_best(df: DataFrame, by: list[str], seq: str, value: str, width: int = 1 << 16) -> DataFrame:
    """prev_best: the largest value earlier in the group (null at first). seq: whole numbers, unique in a group."""
    cut = df.withColumn("_range", F.floor(F.col(seq) / width))
    carry = cut.groupBy(*by, "_range").agg(F.max(value).alias("_top"))
    carry = carry.select(*by, "_range", F.max("_top").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(*_BEFORE)).alias("_carry"))
    own = F.max(value).over(Window.partitionBy(*by, "_range").orderBy(seq).rowsBetween(*_BEFORE))
    return cut.join(carry, [*by, "_range"]).withColumn("prev_best", F.greatest(own, F.col("_carry"))).drop("_range", "_carry")


def record_history(df: DataFrame, by: list[str], seq: str, value: str) -> DataFrame:
    """The rows that strictly exceed all before them in their group."""
    return running_best(df, by, seq, value).where(F.col("prev_best").isNull() | (F.col(value) > F.col("prev_best"))).select(*by, seq, value, "prev_best")


def plateau(df: DataFrame, by: list[str], seq: str, value: str, gain_pct: float = 1.0, streak: int = 3) -> DataFrame:
    """Per group: rows, best, rows since the last gain of over gain_pct percent, and whether that ends the search."""
    r = running_best(df, by, seq, value)
    meaningful = F.col("prev_best").isNull() | ((F.col(value) - F.col("prev_best")) * 100 > gain_pct * F.col("prev_best"))
    last = r.groupBy(*by).agg(F.count("*").alias("n"), F.max(value).alias("best"), F.max(F.when(meaningful, F.col(seq))).alias("_last"))
    since = r.join(last.select(*by, "_last"), by).where(F.col(seq) > F.col("_last")).groupBy(*by).agg(F.count("*").alias("since_gain"))
    return last.join(since, by, "left").select(*by, "n", "best", F.col("_last").alias("last_gain"), F.coalesce("since_gain", F.lit(0)).alias("since_gain"), (F.coalesce("since_gain", F.lit(0)) >= streak).alias("stop"))


def numbered(df: DataFrame, at: str, order: list[Column], sums: dict[str, Column], bounds: tuple[float, float] | None = None, descending: bool = False, parts: int = 4096) -> DataFrame:
    """Running sums (inclusive) over all rows in an order that begins with the number `at`, nulls of it last.

    The order is cut into at most `parts` equal ranges of `at` between its bounds (found if not given);
    their totals, a bounded table, are scanned, and each range is scanned from its carry. Rows with
    equal `at` stay in one range.
    """
    x = F.col(at).cast("double")
    if bounds is None:
        ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        df, lo, hi = df.crossJoin(F.broadcast(ends)), F.col("_lo"), F.col("_hi")  # one row
    else:
        lo, hi = map(F.lit, bounds)
    place = F.greatest(F.lit(0), F.least(F.lit(parts), F.coalesce(F.floor(F.try_divide(x - lo, hi - lo) * parts), F.lit(0))))
    cut = df.withColumns({"_part": F.when(x.isNull(), parts + 1).otherwise(parts - place if descending else place), **{f"_s_{n}": c.cast("long") for n, c in sums.items()}})
    carry = cut.groupBy("_part").agg(*(F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums))
    carry = carry.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(Window.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)).alias(f"_c_{n}") for n in sums))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(carry), "_part").withColumns({n: F.col(f"_c_{n}") + F.sum(f"_s_{n}").over(own) for n in sums})
    return out.drop("_part", "_lo", "_hi", *(f"_{k}_{n}" for n in sums for k in "sc"))


def _cut(df: DataFrame, seq: str, parts: int = 4096) -> DataFrame:
    """df with _part, the range of seq (a number or a time) that a row is in: at most `parts` equal ones, nulls first."""
    x = F.col(seq).cast("double")
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    place = F.least(F.lit(parts - 1), F.floor(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")) * parts))
    return df.crossJoin(F.broadcast(ends)).withColumn("_part", F.when(x.isNull(), -1).otherwise(F.coalesce(place, F.lit(0)))).drop("_lo", "_hi")  # one row


def _beside(cut: DataFrame, by: list[str], seq: str, value: str, name: str, after: bool = False) -> DataFrame:
    """The value of the row before (or after) in its group: within the range, or from the nearest range that has rows, which are few."""
    step, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    one = F.struct(F.col(value).alias("v"))
    ends = cut.groupBy(*by, "_part").agg(edge(one, F.struct(seq)).alias("_end"))
    ends = ends.select(*by, "_part", step("_end").over(Window.partitionBy(*by).orderBy("_part")).alias("_carry"))
    own = step(one).over(Window.partitionBy(*by, "_part").orderBy(seq))
    return cut.join(ends, [*by, "_part"]).withColumn(name, F.coalesce(own, F.col("_carry"))["v"]).drop("_carry")


def _running(cut: DataFrame, by: list[str], seq: str, value: str, name: str) -> DataFrame:
    """Running sum in the group's order, equal seq together: within the range, from the sum of those before."""
    total = cut.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    total = total.select(*by, "_part", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)).alias("_carry"))
    own = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(seq))
    return cut.join(total, [*by, "_part"]).withColumn(name, own + F.col("_carry")).drop("_carry")


def counter_delta(df: DataFrame, by: list[str], seq: str, value: str) -> DataFrame:
    """Increase of a counter since the row before in its group, 0 where it fell, null for the first."""
    d = _beside(_cut(df, seq), by, seq, value, "_prev").drop("_part")
    return d.withColumn("delta", F.when(F.col("_prev").isNotNull(), F.greatest(F.col(value) - F.col("_prev"), F.lit(0)))).drop("_prev")


def newest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows of each group in an order; groups (or without them all parts) are cut to n before rows meet."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def one_of(df: DataFrame, by: list[str], pick: Column, largest: bool = True) -> DataFrame:
    """The row with the largest (or least) pick of each group, by one map-side aggregation."""
    row = F.struct(*df.columns)
    return df.groupBy(*by).agg((F.max_by if largest else F.min_by)(row, pick).alias("_r")).select("_r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str, last_wins: bool = True) -> DataFrame:
    """Rows by key over two batches: the last (or first) by batch, then order."""
    both = old.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    return one_of(both, key, F.struct("_b", order), last_wins).drop("_b")


def moving_average(df: DataFrame, by: list[str], pos: str, value: str, radius: int) -> DataFrame:
    """Means over positions within a radius, which the ends of a group cut; pos: whole numbers, unique in a group.

    A group is cut into stretches of positions; the rows near a stretch's ends also go to its neighbour, so that
    no task needs a whole group.
    """
    width = max(4096, 4 * radius)
    p = F.col(pos)
    home = F.floor(p / width)
    near = F.array_distinct(F.array(F.floor((p - radius) / width), home, F.floor((p + radius) / width)))
    spread = df.withColumn("_home", home).withColumn("_part", F.explode(near))
    w = Window.partitionBy(*by, "_part").orderBy(pos).rangeBetween(-radius, radius)
    out = spread.withColumn("smooth", F.sum(value).over(w) / F.count(value).over(w))
    return out.where(F.col("_part") == F.col("_home")).drop("_part", "_home")


def longest_run(df: DataFrame, by: list[str], pos: str, on: Column, gap: int, size: int) -> DataFrame:
    """Longest stretch of set positions with gaps of at most `gap`; the first of equal ones. One still open at the end goes to the end."""
    q = _beside(_cut(df.where(on).select(*by, pos), pos), by, pos, pos, "_prev")
    island = _running(q.withColumn("_new", F.when(F.col(pos) - F.col("_prev") > gap + 1, 1).otherwise(0)), by, pos, "_new", "_i")
    runs = island.groupBy(*by, "_i").agg(F.min(pos).alias("start"), F.max(pos).alias("_last")).withColumn("end", F.when(F.lit(size) - 1 - F.col("_last") <= gap, F.lit(size)).otherwise(F.col("_last") + 1))
    return one_of(runs.select(*by, "start", F.col("end").cast("int").alias("end")), by, F.struct(F.col("end") - F.col("start"), -F.col("start"))).withColumn("length", F.col("end") - F.col("start"))


def sweep_line(tasks: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Time at each number of active tasks. Starts and ends at one time are one step."""
    ev = tasks.select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.t", "e.d")
    step = _cut(ev.groupBy(*by, "t").agg(F.sum("d").alias("d")), "t")
    seg = _beside(_running(step, by, "t", "d", "active"), by, "t", "t", "_next", after=True).withColumn("span", F.col("_next") - F.col("t"))
    return seg.where("span is not null and active > 0").groupBy(*by, "active").agg(F.sum("span").alias("time"))


def cumulative(df: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """Running counts by value; value: a number or a time."""
    return _running(_cut(df, value), by, value, n, "cum").drop("_part")


def nearest_rank(hist: DataFrame, by: list[str], value: str, q: float, n: str = "n") -> DataFrame:
    """The least value whose cumulative count reaches q of all."""
    total = hist.groupBy(*by).agg(F.sum(n).alias("_t"))
    return cumulative(hist, by, value, n).join(total, by).where(F.col("cum") >= F.col("_t") * q).groupBy(*by).agg(F.min(value).alias("percentile"))


def entropy(hist: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Bits, from sums of n log n, so that one aggregation is enough."""
    return hist.where(F.col(n) > 0).groupBy(*by).agg(F.sum(n).alias("_n"), F.sum(F.col(n) * F.log2(F.col(n))).alias("_s")).select(*by, (F.log2("_n") - F.col("_s") / F.col("_n")).alias("entropy"))
