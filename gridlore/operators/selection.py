"""Choosing evidence: shapes, coherent profiles, tiered matches, anchors, best records, duplicates, makespans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered as O


def shape_summary(obs: DataFrame, by: list[str], wall: str, seq: str) -> DataFrame:
    """Per group: observations, least and median wall time, the newest, and the fastest one's number."""
    return obs.groupBy(*by).agg(F.count("*").alias("n"), F.min(wall).alias("fastest"), F.median(wall).alias("median"), F.max_by(wall, seq).alias("latest"), F.min_by(seq, F.struct(wall, seq)).alias("fastest_id"))


def preferred(shapes: DataFrame, by: list[str], rate: Column, ties: list[str]) -> DataFrame:
    """The shape with the highest rate (whole hundredths), then the least ties; null ties come last."""
    key = F.struct(-rate, *(x for t in ties for x in (F.col(t).isNull(), F.coalesce(F.col(t), F.lit(0)))))
    return shapes.groupBy(*by).agg(F.min_by(F.struct(*[c for c in shapes.columns if c not in by]), key).alias("_r")).select(*by, "_r.*")


def near_best_shapes(shapes: DataFrame, by: list[str], rate: str, shape: str, band: float = 0.98) -> DataFrame:
    best = shapes.groupBy(*by).agg(F.max(rate).alias("_b"))
    return shapes.join(best, by).where(F.col(rate) >= F.col("_b") * band).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_set(shape)), lambda x: x.cast("string")), ",").alias("shapes"))


def gauges(samples: DataFrame, by: list[str], cols: list[str], ts: str) -> DataFrame:
    """Mean and peak of gauges (nulls passed over), and the span of time."""
    return samples.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.sum, "sum"), (F.max, "peak"))), F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def common_value(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """The one value of a group, or mixed; none without values. Minimum and maximum tell, no distinct set is kept."""
    lo, hi = F.min(col), F.max(col)
    return df.groupBy(*by).agg(F.when(lo.isNull(), "none").when(lo == hi, lo.cast("string")).otherwise("mixed").alias("common"))


def coherent(df: DataFrame, by: list[str], cols: list[str], recency: str) -> DataFrame:
    """Groups whose rows agree in each of cols, with their size and newest row."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.max(recency).alias("newest"), *(F.min(c).alias(f"lo_{c}") for c in cols), *(F.max(c).alias(f"hi_{c}") for c in cols))
    for c in cols:
        g = g.where(F.col(f"lo_{c}") == F.col(f"hi_{c}"))
    return g.select(*by, "n", "newest", *(F.col(f"lo_{c}").alias(c) for c in cols))


def context_score(df: DataFrame, weights: list[tuple[str, Column, int]]) -> DataFrame:
    """Sum of the weights of what agrees, and its names."""
    score = sum((F.when(hit, w).otherwise(0) for _, hit, w in weights), F.lit(0))
    return df.withColumns({"score": score.cast("long"), "reasons": F.array_join(F.array_compact(F.array(*(F.when(hit, F.lit(n)) for n, hit, _ in weights))), "+")})


def tiered_match(targets: DataFrame, rows: DataFrame, key: str, tiers: list[tuple[str, str]], pick: list[str], result: list[str]) -> DataFrame:
    """For each target the best row of the first tier with any. tiers: (column of targets, column of rows), joined on equal values tier by tier."""
    out = None
    for k, (a, b) in enumerate(tiers):
        best = rows.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("_k")).agg(F.min_by(F.struct(*result), F.struct(*pick)).alias(f"_r{k}"))
        out = (targets if out is None else out).join(best, F.col(a) == F.col("_k"), "left").drop("_k")
    hit = F.coalesce(*(F.col(f"_r{k}") for k in range(len(tiers))))
    tier = F.coalesce(*(F.when(F.col(f"_r{k}").isNotNull(), k + 1) for k in range(len(tiers))), F.lit(0))
    return out.select(key, tier.cast("long").alias("tier"), *(hit[c].alias(c) for c in result))


def anchors(targets: DataFrame, anchor: DataFrame, by: list[str], at: str, x: str, y: str) -> DataFrame:
    """Nearest anchor at or below, and at or above, each target: one sort of both sides together, no range join."""
    a = anchor.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(None).cast("double").alias("_t"))
    t = targets.select(*by, F.col(at).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), F.col(at).cast("double").alias("_t"))
    both = a.unionByName(t)
    p = F.when(F.col("_t").isNull(), F.struct("_x", "_y"))
    w = Window.partitionBy(*by).orderBy("_x")
    lo = F.last(p, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    hi = F.first(p, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    return both.select(*by, "_t", lo.alias("lo"), hi.alias("hi")).where("_t is not null").select(*by, F.col("_t").alias(at), F.col("lo._x").alias("lo_x"), F.col("lo._y").alias("lo_y"), F.col("hi._x").alias("hi_x"), F.col("hi._y").alias("hi_y"))


def linear(df: DataFrame, at: str) -> DataFrame:
    """Straight line between the anchors; the one that is there beyond them."""
    x = F.col(at)
    mid = F.col("lo_y") + (F.col("hi_y") - F.col("lo_y")) * (x - F.col("lo_x")) / F.nullif(F.col("hi_x") - F.col("lo_x"), F.lit(0.0))
    return df.withColumn("predicted", F.coalesce(F.when(F.col("lo_x") == F.col("hi_x"), F.col("lo_y")), mid, F.col("lo_y"), F.col("hi_y")))


def power_interpolated(x: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """y as a power of x through two anchors: exact between them; beyond them with the exponent held to [0, 1]."""
    y1, y2 = F.greatest(F.lit(1e-9), y1), F.greatest(F.lit(1e-9), y2)
    slope = F.try_divide(F.ln(y2 / y1), F.ln(x2 / x1))
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), slope))
    return F.when(x1 == x2, y1).when(x <= x1, y1 * F.pow(x / x1, held)).when(x >= x2, y2 * F.pow(x / x2, held)).otherwise(y1 * F.pow(x / x1, slope))


def best_record(df: DataFrame, by: list[str], gate: Column, quality: Column, created: str, build: str) -> DataFrame:
    """Any gated record beats all others, the best of them first; without one the newest wins. One aggregation."""
    q = F.when(gate, quality).otherwise(F.lit(0.0))
    return df.groupBy(*by).agg(F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(gate.cast("int"), q, F.col(created), F.col(build))).alias("_r")).select(*by, "_r.*")


def duplicate_groups(df: DataFrame, digest: Column, id_: str) -> DataFrame:
    """Digests that several rows have: how many, the first, and a label by first appearance."""
    g = df.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(id_).alias("first_id")).where("n > 1")
    n = O.numbered(g, "first_id", [F.col("first_id").asc(), F.col("digest").asc()], {"_n": F.lit(1)})
    return n.withColumn("label", F.format_string("DUP-%04d", F.col("_n"))).drop("_n")
