"""Which parameters matter: effect sizes, near-best coverage, interactions, failures, landscape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(sets: DataFrame, dims: list[str], score: str = "mean_iou") -> DataFrame:
    """A row for each parameter that a set has (null: has not), made map-side; pre-aggregation follows before any shuffle. A set is one score."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("parameter"), F.col(d).cast("string").alias("value")) for d in dims)))
    return sets.select(pairs.alias("_p"), F.col(score).cast("double").alias("score")).select("_p.parameter", "_p.value", "score").where("value is not null")


def value_moments(sets: DataFrame, dims: list[str], score: str = "mean_iou") -> DataFrame:
    return unpivot(sets, dims, score).groupBy("parameter", "value").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"), F.max("score").alias("best"))


def totals(sets: DataFrame, score: str = "mean_iou") -> DataFrame:
    """One row: sets, sum and sum of squares of their scores."""
    x = F.col(score).cast("double")
    return sets.agg(F.count(x).alias("n_all"), F.sum(x).alias("s_all"), F.sum(x * x).alias("ss_all"))


def effects(moments: DataFrame, total: DataFrame) -> DataFrame:
    """Per parameter: values, eta squared (between-value share of the squares about the mean of all sets, in [0, 1]; 0 if there are none), range of the values' means."""
    mean = F.col("s") / F.col("n")
    p = moments.groupBy("parameter").agg(F.count("*").alias("n_values"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.max(mean).alias("hi"), F.min(mean).alias("lo"))
    p = p.crossJoin(F.broadcast(total))  # one row
    m = F.col("s_all") / F.col("n_all")
    between = F.col("q") - 2 * m * F.col("s") + m * m * F.col("n")
    squares = F.col("ss_all") - m * F.col("s_all")
    eta = F.when(squares <= 1e-15, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), between / squares)))
    return p.select("parameter", "n_values", eta.alias("eta_squared"), (F.col("hi") - F.col("lo")).alias("mean_range"))


def influence(sets: DataFrame, dims: list[str], score: str = "mean_iou") -> DataFrame:
    """Effects of the parameters on the sets' scores, and their classes. Two levels of aggregation, the second over values only."""
    e = effects(value_moments(sets, dims, score), totals(sets, score))
    return e.withColumn("influence", influence_class(F.col("eta_squared"), F.col("mean_range")))


# Effect classes with their ranks, and absolute distances from the best mean IoU.
RANKS = {"Zombie": -1, "Dormant": 0, "Low": 1, "Moderate": 2, "Important": 3, "Critical": 4}
NEAR_BEST, EQUIVALENT = 0.001, 0.0001


def influence_class(eta: Column, width: Column) -> Column:
    """Zombie (no effect of any size) is tested before Dormant."""
    return F.when((eta < 0.0005) & (width < 0.0005), "Zombie").when(eta < 0.005, "Dormant").when(eta >= 0.14, "Critical").when(eta >= 0.06, "Important").when(eta >= 0.02, "Moderate").otherwise("Low")


def best_values(sets: DataFrame, dims: list[str], k: int = 3, score: str = "mean_iou") -> DataFrame:
    from pyspark.sql import Window

    v = value_moments(sets, dims, score).withColumn("mean_iou", F.col("s") / F.col("n"))
    place = F.row_number().over(Window.partitionBy("parameter").orderBy(F.col("mean_iou").desc(), F.col("value"))).cast("long")
    return v.withColumn("place", place).where(F.col("place") <= k).select("parameter", "place", "value", "n", "mean_iou")


# How many parameters are paired, and how many ranked sets the pairs are judged on.
PAIRED, PAIR_SAMPLE = 6, 50_000


def interactions(sets: DataFrame, dims: list[str], score: str = "mean_iou", most: int = PAIRED) -> DataFrame:
    """For pairs of the strongest parameters: eta squared of the pair's cells, and what it has over the larger of the two alone.

    Sets are aggregated once to cells of the strongest parameters' single and paired values; all effects come
    from these cells. sets: all, or every n-th of the ranked ones where there are over PAIR_SAMPLE.
    """
    order = influence(sets, dims, score).orderBy(F.col("eta_squared").desc(), F.col("mean_range").desc(), "parameter").limit(most)
    strong = [r.parameter for r in order.select("parameter").collect()]  # names of a few parameters
    pairs = [(a, b) for i, a in enumerate(strong) for b in strong[i + 1 :]]
    if not pairs:
        return sets.sparkSession.createDataFrame([], "a string, b string, joint double, interaction double")
    one = [F.struct(F.lit(a).alias("parameter"), F.lit("").alias("other"), F.col(a).cast("string").alias("value")) for a in strong]
    two = [F.struct(F.lit(a).alias("parameter"), F.lit(b).alias("other"), F.concat(F.col(a).cast("string"), F.lit("\x1f"), F.col(b).cast("string")).alias("value")) for a, b in pairs]
    rows = sets.select(F.explode(F.array(*one, *two)).alias("_p"), F.col(score).cast("double").alias("score")).where("_p.value is not null")
    name = F.struct("_p.parameter", "_p.other")
    cells = rows.groupBy(name.alias("parameter"), F.col("_p.value").alias("value")).agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    eta = effects(cells, totals(sets, score)).select("parameter.*", "eta_squared")
    # the effects are a row for each parameter and pair: one group for each pair holds three
    of = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs)))
    spread = eta.withColumn("_of", of).where(((F.col("other") == "") & F.col("parameter").isin(*strong) & ((F.col("parameter") == F.col("_of.a")) | (F.col("parameter") == F.col("_of.b")))) | ((F.col("parameter") == F.col("_of.a")) & (F.col("other") == F.col("_of.b"))))
    g = spread.groupBy("_of").agg(F.max(F.when(F.col("other") != "", F.col("eta_squared"))).alias("joint"), F.max(F.when(F.col("other") == "", F.col("eta_squared"))).alias("single"))
    return g.select("_of.a", "_of.b", "joint", F.greatest(F.lit(0.0), F.col("joint") - F.col("single")).alias("interaction"))


def domain_counts(sets: DataFrame, dims: list[str], score: str = "mean_iou") -> DataFrame:
    """How many sets the domains of parameters above each class have; without parameters none."""
    i = influence(sets, dims, score)
    level = F.lit(0)
    for name, rank in RANKS.items():
        level = F.when(F.col("influence") == name, rank).otherwise(level)
    tiers = F.explode(F.array(*(F.struct(F.lit(n).alias("domain"), F.lit(k).alias("least")) for n, k in (("critical", 4), ("important_plus", 3), ("moderate_plus", 2), ("low_plus", 1), ("non_dormant", 1), ("exhaustive", -1)))))
    one = i.select(tiers.alias("t"), level.alias("level"), "n_values").select("t.domain", "t.least", "level", "n_values")
    return one.groupBy("domain").agg(F.count(F.when(F.col("level") >= F.col("least"), 1)).alias("n_parameters"), F.collect_list(F.when(F.col("level") >= F.col("least"), F.col("n_values"))).alias("ns")).select("domain", "n_parameters", F.when(F.col("n_parameters") == 0, 0).otherwise(F.aggregate("ns", F.lit(1).cast("long"), lambda a, x: a * x)).cast("long").alias("n_sets"))


def landscape(metrics: DataFrame) -> DataFrame:
    """Quartiles of the sets' means and how many are near the best."""
    best = metrics.agg(F.max("mean_iou").alias("best"))
    j = metrics.crossJoin(F.broadcast(best))  # one row
    return j.agg(F.count("*").alias("n_sets"), F.max("best").alias("best"), F.percentile("mean_iou", 0.25).alias("q25"), F.percentile("mean_iou", 0.5).alias("q50"), F.percentile("mean_iou", 0.75).alias("q75"), F.count(F.when(F.col("best") - F.col("mean_iou") <= NEAR_BEST, 1)).alias("near_best"), F.count(F.when(F.col("best") - F.col("mean_iou") <= EQUIVALENT, 1)).alias("equivalent"))


def near_values(pages: DataFrame, metrics: DataFrame, key: str, dim: str) -> DataFrame:
    """Values of a parameter among near-best sets, and among all."""
    best = metrics.agg(F.max("mean_iou").alias("best"))
    near = metrics.crossJoin(F.broadcast(best)).select(key, (F.col("best") - F.col("mean_iou") <= NEAR_BEST).alias("near"))
    return pages.select(key, dim).distinct().join(near, key).agg(F.count_distinct(F.when(F.col("near"), F.col(dim))).alias("near_values"), F.count_distinct(dim).alias("all_values"))


def page_sensitivity(pages: DataFrame) -> DataFrame:
    """Per page: evaluations, failures, mean, and range of IoU."""
    return pages.groupBy("page").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") != "ok", 1)).alias("n_failed"), (F.sum(F.col("iou").cast("long")).cast("double") / (F.count("*") * F.lit(100.0))).alias("mean_iou"), ((F.max("iou") - F.min("iou")) / F.lit(100.0)).alias("iou_range"))


def failure_reasons(pages: DataFrame) -> DataFrame:
    return pages.where("status != 'ok'").groupBy("detector", "status").agg(F.count("*").alias("n"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.min("page").alias("first_page"))
