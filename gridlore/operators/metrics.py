"""Set metrics, rankings, and comparisons of page evaluations. IoUs are whole hundredths, so sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered as O

OK = ("ok", "success")


def set_metrics(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One partial and one final aggregation. A failed page counts with the IoU that it has (none: 0), in all but ok_mean_iou."""
    ok = F.coalesce(F.lower(F.trim("status")).isin(*OK), F.lit(False))
    x = F.coalesce("iou", F.lit(0)).cast("long")
    m = pages.groupBy(*keys).agg(
        F.count("*").alias("n_pages"), F.count(F.when(ok, 1)).alias("n_ok"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.min(x).alias("m"),
        F.sum(F.when(ok, F.col("edge").cast("long"))).alias("e"), F.sum(F.when(ok, x)).alias("s_ok"),
    )
    n, s1, s2 = F.col("n_pages").cast("double"), F.col("s1").cast("double"), F.col("s2").cast("double")
    return m.select(
        *keys, "n_pages", "n_ok", (F.col("n_pages") - F.col("n_ok")).alias("n_failed"), (s1 / (n * 100)).alias("mean_iou"), F.try_divide(F.col("s_ok").cast("double"), F.col("n_ok") * F.lit(100.0)).alias("ok_mean_iou"),
        (F.col("m") / F.lit(100.0)).alias("min_iou"), (F.sqrt(F.greatest(n * s2 - s1 * s1, F.lit(0.0))) / (n * 100)).alias("std_iou"), F.try_divide(F.col("e").cast("double"), F.col("n_ok").cast("double")).alias("mean_edge"),
    )


def order(tie: list[str]) -> list[Column]:
    return [F.col("mean_iou").desc(), F.col("min_iou").desc(), F.col("n_failed").asc(), F.col("mean_edge").asc_nulls_last(), *(F.col(c).asc() for c in tie)]


def ranked(metrics: DataFrame, tie: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Ranks within groups, or over all sets, which are numbered in ranges of their mean."""
    if not by:
        return O.numbered(metrics, "mean_iou", order(tie), {name: F.lit(1)}, (0.0, 1.0), descending=True)
    return metrics.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order(tie))).cast("long"))


def top(metrics: DataFrame, tie: list[str], k: int) -> DataFrame:
    return metrics.orderBy(*order(tie)).limit(k)


def search_rank(metrics: DataFrame, member: Column, tie: list[str]) -> DataFrame:
    """rank over all sets, search_rank over the members of the search space, null for others."""
    n = O.numbered(metrics.withColumn("_in", F.coalesce(member, F.lit(False))), "mean_iou", order(tie), {"rank": F.lit(1), "search_rank": F.col("_in").cast("int")}, (0.0, 1.0), descending=True)
    return n.withColumn("search_rank", F.when(F.col("_in"), F.col("search_rank"))).drop("_in")


def upgraded(df: DataFrame) -> DataFrame:
    """All-page mean, least and deviation from those of successes: n_pages, n_ok, ok_mean, ok_std, perhaps ok_min -> mean_all, std_all, min_all. Without failed pages they are as given."""
    share = F.try_divide(F.col("n_ok").cast("double"), F.col("n_pages").cast("double"))
    mean = F.coalesce(F.col("ok_mean") * share, F.lit(0.0))
    second = F.coalesce((F.col("ok_std") * F.col("ok_std") + F.col("ok_mean") * F.col("ok_mean")) * share, F.lit(0.0))
    whole = F.col("n_ok") == F.col("n_pages")
    least = {"min_all": F.when(whole, F.col("ok_min")).otherwise(0.0)} if "ok_min" in df.columns else {}
    spread = F.when(whole, F.col("ok_std")).otherwise(F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))))
    return df.withColumns({"mean_all": F.when(whole, F.col("ok_mean")).otherwise(mean), **least, "std_all": spread})


# What a page's IoU may lose unremarked, and below what a match is poor.
REGRESSION, POOR = 0.001, 0.50


def against_baseline(winner: DataFrame, baseline: DataFrame, page: str = "page") -> DataFrame:
    """Winner pages (status, iou in hundredths) with the baseline's IoU (absent: 0), the change, a status, and the problems, of which a page may have several."""
    b = baseline.select(page, F.col("iou").alias("base_iou"))
    j = winner.join(b, page, "left").withColumns({"base_iou": F.coalesce("base_iou", F.lit(0)), "iou": F.coalesce("iou", F.lit(0))})
    delta = F.col("iou") - F.col("base_iou")
    worse, better = delta < -100 * REGRESSION, delta > 100 * REGRESSION
    lost = F.when(F.col("status") == "error", "Unprocessed").when(F.col("status") != "ok", "No polygon found").when(F.col("iou") == 0, "Zero overlap")
    change = F.coalesce(lost, F.when(F.col("base_iou") == 0, "Recovered").when(better, "Improved").when(worse, "Regressed").otherwise("Unchanged"))
    problems = F.array_compact(F.array(lost, F.when((F.col("status") == "ok") & (F.col("iou") > 0) & (F.col("iou") < 100 * POOR), "Poor match"), F.when(worse, "Regressed")))
    return j.withColumns({"delta": delta, "change": change, "problems": F.array_join(problems, "+")})


def confidence(metrics: DataFrame, exhaustive: bool) -> DataFrame:
    """One row: sets, the share that succeeded on all pages, the share near the best, score and class of the evidence."""
    best = metrics.agg(F.max("mean_iou").alias("best"))
    n = F.count("*").cast("double")
    j = metrics.crossJoin(F.broadcast(best)).agg(F.count("*").alias("n_sets"), (F.count(F.when(F.col("n_failed") == 0, 1)) / n).alias("success_rate"), (F.count(F.when(F.col("best") - F.col("mean_iou") <= 0.001, 1)) / n).alias("near_best_share"))  # one row
    score = F.lit(2 if exhaustive else 0) + F.when(F.col("success_rate") >= 0.90, 1).otherwise(0) + F.when(F.col("near_best_share") >= 0.01, 1).otherwise(0)
    return j.withColumns({"evidence": score.cast("long"), "confidence": F.when(score >= 4, "High").when(score >= 2, "Medium").otherwise("Low")})
