"""Planning rules as column expressions: budgets, threads, shards, workers, statuses, page quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The thread counts that a plan may use.
ALLOWED_THREADS = (1, 2, 4, 8, 16, 32, 48, 64)
# Seconds a shard should take, the margin on estimates, most shards, least threads of a queue worker.
SHARD_SECONDS, MARGIN, MOST_SHARDS, WORKER_THREADS = 1800, 1.2, 96, 48


def runner_threads(label: Column, cpus: Column, budgets: dict[str, int]) -> Column:
    """A named runner's budget (budgets: by lower-case name); twice the size of a class such as 32t (or the processors known); else processors, 16 at most."""
    name = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    named = F.lit(None).cast("int")
    for k, v in budgets.items():
        named = F.when(name == k, v).otherwise(named)
    size = F.regexp_extract(name, r"^(\d+)t$", 1).try_cast("int")
    return F.coalesce(named, F.when(size.isNotNull(), 2 * F.greatest(F.lit(1), F.coalesce(F.nullif(cpus, F.lit(0)), size))), F.greatest(F.lit(1), F.least(F.lit(16), F.coalesce(cpus, F.lit(1)))))


def pipeline_threads(budget: Column, pipelines: Column, requested: Column | None = None) -> Column:
    """Threads of each pipeline; requested null: as many as there are."""
    each = F.greatest(F.lit(1), F.floor(budget / F.greatest(F.lit(1), pipelines)).cast("int"))
    return each if requested is None else F.when(requested.isNull(), each).otherwise(F.least(F.greatest(F.lit(1), requested), each))


def automatic_threads(serial_seconds: Column, most: Column) -> Column:
    """The largest allowed count within what the estimated serial time asks for."""
    minutes = serial_seconds / 60
    wanted = F.when(minutes < 5, 1).when(minutes < 15, 4).when(minutes < 30, 8).otherwise(most)
    held = F.array_max(F.filter(F.array(*map(F.lit, ALLOWED_THREADS)), lambda x: x <= F.least(wanted, most)))
    return F.when(serial_seconds.isNull(), F.least(F.lit(4), most)).otherwise(held)


def speedup(threads: Column) -> Column:
    return F.greatest(F.lit(1.0), F.sqrt(F.greatest(F.lit(1), threads).cast("double")))


def shards(serial_seconds: Column, threads: Column, sets: Column, target: int = SHARD_SECONDS, most: int = MOST_SHARDS) -> Column:
    cap = F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(sets, F.lit(most))))
    want = F.ceil(serial_seconds * MARGIN / speedup(threads) / target)
    return F.when(serial_seconds.isNull() | (serial_seconds <= 0), 1).otherwise(F.greatest(F.lit(1), F.least(cap, want))).cast("long")


def serial_estimate(wall: Column, actual: Column, threads: Column, possible: Column) -> Column:
    """Serial seconds for all sets from one measured run; null without a positive time and count."""
    return F.when((wall > 0) & (actual > 0), wall * speedup(F.coalesce(threads, F.lit(1))) / actual * F.greatest(F.lit(1), possible))


def queue_workers(detectors: Column, budget: Column) -> Column:
    n = F.greatest(F.lit(1), detectors)
    return F.least(n, F.greatest(F.lit(1), F.bround(F.sqrt(n.cast("double"))).cast("int")), F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), budget) / WORKER_THREADS).cast("int")))


def workload_class(mode: Column, strategy: Column, limit: Column) -> Column:
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when((plain(mode) == "full") & (plain(limit) == "") & (plain(strategy) == "exhaustive"), "full-exhaustive").otherwise("short")


def feedback_workers(workers: Column, utilization: Column, tail: Column) -> Column:
    """One worker more where all are busy to the end, one less where many idle or few finish last."""
    n, u = F.greatest(F.lit(1), F.coalesce(workers, F.lit(1))), F.coalesce(utilization, F.lit(0.0))
    return F.when((u >= 0.90) & (tail <= 0.15), n + 1).when((n > 1) & ((u < 0.68) | (tail >= 0.35)), n - 1).otherwise(n)


def publication_status(mode: Column, complete: Column) -> Column:
    return F.when(mode == "smoke", "provisional").when(complete, "authoritative").otherwise("partial")


def correction(ratios: Column) -> Column:
    """Median of verified ratios held to [0.75, 1.25]; 1 without any. An aggregate."""
    return F.coalesce(F.least(F.lit(1.25), F.greatest(F.lit(0.75), F.median(ratios))), F.lit(1.0))


def quality(brightness: Column, contrast: Column, sharpness: Column, content: Column, touches: Column, blank: Column) -> Column:
    """A page's score in [0, 1], unrounded: brightness near 185, contrast, sharpness and content, less for border contact, at most 0.25 if blank."""
    part = lambda x, top: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / top))
    score = F.greatest(F.lit(0.0), 1 - F.abs(brightness - 185) / 150) * 0.22 + part(contrast, 60) * 0.30 + part(sharpness, 35) * 0.30 + part(content, 0.28) * 0.18
    score = F.when(touches, score - 0.08).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(blank, F.least(score, F.lit(0.25))).otherwise(score)))


def quality_status(score: Column, reasons: Column, fail: float, review: float) -> Column:
    return F.when(score < fail, "fail").when((score < review) | (F.size(reasons) > 0), "review").otherwise("pass")
