"""Whole runs: shard sets, totals, reranking from facts, report rows and the verdicts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M


# shards
def shard_sets(shards: DataFrame, run: str, index: str, count: str) -> DataFrame:
    """Per run: expected shards, whether all name one count, those missing and those beyond (ascending, comma-joined), and whether the set is whole."""
    g = shards.groupBy(run).agg(F.max(count).cast("int").alias("expected"), F.min(count).alias("_least"), F.collect_set(F.col(index).cast("int")).alias("_found"))  # a run's shards are few
    want = F.when(F.col("expected") > 0, F.sequence(F.lit(0), F.col("expected") - 1)).otherwise(F.array().cast("array<int>"))
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ",")
    missing, extra, one = F.array_except(want, "_found"), F.array_except("_found", want), F.col("_least") == F.col("expected")
    return g.select(run, "expected", one.alias("one_count"), text(missing).alias("missing"), text(extra).alias("extra"), (one & (F.size(missing) == 0) & (F.size(extra) == 0)).alias("whole"))


def whole_shards(shards: DataFrame, run: str, index: str, count: str) -> DataFrame:
    """The shards, or an error that names the first run whose set is not whole."""
    s = shard_sets(shards, run, index, count)
    said = F.concat(F.lit("invalid shard set of "), F.col(run).cast("string"), F.lit(": missing "), F.col("missing"), F.lit(", extra "), F.col("extra"))
    checked = s.where(F.when(F.col("whole"), True).otherwise(F.raise_error(said).cast("boolean")))
    return shards.join(checked.select(run), run, "left_semi")


def set_difference(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, with the side: missing (not found) or extra (not expected)."""
    a, b = expected.select(*key).distinct().withColumn("_a", F.lit(True)), found.select(*key).distinct().withColumn("_b", F.lit(True))
    j = a.join(b, key, "full").where(F.col("_a").isNull() | F.col("_b").isNull())
    return j.select(*key, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("side"))


# reranking and totals
def rerank(pages: DataFrame, stored: DataFrame, run: str, key: str) -> DataFrame:
    """Each run ranked again from its page facts: winner, what was stored, whether it changed, and the counts that follow from the facts. stored: run, winner."""
    m = M.set_metrics(pages, [run, key])
    worst = F.struct(-F.col("mean_iou"), -F.col("min_iou"), F.col("n_failed"), F.col("mean_edge").isNull(), F.coalesce("mean_edge", F.lit(0.0)), F.col(key))
    g = m.groupBy(run).agg(F.min_by(F.struct(key, "mean_iou"), worst).alias("_w"), F.count("*").alias("n_sets"), F.sum("n_ok").alias("n_ok_pages"), F.count(F.when(F.col("n_failed") == 0, 1)).alias("n_whole_sets"), F.sum("n_failed").alias("n_failures"))
    j = g.join(stored.select(run, F.col("winner").alias("previous")), run, "left")
    return j.select(run, F.col(f"_w.{key}").alias("winner"), F.col("_w.mean_iou").alias("mean_iou"), "previous", F.coalesce(F.col("previous") != F.col(f"_w.{key}"), F.lit(False)).alias("changed"), "n_sets", "n_ok_pages", "n_whole_sets", "n_failures")


def rebuild_totals(outcomes: DataFrame, outcome: str, changed: str) -> DataFrame:
    """One row: runs seen, reranked, with another winner, skipped, failed."""
    n = lambda c: F.count(F.when(c, 1))
    done = F.col(outcome) == "reranked"
    return outcomes.agg(F.count("*").alias("seen"), n(done).alias("reranked"), n(done & F.col(changed)).alias("changed"), n(F.col(outcome) == "skipped").alias("skipped"), n(F.col(outcome) == "failed").alias("failed"))


def totals(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Completed runs, sets, page evaluations, time spent, time passed, and how many ran at once on average. runs: sets, pages, elapsed, started, finished (seconds)."""
    span = F.max("finished") - F.min("started")
    return runs.groupBy(*(by or [])).agg(
        F.count("*").alias("n_runs"), F.sum("sets").alias("n_sets"), F.sum(F.col("sets") * F.col("pages")).alias("n_evaluations"), F.sum("elapsed").alias("elapsed"), span.alias("span"),
        F.try_divide(F.sum("elapsed").cast("double"), F.when(span > 0, span).cast("double")).alias("concurrency"),
    )


def execution(runs: DataFrame, settings: list[str], by: list[str] | None = None) -> DataFrame:
    """Time passed, and each setting: its one value, mixed, or null without any."""
    shared = [F.when(F.min(c) == F.max(c), F.min(c).cast("string")).when(F.min(c).isNotNull(), "mixed").alias(c) for c in settings]
    return runs.groupBy(*(by or [])).agg((F.max("finished") - F.min("started")).alias("span"), *shared)


# report rows
def metric_view(df: DataFrame) -> DataFrame:
    """mean, mean_ok, least, deviation and failures of a record: the winner's if it has a mean, else those of the selection, whose mean may be the landscape's best.

    df: structs winner and selection (mean, mean_ok, least, deviation, failures) and landscape (best).
    """
    w, s = F.col("winner"), F.col("selection")
    has = w["mean"].isNotNull()
    mean = F.when(has, w["mean"]).otherwise(F.coalesce(s["mean"], F.col("landscape.best")))
    pick = lambda c: F.when(has, w[c]).otherwise(s[c])
    return df.withColumns({"mean": mean, "mean_ok": F.coalesce(pick("mean_ok"), mean), "least": pick("least"), "deviation": pick("deviation"), "failures": pick("failures")})


def surpassed(winner: Column, baseline: Column) -> Column:
    return F.coalesce(winner > baseline, F.lit(False))


def page_rate(seconds: Column, pages: Column) -> Column:
    return F.when((seconds > 0) & (pages > 0), pages / seconds)


def document_seconds(rate: Column, images: Column) -> Column:
    return F.when((rate > 0) & (images > 0), images / rate)


def result_row(df: DataFrame) -> DataFrame:
    """A run's report row: gain over the baseline (null without one; absent means count 0), page rate, seconds for its document. df: mean, baseline_there, baseline_mean, seconds, pages, images."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    d = df.withColumns({"delta": F.when(F.col("baseline_there"), zero("mean") - zero("baseline_mean")), "page_rate": page_rate(F.col("seconds"), F.col("pages"))})
    return d.withColumns({"document_seconds": document_seconds(F.col("page_rate"), F.col("images")), "surpassed": surpassed(F.col("mean"), F.col("baseline_mean"))})


#: What a calibration's JSON holds of what its row needs.
PAYLOAD = (
    "search struct<exhaustive_complete: boolean, parameter_sets: bigint, fully_successful_rate: double, strategy: string>, landscape struct<best_mean_iou: double, near_best_share: double, equivalent_winner_share: double>, "
    "selection struct<best_avg_iou: double, avg_iou_success: double, minimum_iou: double, stddev_iou: double, failure_count: bigint, recommended: string, evidence: string, near_best_coverage: double>, "
    "confidence struct<rating: string>, identity struct<created: string, commit: string>, winner struct<mean: double, mean_ok: double, least: double, deviation: double, failures: bigint, id: string>, baseline struct<mean: double>"
)


def record_rows(entries: DataFrame, payload: str = "payload") -> DataFrame:
    """Flat rows of calibrations: the entry's own fields first, then the payload's in their order. entries: detector, status, created, dataset, parameter, payload (JSON)."""
    p = F.from_json(payload, PAYLOAD)
    d = entries.withColumn("_p", p)
    s = F.col("_p.selection")
    view = d.withColumns({
        "winner": F.col("_p.winner"), "landscape": F.struct(F.col("_p.landscape.best_mean_iou").alias("best")),
        "selection": F.struct(s["best_avg_iou"].alias("mean"), s["avg_iou_success"].alias("mean_ok"), s["minimum_iou"].alias("least"), s["stddev_iou"].alias("deviation"), s["failure_count"].alias("failures")),
    })
    v = metric_view(view)
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    unknown = lambda *cs: F.coalesce(*(blank(c) for c in cs), F.lit("unknown"))
    complete = F.coalesce(F.col("_p.search.exhaustive_complete"), F.lit(False))
    status = F.coalesce(blank(F.col("status")), F.when(complete, "authoritative").otherwise("partial"))
    return v.select(
        "detector", unknown(F.col("dataset")).alias("dataset"), F.left(unknown(F.col("created"), F.col("_p.identity.created")), F.lit(10)).alias("date"), status.alias("status"),
        F.left(unknown(s["recommended"], F.col("parameter"), F.col("_p.winner.id")), F.lit(12)).alias("parameter"), F.when(complete, "complete").otherwise("partial").alias("coverage"),
        F.col("_p.search.parameter_sets").alias("n_sets"), F.col("_p.search.fully_successful_rate").alias("success_rate"), "mean", "mean_ok", "least", "deviation", "failures",
        (F.col("mean") - F.col("_p.baseline.mean")).alias("delta"), F.coalesce("_p.landscape.near_best_share", s["near_best_coverage"]).alias("near_best_share"),
        unknown(s["evidence"], F.col("_p.confidence.rating")).alias("evidence"), F.coalesce("_p.identity.commit", F.lit("")).alias("revision"),
    )


# verdicts
def recommendation(rank: Column, near_best: Column, complete: Column, evaluated: Column, possible: Column) -> Column:
    """What to do with a detector, by name: unavailable, outranked, calibrated, continue, retain. near_best null: there is no calibration."""
    share = F.coalesce(F.try_divide(evaluated, possible), F.lit(0.0))
    return (
        F.when(near_best.isNull(), "unavailable").when(rank > 1, "outranked").when((near_best >= 0.50) & (complete | (share >= 0.50)), "calibrated")
        .when((near_best <= 0.05) & ~complete & (share < 0.50), "continue").otherwise("retain")
    )


def tuning_worth(near_best: Column, parameters: Column, dormant: Column, success: Column, page_success: Column, complete: Column) -> Column:
    """Whether more tuning pays, by name: low, reliability, broaden, characterised, some."""
    idle = (parameters == 0) | (dormant / F.nullif(parameters, F.lit(0)) >= 0.75)
    return F.when((near_best >= 0.90) & idle, "low").when((success < 0.50) | (page_success == 0), "reliability").when((near_best <= 0.05) & ~complete, "broaden").when(complete, "characterised").otherwise("some")


def scope_sets(sizes: Column, scope: str) -> Column:
    """Sets of an effect domain (sizes: a map by name), or of the next wider one that has any."""
    from .evidence import EFFECTS

    names = EFFECTS[EFFECTS.index(scope) :]
    return F.coalesce(*(F.when(F.element_at(sizes, F.lit(n)) > 0, F.element_at(sizes, F.lit(n))) for n in names))


def claim_strategy(pipelines: Column, loading: Column, queued: Column) -> Column:
    """struct<strategy, seeds>: batches for several pipelines over a queue longest first, else single claims."""
    batched = (F.coalesce(pipelines, F.lit(1)) > 1) & (F.lower(F.trim(F.coalesce(loading, F.lit("")))) == "lpt") & (queued > 0)
    return F.struct(F.when(batched, "batches").otherwise("dynamic").alias("strategy"), F.when(batched, F.least(pipelines, queued)).otherwise(0).cast("long").alias("seeds"))


def search_budget(limit: Column, distinct_best: Column) -> Column:
    """Sets left to a limited search beside the baseline and a best of its own; null (no limit) stays."""
    return F.when(limit.isNotNull(), F.greatest(F.lit(0), limit - 1 - F.coalesce(distinct_best, F.lit(False)).cast("int")))


def debug_pairs(ranked: DataFrame, pages: DataFrame, key: str, policy: str) -> DataFrame:
    """(set, page) pairs to draw: none, failures, winner (rank 1) or all."""
    j = pages.join(ranked.select(key, "rank"), key)
    return {"none": j.limit(0), "failures": j.where("status <> 'ok'"), "winner": j.where("rank = 1"), "all": j}[policy].select(key, "page", "rank", "status")


# joins of pages
def with_defaults(pages: DataFrame, manifest: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Pages with their manifest's fields; those of pages that it lacks have the defaults."""
    j = pages.join(manifest.select(on, *defaults, F.lit(True).alias("_there")), on, "left")
    return j.withColumns({c: F.when(F.col("_there"), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()}).drop("_there")


def claim_waits(tasks: DataFrame, claims: DataFrame, batch: str) -> DataFrame:
    """Seconds between a batch's claim and its tasks' starts, 0 at least; 0 for tasks without a claim."""
    wait = F.coalesce(F.greatest(F.lit(0), F.col("start") - F.col("claimed")), F.lit(0))
    return tasks.join(claims.select(batch, "claimed"), batch, "left").withColumn("wait", wait)


def numbered_sources(pages: DataFrame, source: str, pos: str, overrides: DataFrame, head: str = "head", tail: str = "tail") -> DataFrame:
    """Page numbers that go on over the sources in order, or restart where a source has a start of its own; head and tail pages of a source are left out.

    overrides: source, start (null: go on), head, tail. Sources are few: each is one row of the carry.
    """
    from pyspark.sql import Window

    size = pages.groupBy(source).agg(F.max(pos).alias("_last"), F.min(pos).alias("_first"))
    o = size.join(overrides, source, "left").withColumns({"_lo": F.col("_first") + F.coalesce(F.col(head), F.lit(0)), "_hi": F.col("_last") - F.coalesce(F.col(tail), F.lit(0))})
    inside = pages.join(F.broadcast(o.select(source, "_lo", "_hi")), source).where(F.col(pos).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    counts = inside.groupBy(source).agg(F.count("*").alias("_n"))
    w = Window.orderBy(source)  # a row for each source
    seg = o.join(counts, source, "left").select(source, "start", F.coalesce("_n", F.lit(0)).alias("_n")).withColumn("_seg", F.count("start").over(w))
    in_seg = Window.partitionBy("_seg").orderBy(source)
    base = F.coalesce(F.first("start").over(in_seg.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(1)) + F.coalesce(F.sum("_n").over(in_seg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = seg.select(source, base.alias("_base"))
    place = F.row_number().over(Window.partitionBy(source).orderBy(pos))
    return inside.withColumn("_k", place).join(F.broadcast(bases), source).withColumn("number", (F.col("_base") + F.col("_k") - 1).cast("long")).drop("_k", "_base")


# candidates of detectors
def candidate_summary(found: DataFrame, by: list[str]) -> DataFrame:
    """Counts of ok, empty and failed methods of each page, and the names of the last two (sorted, comma-joined). A page's methods are few."""
    s = F.col("status")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("method")))), ",")
    n = lambda c: F.count(F.when(c, 1))
    return found.groupBy(*by).agg(n(s == "ok").alias("n_ok"), n(s == "no_candidate").alias("n_empty"), n(s == "error").alias("n_error"), names(s == "error").alias("failed"), names(s == "no_candidate").alias("empty"))


def method_table(found: DataFrame) -> DataFrame:
    """Per method: runs, whole and mean time, mean score of what it found, and a column for each status."""
    ok = F.col("status") == "ok"
    n = lambda x: F.count(F.when(F.col("status") == x, 1)).alias(x)
    return found.groupBy("method").agg(F.count("*").alias("runs"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"), F.avg(F.when(ok, F.col("score"))).alias("mean_score"), n("ok"), n("no_candidate"), n("error"))


def supported_votes(votes: DataFrame, segments: DataFrame, key: str, x: str, y: str, near: float) -> DataFrame:
    """Votes (points) that some segment of their page is near to. segments: key, ax, ay, bx, by.

    Distinct points meet distinct segments by squares of a grid: a segment lies, with all that is near to it, on
    few squares of its own size class (a power of two), and a point on one square of each class that there is.
    """
    from ..functions import scalar as S

    ends, finite = ("ax", "ay", "bx", "by"), lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    s = segments.select(key, *ends).where(" and ".join(f"{c} is not null" for c in ends)).where(finite("ax") & finite("ay") & finite("bx") & finite("by")).distinct()
    pad = near * (1 + 1e-6) + F.greatest(*(F.abs(F.col(c).cast("double")) for c in ends)) * 1e-9  # beyond any rounding of the distance
    wide = F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by")), 2 * F.col("_pad"), F.lit(1e-9))
    s = s.withColumn("_pad", pad).withColumn("_size", F.pow(F.lit(2.0), F.ceil(F.log2(wide))))
    cell = lambda v: F.floor(v / F.col("_size"))
    over = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - F.col("_pad")), cell(F.greatest(a, b) + F.col("_pad"))))
    s = s.withColumn("_cx", over("ax", "bx")).withColumn("_cy", over("ay", "by")).drop("_pad")
    sizes = s.agg(F.collect_set("_size").alias("_sizes"))  # a double has about 2,000 powers of two
    points = votes.select(key, x, y).where(finite(x) & finite(y)).distinct()
    on = points.crossJoin(F.broadcast(sizes)).withColumn("_size", F.explode("_sizes")).drop("_sizes").withColumns({"_cx": cell(F.col(x)), "_cy": cell(F.col(y))}).alias("p")
    s = s.alias("s")
    same = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in (key, "_size", "_cx", "_cy")]
    close = S.segment_distance(F.col(f"p.{x}"), F.col(f"p.{y}"), *(F.col(f"s.{c}") for c in ends)) <= near
    found = on.join(s, [*same, close], "left_semi").select(*(F.col(f"p.{c}").alias(c) for c in (key, x, y))).distinct()
    return votes.join(found, [key, x, y], "left_semi").select(key, *(c for c in votes.columns if c != key))


# work that is claimed
def next_claim(tasks: DataFrame, leases: DataFrame, key: str, by: list[str], order: list[str], estimate: str, now: Column, target: int) -> DataFrame:
    """The next batch of each queue: of the tasks that no live lease holds, in order, until the estimates reach the target. Leases that have run out, or can't be read, hold nothing."""
    from . import evidence as E
    from . import folds as K

    held = leases.where(~E.lease_expired(F.col("expires"), now)).select(key)
    free = tasks.join(held, key, "left_anti")
    return K.claim_batches(free, by, order, estimate, target).where("batch = 0").drop("batch")
