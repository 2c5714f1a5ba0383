"""Judging and joining evidence: wildcard matches, approvals, progress, totals, lanes, boxes, percentiles."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship

# Limits of the stabilisation classes, and the order in which effect domains replace one another.
STABLE = ((0.10, "early"), (0.40, "moderate"), (0.80, "late"))
EFFECTS = ("critical", "important_plus", "moderate_plus", "low_plus", "non_dormant", "exhaustive")


# matches
def wildcard_match(targets: DataFrame, rows: DataFrame, key: str, fields: list[str], tiers: list[tuple[str, str]], pick: list[str], result: list[str]) -> DataFrame:
    """For each target the best row of its first tier with any, of the rows that agree in the fields the target names; a null field of a target agrees with all.

    The best row is gathered once for each subset of the fields, so that the match is an equality join. Targets without a match stay, with tier 0.
    """
    types, out = dict(rows.dtypes), targets
    mask = sum((F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(fields)), F.lit(0))
    out = out.withColumn("_m", mask)
    for k, (a, b) in enumerate(tiers):
        subsets = F.array(*(F.struct(F.lit(m).alias("_m"), *(F.when(F.lit(bool(m >> i & 1)), F.col(f)).cast(types[f]).alias(f"_f{i}") for i, f in enumerate(fields))) for m in range(1 << len(fields))))
        spread = rows.where(F.col(b).isNotNull()).select(F.col(b).alias("_k"), F.explode(subsets).alias("_s"), *dict.fromkeys(pick + result))
        group = ["_k", "_n", *(f"_f{i}" for i in range(len(fields)))]
        best = spread.select("_k", F.col("_s._m").alias("_n"), *(F.col(f"_s._f{i}") for i in range(len(fields))), *dict.fromkeys(pick + result)).groupBy(*group).agg(F.min_by(F.struct(*result), F.struct(*pick)).alias(f"_r{k}"))
        on = (F.col(a) == F.col("_k")) & (F.col("_m") == F.col("_n"))
        for i, f in enumerate(fields):
            on &= F.col(f).eqNullSafe(F.col(f"_f{i}"))
        out = out.join(best, on, "left").drop(*group)
    hit = F.coalesce(*(F.col(f"_r{k}") for k in range(len(tiers))))
    tier = F.coalesce(*(F.when(F.col(f"_r{k}").isNotNull(), k + 1) for k in range(len(tiers))), F.lit(0))
    return out.select(key, tier.cast("long").alias("tier"), *(hit[c].alias(c) for c in result))


def error_percent(predicted: Column, actual: Column) -> Column:
    """How far a verified prediction was off, in per cent to three places; null where either is absent or 0."""
    ok = (predicted != 0) & (actual != 0)
    return F.when(ok, F.round((predicted / actual - 1) * 100, 3))


def resolved(wanted: DataFrame, text: str, known: DataFrame, digest: str, priority: str) -> DataFrame:
    """For each identifier the known record whose digest starts with it, of the first source (priority, then digest).

    Identifiers have 12 hexadecimal digits or more: their first 12 are the join key, the rest is compared.
    """
    w = wanted.withColumn("_t", F.lower(F.trim(text)))
    k = known.withColumnRenamed(digest, "_d").withColumn("_p", F.left("_d", F.lit(12)))
    hit = w.join(k, F.left("_t", F.lit(12)) == F.col("_p")).where(F.startswith("_d", F.col("_t")) & (F.length("_t") >= 12))
    row = F.struct(*(F.col(c).alias(digest if c == "_d" else c) for c in k.columns if c != "_p"))
    return hit.groupBy(text).agg(F.min_by(row, F.struct(priority, "_d")).alias("_r")).select(text, "_r.*")


def schedule_evidence(targets: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """For each target the measured schedule of short runs nearest to it in detectors (log ratio), then the shortest, then the busiest, then the oldest.

    Rows of the target's dataset are asked before others, and among either those of its own runner. targets:
    key, runner, dataset, detectors; rows: workload, runner, dataset, detectors (null: 1), workers, budget, makespan,
    utilization, tail (seconds), seen. Of rows with equal counts only the best can win, so rows are reduced to one
    for each count (and runner, and dataset) before the joins.
    """
    carry = ["workers", "budget", "makespan", "utilization", "tail", "seen"]
    good = rows.where((F.col("workload") == "short") & (F.col("workers") > 0) & (F.col("budget") > 0) & (F.col("makespan") > 0))
    merit = F.struct(F.col("makespan"), -(F.coalesce(F.col("utilization"), F.lit(0.0)) - 0.35 * tail_fraction(F.col("tail"), F.col("makespan"))), F.col("seen"))
    count = F.greatest(F.lit(1), F.coalesce(F.col("detectors"), F.lit(1)))
    out = targets
    for k, on in enumerate((["dataset", "runner"], ["dataset"], ["runner"], [])):
        best = good.groupBy(*on, count.alias("_c")).agg(F.min_by(F.struct(*carry), merit).alias("_x"), F.min(merit).alias("_merit"))
        t = targets.select(key, *on, F.greatest(F.lit(1), F.col("detectors")).alias("_want"))
        j = t.join(best, on) if on else t.crossJoin(F.broadcast(best))  # best: one row for each count of detectors
        far = F.floor(F.abs(F.ln(F.col("_want") / F.col("_c"))) * 1e9)  # whole, so that equal ratios tie
        row = F.struct(F.col("_c").alias("observed"), *(F.col(f"_x.{c}").alias(c) for c in carry))
        out = out.join(j.groupBy(key).agg(F.min_by(row, F.struct(far, F.col("_merit"))).alias(f"_r{k}")), key, "left")
    hit = F.coalesce(*(F.col(f"_r{k}") for k in range(4)))
    tier = F.coalesce(*(F.when(F.col(f"_r{k}").isNotNull(), k + 1) for k in range(4)), F.lit(0))
    return out.select(*targets.columns, tier.alias("tier"), *(hit[c].alias(f"seen_{c}" if c in targets.columns else c) for c in ("observed", *carry)))


def tail_fraction(tail: Column, makespan: Column) -> Column:
    return F.when(makespan > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(tail, F.lit(0.0)) / makespan))).otherwise(0.0)


def scaled_workers(detectors: Column, budget: Column, observed: Column, seen_budget: Column, seen_workers: Column, least_threads: int = 48) -> Column:
    """Workers for a budget by what was measured (after feedback): its threads a worker, scaled by the root of the ratio of detectors, within the detectors and the budget."""
    one = lambda c: F.greatest(F.lit(1), c)
    each = F.greatest(F.lit(float(least_threads)), one(seen_budget) / one(seen_workers))
    by_budget = one(F.bround(one(budget) / each))
    by_count = one(F.bround(by_budget * F.sqrt(one(detectors) / one(observed))))
    return F.least(one(detectors), one(F.floor(one(budget) / least_threads)), by_count).cast("int")


# verdicts
def search_type(status: Column, complete: Column, strategy: Column) -> Column:
    return F.when(F.lower(status) == "provisional", "smoke").when(complete, "exhaustive").otherwise(F.replace(F.coalesce(strategy, F.lit("unknown")), F.lit("_"), F.lit("-")))


def approval(kind: Column, rating: Column) -> Column:
    """Smoke runs and unknown evidence are provisional; only complete searches get beyond candidate, by their rating."""
    k, r = (F.lower(F.trim(F.coalesce(c, F.lit("unknown")))) for c in (kind, rating))
    return F.when(k.isin("smoke", "unknown") | (r == "unknown"), "Provisional").when((k == "exhaustive") & (r == "high"), "Approved").when((k == "exhaustive") & (r == "medium"), "Recommended").otherwise("Candidate")


def stabilisation(fraction: Column) -> Column:
    """When in the search the winner emerged; the first limit is exclusive, the others inclusive."""
    (a, x), (b, y), (c, z) = STABLE
    return F.when(fraction.isNull(), "unavailable").when(fraction < a, x).when(fraction <= b, y).when(fraction <= c, z).otherwise("unstable")


def progress(evaluated: Column, possible: Column, elapsed: Column, rate: Column, pages: Column) -> tuple[Column, Column]:
    """Share evaluated, and seconds left (0 if complete): by the measured page rate, else by the time so far; null where unknown."""
    left = possible - evaluated
    known = evaluated.isNotNull() & (possible > 0)
    slow = F.when((evaluated > 0) & (elapsed > 0), left * elapsed / evaluated)
    eta = F.when(left <= 0, F.lit(0.0)).when((rate > 0) & (pages > 0), left * pages / rate).otherwise(slow)
    return F.when(known, F.least(F.lit(1.0), evaluated / possible)), F.when(known, eta)


def rate_text(rate: Column) -> Column:
    one = lambda d: F.format_string(f"%.{d}f pg/s", rate)
    return F.when(rate.isNull() | F.isnan(rate), "unknown").when(rate >= 10, one(2)).when(rate >= 1, one(3)).otherwise(one(4))


def manual_shape(text: Column) -> Column:
    """struct<pipelines, threads> of 8p/48t, 8/48, 8p,48t, 8px48 and 8p:48; null for other texts and for zeros."""
    t = F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit(""))
    form = r"^(\d+)(?:p/(?=\d+t$)|/(?=\d+$)|p[,x:])(\d+)t?$"
    p, n = (F.regexp_extract(t, form, k).try_cast("int") for k in (1, 2))
    return F.when((p > 0) & (n > 0), F.struct(p.alias("pipelines"), n.alias("threads")))


def page_status(status: Column) -> Column:
    """An aggregate: error if all of a page's candidates are errors, partial if some are, else complete."""
    bad = F.coalesce(status == "error", F.lit(False))
    return F.when(F.bool_and(bad), "error").when(F.bool_or(bad), "partial").otherwise("complete")


def readiness(sizes: Column) -> Column:
    """How well a number of distinct machine sizes supports predictions."""
    return F.when(sizes <= 0, "none").when(sizes == 1, "low").when(sizes == 2, "moderate").otherwise("high")


def lease_expired(expires: Column, now: Column) -> Column:
    """Leases that cannot be read are expired."""
    return F.coalesce(expires.try_cast("double") <= now, F.lit(True))


def effect_strategy(requested: str, sizes: dict[str, int]) -> str:
    """The requested effect domain, or the next wider one with any sets; other strategies stand as they are."""
    if requested not in EFFECTS:
        return requested
    return next((e for e in EFFECTS[EFFECTS.index(requested) :] if e == "exhaustive" or sizes.get(e, 0) > 0), "exhaustive")


# totals
def detector_order(df: DataFrame, tie: str) -> list[Column]:
    """Order of detectors: mean, least IoU, failures, deviation, page rate; what is absent counts as worst."""
    c = F.coalesce
    return [c("mean_iou", F.lit(0.0)).desc(), c("min_iou", F.lit(0.0)).desc(), F.col("n_failed").asc_nulls_last(), F.col("std_iou").asc_nulls_last(), c("page_rate", F.lit(0.0)).desc(), F.col(tie).asc()]


def merged_totals(parts: DataFrame, by: list[str], offset: str, elapsed: str) -> DataFrame:
    """Of a run in parts: its elapsed time (the last end), the serial time, and how much faster it was than that."""
    last, serial = F.max(F.col(offset) + F.col(elapsed)), F.sum(elapsed)
    return parts.groupBy(*by).agg(F.count("*").alias("n_parts"), last.alias("elapsed"), serial.alias("serial"), F.try_divide(serial.cast("double"), last.cast("double")).alias("acceleration"))


def size_anchors(shapes: DataFrame, size: str, pipelines: str, allocated: str) -> DataFrame:
    """For each machine size the median number of pipelines and the median share of its budget in use."""
    share = F.least(F.lit(1.0), F.col(allocated) / F.col(size))
    return shapes.where(F.col(size) > 0).groupBy(size).agg(F.count("*").alias("n"), F.median(pipelines).alias("pipelines"), F.median(share).alias("fraction"))


def weighted_percentile(df: DataFrame, by: list[str], value: str, weight: str, q: float) -> DataFrame:
    """The least value up to which a share q of the weight lies. Equal values are summed before the scan; groups without weight have none."""
    h = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    cum = h.select(*by, value, F.sum("_w").over(Window.partitionBy(*by).orderBy(value)).alias("_c"), F.sum("_w").over(Window.partitionBy(*by)).alias("_t"))
    return cum.where((F.col("_t") > 0) & (F.col("_c") >= F.col("_t") * q)).groupBy(*by).agg(F.min(value).alias("percentile"))


# boxes
def grow_box(boxes: list[list[int]], gap: int) -> tuple[list[int], int]:
    """The largest box (the first of equals) joined with those within gap of what it has become, until none is; and how many joined."""
    rest = sorted(boxes, key=lambda b: -(b[2] - b[0]) * (b[3] - b[1]))
    own, n, more = list(rest.pop(0)), 1, True
    while more:
        apart = lambda b: b[0] - own[2] > gap or own[0] - b[2] > gap or b[1] - own[3] > gap or own[1] - b[3] > gap
        near = [b for b in rest if not apart(b)]
        rest, more = [b for b in rest if apart(b)], bool(near)
        for b in near:
            own, n = [min(own[0], b[0]), min(own[1], b[1]), max(own[2], b[2]), max(own[3], b[3])], n + 1
    return own, n


def grown_boxes(boxes: DataFrame, page: str, order: str, gap: int, corners: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1"), most: int = 50_000) -> DataFrame:
    """Of each page the largest box (of equals the first in `order`), joined with those within gap of what it has become until none is: page, corners, n_joined.

    boxes: a row each, corners as whole numbers of 32 bits; rows with a null corner are none, and a null page is a page. A page of up to
    `most` boxes is one group and done in one round. A larger one is cut into blocks by quantiles of the left edge, then the top one
    (equal corners are dealt out), which all grow the same box as far as they can; the union of what they made is the next round's box, until
    no block changes it. So no task holds more than about `most` boxes, and rounds follow how often the growth goes from block to block.
    Each round is a checkpoint and takes pages that still grow only.
    """
    left, top, right, bottom = corners
    whole = [F.col(c).cast("int").cast("long").alias(c) for c in corners]
    rows = boxes.where(" and ".join(f"{c} is not null" for c in corners)).select(F.col(page).alias("_page"), *whole, F.col(order).alias("_order"))
    area = (F.col(right) - F.col(left)) * (F.col(bottom) - F.col(top))
    pages = rows.groupBy("_page").agg(F.count("*").alias("_n"), F.min_by(F.struct(*corners), F.struct(-area, "_order")).alias("_box"))
    large = pages.where(F.col("_n") > most).select("_page", F.ceil(F.col("_n") / most).cast("int").alias("_blocks"))
    # fine quantiles of the large pages alone, of which a block takes some that follow one another; equal ones stand for places that several share
    steps = max([r[0] or 1 for r in large.agg(F.max("_blocks")).collect()])
    fine, place = max(64, steps), F.col(left) * (1 << 32) + F.col(top)
    share = [k / fine for k in range(1, fine)]
    marks = rows.join(large.withColumnRenamed("_page", "_at"), F.col("_page").eqNullSafe(F.col("_at"))).groupBy("_at", "_blocks").agg(F.percentile_approx(place, share, 10 * fine).alias("_marks"))
    blocked = rows.join(marks, F.col("_page").eqNullSafe(F.col("_at")), "left").drop("_at") if steps > 1 else rows.withColumns({"_marks": F.lit(None).cast("array<bigint>"), "_blocks": F.lit(1)})
    below, upto = F.size(F.filter("_marks", lambda m: m < place)), F.size(F.filter("_marks", lambda m: m <= place))
    dealt = below + F.pmod(F.xxhash64(*corners, "_order"), upto - below + 1)
    block = F.when(F.col("_marks").isNull(), 0).otherwise(F.floor(dealt * F.col("_blocks") / fine)).cast("int")
    blocked = cut(blocked.withColumn("_block", block).select("_page", "_block", *corners))
    held = cut(blocked.select("_page", "_block").distinct())
    kind = dict(rows.dtypes)["_page"]
    schema = f"_page {kind}, _block int, {', '.join(f'{c} long' for c in corners)}, n long"

    def grow(key: tuple, mine: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        if not len(now) or not len(mine):
            return pd.DataFrame({"_page": [], "_block": [], **{c: [] for c in corners}, "n": []})
        b, own = mine[list(corners)].to_numpy(), now[list(corners)].to_numpy()[0]
        n = len(b)
        while len(b):
            near = (b[:, 0] <= own[2] + gap) & (own[0] <= b[:, 2] + gap) & (b[:, 1] <= own[3] + gap) & (own[1] <= b[:, 3] + gap)
            if not near.any():
                break
            own = [*map(min, own[:2], b[near, :2].min(axis=0)), *map(max, own[2:], b[near, 2:].max(axis=0))]
            b = b[~near]
        return pd.DataFrame([(key[0], key[1], *(int(x) for x in own), n - len(b))], columns=["_page", "_block", *corners, "n"])

    ship(boxes.sparkSession)
    now = cut(pages.select("_page", *(F.col(f"_box.{c}").alias(c) for c in corners)))
    done: list[DataFrame] = []
    while not now.isEmpty():
        old = now.select(F.col("_page").alias("_at"), F.struct(*corners).alias("_old"))
        again = held.join(now.withColumnRenamed("_page", "_at"), F.col("_page").eqNullSafe(F.col("_at"))).select("_page", "_block", *corners)
        grown = blocked.groupBy("_page", "_block").cogroup(again.groupBy("_page", "_block")).applyInPandas(grow, schema)
        grown = grown.groupBy("_page").agg(F.min(left).alias(left), F.min(top).alias(top), F.max(right).alias(right), F.max(bottom).alias(bottom), F.sum("n").alias("n_joined"), F.count("*").alias("_k"))
        grown = cut(grown.join(old, F.col("_page").eqNullSafe(F.col("_at"))).drop("_at").withColumn("_still", ((F.col("_k") == 1) | (F.struct(*corners) == F.col("_old")))).drop("_old"))
        done.append(grown.where("_still").select(F.col("_page").alias(page), *corners, "n_joined"))
        now = grown.where("not _still").select("_page", *corners)
    return functools.reduce(DataFrame.unionByName, done) if done else now.select(F.col("_page").alias(page), *corners, F.lit(0).cast("long").alias("n_joined"))
