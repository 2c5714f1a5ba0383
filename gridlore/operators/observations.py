"""Observations of runs and entries of record indexes: which ones compare or match, what they derive, which are chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered as O

# Strategies that give the same sets each time, and those of them that must be complete.
COMPLETE = ("exhaustive", "exhaustive-with-zombies")
DETERMINISTIC = (*COMPLETE, "non-dormant", "low+", "moderate+", "important+", "critical")
OPTIMIZER = "execution-optimizer"


# which observations compare
def comparable_runs(obs: DataFrame) -> DataFrame:
    """Full exhaustive runs that took time and evaluated as many sets as there are (or know neither number)."""
    return obs.where((F.col("mode") == "full") & (F.col("strategy") == "exhaustive") & F.col("actual").eqNullSafe(F.col("possible")) & (F.coalesce("wall", F.lit(0.0)) > 0))


def comparable_shapes(obs: DataFrame) -> DataFrame:
    """Full optimizer runs of a deterministic strategy with sets and time; only exhaustive ones need all their sets."""
    complete = ~F.col("strategy").isin(*COMPLETE) | F.coalesce(F.col("actual") == F.col("possible"), F.lit(False))
    return obs.where((F.col("source") == OPTIMIZER) & (F.col("mode") == "full") & F.col("strategy").isin(*DETERMINISTIC) & (F.col("actual") > 0) & complete & (F.coalesce("wall", F.lit(0.0)) > 0))


def measured(obs: DataFrame) -> DataFrame:
    """Complete, full, exhaustive optimizer rows."""
    return obs.where((F.col("source") == OPTIMIZER) & (F.col("mode") == "full") & (F.col("strategy") == "exhaustive") & (F.col("actual") == F.col("possible")) & (F.col("wall") > 0))


def workload_rows(targets: DataFrame, obs: DataFrame, key: str, relaxed: Column) -> DataFrame:
    """Measured rows of each target's detector and dataset. A row's empty configuration or null dimension agrees with any.

    Rows of another configuration come in only for relaxed targets that no row suits otherwise (tier 2).
    targets: key, detector, dataset, config, dimension.
    """
    t = targets.select(key, "detector", "dataset", F.col("config").alias("_config"), F.col("dimension").alias("_dimension"), relaxed.alias("_relaxed"))
    same = (F.coalesce(F.trim("config"), F.lit("")) == "") | (F.trim("config") == F.col("_config"))
    fits = F.coalesce(F.col("dimension") == F.col("_dimension"), F.lit(True))
    rows = t.join(measured(obs), ["detector", "dataset"]).where(fits & (same | F.col("_relaxed"))).withColumn("tier", F.when(same, 1).otherwise(2))
    first = rows.groupBy(key).agg(F.min("tier").alias("tier"))
    return rows.join(first, [key, "tier"]).drop("_config", "_dimension", "_relaxed")


def matches_all(wanted: dict[str, Column], absent: dict[str, object] | None = None) -> Column:
    """Every column equals what is wanted, null to null; absent: what a null stands for."""
    out = F.lit(True)
    for name, value in wanted.items():
        have = F.col(name) if name not in (absent or {}) else F.coalesce(F.col(name), F.lit(absent[name]))
        out = out & have.eqNullSafe(value)
    return out


def variant_compatible(recorded: Column, requested: Column) -> Column:
    """No request takes all; else the same variant, or none recorded where the current one is asked for."""
    have, want = (F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in (recorded, requested))
    return F.when(want.isNull() | have.eqNullSafe(want), True).otherwise(have.isNull() & F.coalesce(want.endswith("_current"), F.lit(False)))


def matching_entries(entries: DataFrame, stored: DataFrame, dataset: str | None = None) -> DataFrame:
    """Entries with a detector and a record that is stored (stored: record), for a dataset if one is given."""
    e = entries.where((F.trim(F.coalesce("detector", F.lit(""))) != "") & (F.trim(F.coalesce("record", F.lit(""))) != ""))
    if dataset is not None:
        e = e.where(F.col("dataset") == dataset)
    return e.join(stored.select("record"), "record", "left_semi")


def finished(runs: DataFrame, reason: str = "stop_reason") -> DataFrame:
    return runs.where(F.trim(F.coalesce(reason, F.lit(""))) != "")


def shapes_left(wanted: DataFrame, obs: DataFrame, by: list[str]) -> DataFrame:
    """Shapes that are not measured yet."""
    return wanted.join(obs.select(*by), by, "left_anti")


def resumed(obs: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of a run under another run's id, which is also put into their own ids."""
    own = F.when(F.col("id").contains(old), F.concat(F.substring_index("id", old, 1), F.lit(new), F.substring("id", F.instr("id", old) + len(old), F.length("id"))))
    return obs.where(F.col("run") == old).withColumns({"id": F.coalesce(own, F.col("id")), "resumed_from": F.col("run"), "run": F.lit(new)})


# what they derive
def derived(obs: DataFrame) -> DataFrame:
    """Allocation, acceleration (the given one where there is no serial estimate), efficiency, rates; null where unknown. obs: wall, serial, acceleration, shards, pipelines, threads, actual, pages, evaluations."""
    at_least = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(1)))
    wall = F.when(F.col("wall") > 0, F.col("wall"))
    d = obs.withColumns({"shards": at_least("shards"), "threads": at_least("threads")}).withColumn("active", F.least(at_least("pipelines"), F.col("shards")))
    d = d.withColumn("allocated", F.col("active") * F.col("threads")).withColumn("acceleration", F.coalesce("acceleration", F.when(F.col("serial") != 0, F.try_divide("serial", wall))))
    evaluations = F.coalesce(F.col("evaluations"), F.col("actual") * F.col("pages"))
    return d.withColumns({
        "shape": F.format_string("%dp/%ds/%dt", "active", "shards", "threads"), "efficiency": F.try_divide("acceleration", "allocated"), "thread_seconds": F.col("wall") * F.col("allocated"),
        "sets_per_second": F.try_divide("actual", wall), "evaluations": evaluations, "evaluations_per_second": F.try_divide(evaluations, wall),
    })


def shape_order(rate: str = "rate", allocated: str = "allocated", pipelines: str = "pipelines", threads: str = "threads", wall: str = "wall", sequence: str = "sequence") -> list[Column]:
    """Preference among shapes: the rate as shown (two decimals), then the smaller one, the faster one, the earlier one; absent numbers last."""
    return [F.bround(rate, 2).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in (allocated, pipelines, threads, wall, sequence))]


def shape_key() -> Column:
    """The same preference as one value whose least is preferred, for aggregates."""
    low = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("inf")))
    return F.struct(F.coalesce(-F.bround("rate", 2), F.lit(float("inf"))), *map(low, ("allocated", "pipelines", "threads", "wall", "sequence")))


def shape_index(obs: DataFrame, by: list[str]) -> DataFrame:
    """A row for each shape of a group: observations, fastest and median time, speed against one pipeline, and whether it is the preferred one.

    obs: id, pipelines, threads, wall, actual, sequence. One aggregation to shapes; the rest goes over these few.
    """
    fast = F.min_by(F.struct("wall", "actual", "sequence"), F.struct("wall", "id")).alias("_f")
    s = obs.groupBy(*by, "pipelines", "threads").agg(F.count("*").alias("n"), F.median("wall").alias("median"), fast)
    s = s.select(*by, "pipelines", "threads", "n", F.col("_f.wall").alias("wall"), "median", F.try_divide("_f.actual", "_f.wall").alias("rate"), (F.col("pipelines") * F.col("threads")).alias("allocated"), F.col("_f.sequence").alias("sequence"))
    w = Window.partitionBy(*by)
    one = F.min(F.when(F.col("pipelines") == 1, F.col("wall"))).over(w)
    return s.withColumns({"speedup": F.when(one > 0, one / F.col("wall")), "preferred": F.row_number().over(w.orderBy(*shape_order())) == 1})


def preferred_shape(shapes: DataFrame, by: list[str]) -> DataFrame:
    return shapes.groupBy(*by).agg(F.min_by(F.struct(*[c for c in shapes.columns if c not in by]), shape_key()).alias("_r")).select(*by, "_r.*")


def restricted(shapes: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """One row: groups, observations, and the preferred shape of the groups named by keys; without keys, of all."""
    s = shapes if keys.isEmpty() else shapes.join(keys, by, "left_semi")
    best = F.min_by(F.struct("pipelines", "threads", "rate"), shape_key())
    return s.agg(F.count_distinct(*by).alias("groups"), F.coalesce(F.sum(F.coalesce("n", F.lit(1))), F.lit(0)).alias("observations"), best.alias("best")).select("groups", "observations", "best.pipelines", "best.threads", "best.rate")


def runner_evidence(obs: DataFrame, by: list[str], cpus: str = "cpus") -> DataFrame:
    """One preferred shape for each runner, and the share of its budget (two threads a processor) that it takes."""
    rate = F.try_divide("actual", F.when(F.col("wall") > 0, F.col("wall")))
    best = preferred_shape(obs.withColumns({"rate": rate, "allocated": F.col("pipelines") * F.col("threads")}).select(*by, "pipelines", "threads", "allocated", "rate", "wall", "sequence"), by)
    return best.withColumn("fraction", F.least(F.lit(1.0), F.col("allocated") / F.greatest(F.lit(1), 2 * F.col(cpus))))


def executor_rows(index: DataFrame) -> DataFrame:
    """Preferred shapes out of nested indexes: detector, runners array<struct<key, title, best struct<pipelines, threads>>>; runners without one go."""
    r = index.select("detector", F.explode("runners").alias("r")).where("r is not null and r.best is not null")
    return r.select("detector", "r.key", "r.title", "r.best.pipelines", "r.best.threads")


def method_text(methods: Column) -> Column:
    """Search methods of a comma text under their present names; unknown for none."""
    parts = F.filter(F.transform(F.split(F.coalesce(methods, F.lit("unknown")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(F.transform(parts, lambda x: F.when(x == "binary", "powers-of-2").otherwise(x)), ", "), F.lit("")), F.lit("unknown"))


def shape_methods(shapes: DataFrame, runs: DataFrame) -> DataFrame:
    """Shapes with their run's method (legacy without a known run) and the seconds of its search: those recorded, else the sum of the run's fastest times."""
    own = shapes.groupBy("run").agg(F.sum("wall").alias("_sum"))
    j = shapes.join(own, "run", "left").join(runs.select("run", "method", "search_seconds", F.lit(True).alias("_known")), "run", "left")
    return j.withColumns({"method": F.when(F.col("_known"), method_text(F.col("method"))).otherwise("legacy"), "search_seconds": F.coalesce("search_seconds", "_sum")}).drop("_sum", "_known")


def represented_methods(shapes: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: the methods of the runs that gave shapes, sorted; legacy if none is known."""
    m = runs.where(F.coalesce("method", F.lit("")) != "").join(shapes.select("run"), "run", "left_semi").agg(F.collect_set(method_text(F.col("method"))).alias("m"))
    return m.select(F.when(F.size("m") > 0, F.array_join(F.array_sort("m"), ", ")).otherwise("legacy").alias("methods"))


# which are chosen
def newest_of(rows: DataFrame, by: list[str], time: list[str]) -> DataFrame:
    """The newest row of each group, by the first of the times that is there, then by the other fields as given."""
    return O.one_of(rows, by, F.struct(*time))


def newest_run(obs: DataFrame, by: list[str], run: str, seen: str) -> DataFrame:
    """The run whose last row is newest; of equal ones the greatest id. Blank ids don't count."""
    last = obs.where(F.trim(F.coalesce(run, F.lit(""))) != "").groupBy(*by, run).agg(F.max(seen).alias("_last"))
    return last.groupBy(*by).agg(F.max(F.struct("_last", run)).alias("_r")).select(*by, F.col(f"_r.{run}").alias(run), F.col("_r._last").alias("last"))


def any_evidence(sources: list[DataFrame], key: str) -> DataFrame:
    out = sources[0].select(key)
    for s in sources[1:]:
        out = out.union(s.select(key))
    return out.distinct()


def with_prediction(index: DataFrame, new: DataFrame, key: str, order: list[str], keep: int) -> DataFrame:
    """Rows with new ids after those there, the last `keep` of all."""
    fresh = new.join(index.select(key), key, "left_anti").withColumn("_b", F.lit(1))
    return O.newest(index.withColumn("_b", F.lit(0)).unionByName(fresh), [], [F.col("_b").desc(), *(F.col(c).desc() for c in order)], keep).drop("_b")


def queue(tasks: DataFrame, key: str, estimate: str, rank: str, strategy: str) -> DataFrame:
    """Tasks with their place: longest first (lpt; unknown ones count as the longest known), by rank (ranked), or as named (fifo)."""
    if strategy == "lpt":
        most = tasks.agg(F.max(estimate).alias("_most"))
        tasks = tasks.crossJoin(F.broadcast(most)).withColumn("_e", F.coalesce(F.col(estimate), F.col("_most"), F.lit(0))).drop("_most")  # one row
        order = [F.col("_e").desc(), F.col(key).desc()]
    elif strategy == "ranked":
        order = [F.col(rank).asc_nulls_last(), F.col(key).asc()]
    else:
        order = [F.col(key).asc()]
    return tasks.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("_e")  # detectors are few
