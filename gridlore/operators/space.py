"""Declared parameter spaces: counts, digests, membership, provenance, audits, and shapes to try.

Specifications are long tables: detector, name, pos (place of the name), value (JSON text), ord (place of the
value), zombie (kept for revalidation, fixed in ordinary searches). All are small but the evaluated sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import observations as B
from . import selection as X


def _product(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(1).cast("long"), lambda a, x: a * x)


def contracts(spec: DataFrame, strategy: Column) -> DataFrame:
    """Per detector: live sets, sets with zombies, those that the strategy searches (null for searches without a fixed size), zombies' names."""
    n = spec.groupBy("detector", "name", "zombie").agg(F.count_distinct("value").alias("n"))
    g = n.groupBy("detector").agg(F.collect_list(F.when(~F.col("zombie"), F.col("n"))).alias("_live"), F.collect_list("n").alias("_all"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("zombie"), F.col("name")))), ",").alias("zombies"))
    g = g.select("detector", _product(F.col("_live")).alias("live"), _product(F.col("_all")).alias("with_zombies"), "zombies").withColumn("strategy", strategy)
    return g.withColumn("effective", F.when(F.col("strategy") == "exhaustive-with-zombies", F.col("with_zombies")).when(F.col("strategy").isin("exhaustive", "cartesian"), F.col("live")))


def family_sizes(spec: DataFrame, enrolled: list[str]) -> DataFrame:
    """How many sets one family stands for: the product of the enrolled parameters' values, 1 at least."""
    n = spec.groupBy("detector", "name").agg(F.count_distinct("value").alias("n"))
    return n.groupBy("detector").agg(_product(F.collect_list(F.when(F.col("name").isin(*enrolled), F.col("n")))).alias("family_size"))


def grid_digests(spec: DataFrame) -> DataFrame:
    """Per detector: digest of the order of its live parameters and their values as canonical JSON, and the number of sets."""
    one = spec.where("not zombie").groupBy("detector", "name").agg(F.min("pos").alias("pos"), F.transform(F.array_sort(F.collect_set(F.struct("ord", "value"))), lambda x: x.value).alias("values"))
    quoted = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    row = F.struct("pos", quoted.alias("q"), F.concat(quoted, F.lit(":["), F.array_join("values", ","), F.lit("]")).alias("v"), F.size("values").cast("long").alias("n"))
    g = one.groupBy("detector").agg(F.array_sort(F.collect_list(row)).alias("r"))
    text = F.concat(F.lit('{"order":['), F.array_join(F.transform("r", lambda x: x.q), ","), F.lit('],"values":{'), F.array_join(F.array_sort(F.transform("r", lambda x: x.v)), ","), F.lit("}}"))
    return g.select("detector", F.sha2(text, 256).alias("digest"), _product(F.transform("r", lambda x: x.n)).alias("n_sets"))


def same_keys(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))


#: Sets that a task takes: what they are members of is told apart there.
SETS_A_TASK = 100_000


def memberships(sets: DataFrame, explicit: DataFrame, grids: DataFrame) -> DataFrame:
    """(set, build) pairs: builds that name the set's digest, or whose grid holds each of its values and no other parameter.

    sets: id, digest, parameters (map of JSON text); explicit: build, digest; grids: build, name, value. All joins are on equal keys:
    a grid meets the sets that have its names and one of its values of the first of them, and the other values are looked up in the row.
    """
    spread = sets.select("id", "digest", "parameters").repartition(max(1, -(-sets.count() // SETS_A_TASK)), "id")
    named = spread.join(explicit.select("build", "digest").distinct(), "digest").select("id", "build")
    one = grids.where("build is not null and name is not null").groupBy("build", "name").agg(F.collect_set("value").alias("_values"))
    one = one.groupBy("build").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "_values")))).alias("_grid"))
    one = one.withColumn("_names", F.array_sort(F.map_keys("_grid"))).select("build", "_grid", "_names", F.explode(F.col("_grid")[F.col("_names")[0]]).alias("_first"))
    names = F.array_sort(F.map_keys("parameters"))
    keyed = spread.where(F.size("parameters") > 0).select("id", "parameters", names.alias("_names"), F.col("parameters")[names[0]].alias("_first"))
    held = lambda k, v: F.array_contains(F.col("_grid")[k], v)
    inside = keyed.join(F.broadcast(one), ["_names", "_first"]).where(F.forall(F.map_entries("parameters"), lambda e: F.coalesce(held(e["key"], e["value"]), F.lit(False)))).select("id", "build")
    return named.unionByName(inside).distinct()


def build_order(build: str, date: str) -> list[Column]:
    """Newest first by the build's number; builds that are no numbers come last."""
    return [F.coalesce(F.trim(F.col(build)).try_cast("int"), F.lit(-1)).desc(), F.col(date).desc()]


def known_builds(members: DataFrame, by: list[str], build: str, date: str, current: Column) -> DataFrame:
    """Each group's builds once, the current one first, then newest first, with their place. Of a build's rows the newest counts."""
    one = members.groupBy(*by, build).agg(F.max(date).alias(date), F.max(current.cast("int")).alias("_now"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_now").desc(), *build_order(build, date))).cast("long")).drop("_now")


def provenance_index(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Digest to build, from the stored files of entries that are not provisional. files: record, digests (array)."""
    e = entries.where(F.lower(F.coalesce("status", F.lit(""))) != "provisional").select("detector", "record", "build")
    return e.join(files, "record").select("detector", "build", F.explode("digests").alias("digest")).distinct()


def coverage(results: DataFrame) -> DataFrame:
    """Per detector: evaluated sets, those on the grid, and distinct ones beside it. results: detector, digest, ordinal (null beside the grid)."""
    return results.groupBy("detector").agg(F.count("*").alias("evaluated"), F.count("ordinal").alias("on_grid"), F.count_distinct(F.when(F.col("ordinal").isNull(), F.col("digest"))).alias("beside"))


def audit(config: DataFrame) -> DataFrame:
    """Per detector: live, zombie and single-valued parameters, and what is wrong with its zombies (sorted names of rules by parameter).

    config: detector, name, live, zombie, n_values, pinned (null: none), pinned_known, reason, scope, in_baseline.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = [("values", F.coalesce("n_values", F.lit(0)) == 0)]
    rest = [("pinned_value", F.col("pinned").isNull()), ("pinned_outside", F.col("pinned").isNotNull() & ~F.col("pinned_known")), ("reason", blank("reason")), ("audit_scope", blank("scope")), ("baseline", ~F.col("in_baseline"))]
    said = lambda rs: F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(True)), F.concat("name", F.lit(": "), F.lit(n))) for n, hit in rs)))
    wrong = F.when(~F.col("zombie"), F.array().cast("array<string>")).when(F.col("live"), F.array(F.concat("name", F.lit(": also live")))).when(rules[0][1], said(rules)).otherwise(said(rest))
    n = lambda c: F.count(F.when(c, 1))
    g = config.withColumn("_wrong", wrong).groupBy("detector").agg(n(F.col("live")).alias("n_live"), n(F.col("zombie")).alias("n_zombies"), n(F.col("live") & (F.col("n_values") == 1)).alias("n_single"), F.array_sort(F.flatten(F.collect_list("_wrong"))).alias("errors"))
    return g.select("detector", "n_live", "n_zombies", "n_single", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", "; ").alias("errors"))


# shapes to try
def legal_pipelines(low: Column, high: Column, budget: Column, least_threads: Column, beyond: Column | None = None) -> Column:
    """All pipeline counts that leave each its least threads; beyond: where true, the budget is no limit."""
    held = F.least(high, F.floor(budget / least_threads).cast("int"))
    top = held if beyond is None else F.when(beyond, high).otherwise(held)
    return F.when(low <= top, F.sequence(low, top)).otherwise(F.array().cast("array<int>"))


def doubling(legal: Column) -> Column:
    """The first and last of them, and the powers of two between."""
    lo, hi = F.array_min(legal), F.array_max(legal)
    powers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2.0), k).cast("int")), lambda x: x.between(lo, hi))
    return F.when(F.size(legal) > 0, F.array_sort(F.array_distinct(F.concat(F.array(lo, hi), powers)))).otherwise(legal)


def divisors(legal: Column, budget: Column) -> Column:
    return F.filter(legal, lambda x: budget % x == 0)


# resolving shapes
def workflow_shape(df: DataFrame) -> DataFrame:
    """How a request gets its shape: one resolved before, automatic, given by hand, or for preferred ones that of several detectors, measured, predicted, else automatic again.

    df: mode, regression, strategy, limit, several (detectors at once), budget, and structs given, manual, multi,
    measured, predicted of (pipelines, threads). A shape beyond the budget has an error as its source.
    """
    from .planning import workload_class

    plain = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    mode = F.coalesce(F.nullif(F.lower(plain("mode")), F.lit("")), F.lit("auto"))
    short = workload_class(F.col("regression"), F.col("strategy"), F.col("limit")) == "short"
    full = (F.col("regression") == "full") & (F.col("strategy") == "exhaustive") & (plain("limit") == "")
    there = lambda c: F.col(c).isNotNull() & F.coalesce(F.col(f"{c}.pipelines") > 0, F.lit(False))
    none = F.lit(None).cast("struct<pipelines:int,threads:int>")
    pick = lambda c: F.struct(F.col(f"{c}.pipelines").cast("int").alias("pipelines"), F.col(f"{c}.threads").cast("int").alias("threads"))
    steps = [
        (there("given"), pick("given"), "preferred-dispatch"), (mode == "auto", none, "auto"), ((mode == "manual") & there("manual"), pick("manual"), "manual"), (mode == "manual", none, "error-no-manual-shape"),
        (mode != "preferred", none, "error-unknown-mode"), (F.col("several") & short & there("multi"), pick("multi"), "preferred-multidetector"), (F.col("several") & short, none, "auto-fallback-no-multidetector-history"),
        (~F.coalesce(full, F.lit(False)), none, "auto-fallback-incompatible-workload"), (F.col("several"), none, "auto-fallback-all-full-exhaustive"), (there("measured"), pick("measured"), "preferred-measured"),
        (there("predicted"), pick("predicted"), "predicted"),
    ]
    shape, source = none, F.lit("auto-fallback-no-shape-history")
    for hit, value, name in reversed(steps):
        shape, source = F.when(hit, value).otherwise(shape), F.when(hit, name).otherwise(source)
    d = df.withColumns({"_s": shape, "_source": source})
    over = F.col("_s.pipelines") * F.col("_s.threads") > F.col("budget")
    return d.select(*df.columns, (F.col("_s").isNotNull() & ~over).alias("exact"), F.col("_s.pipelines").alias("pipelines"), F.col("_s.threads").alias("threads"), F.when(over, "error-beyond-budget").otherwise(F.col("_source")).alias("source"))


def dispatch(targets: DataFrame, obs: DataFrame, key: str, budgets: Column) -> DataFrame:
    """For each target the preferred measured shape and the runner that had it (one of its own before a hosted one); the requested runner where nothing suits.

    targets: key, detector, dataset, config, dimension, preferred (asked for), requested (runner). obs: as for workload_rows, with hosted. budgets: of a runner by policy.
    """
    rows = B.workload_rows(targets.where("preferred"), obs, key, F.lit(False))
    rows = rows.withColumns({"rate": F.try_divide("actual", "wall"), "allocated": F.col("pipelines") * F.col("threads"), "sequence": F.col("id")})
    best = X.preferred(rows.select(key, "pipelines", "threads", "allocated", "rate", "wall", "sequence"), [key], F.bround("rate", 2), ["allocated", "pipelines", "threads", "wall", "sequence"])
    b = best.select(key, F.col("pipelines").alias("_p"), F.col("threads").alias("_t"), F.col("rate").alias("_rate"), F.col("allocated").alias("_a"))
    same = rows.join(b, key).where((F.col("pipelines") == F.col("_p")) & (F.col("threads") == F.col("_t")) & (F.col("rate") == F.col("_rate")))
    who = same.withColumn("_budget", F.greatest(budgets, F.col("_a"))).groupBy(key).agg(F.min_by(F.struct("runner", "_p", "_t", "_a", "_budget"), F.struct(F.col("hosted"), F.col("id"))).alias("_r"))
    j = targets.join(who, key, "left")
    source = F.when(F.col("_r").isNotNull(), "preferred-dispatch").when(F.col("preferred"), "requested-runner-no-preferred-history").otherwise("requested-runner")
    return j.select(key, F.coalesce("_r.runner", "requested").alias("runner"), F.col("_r").isNotNull().alias("exact"), F.col("_r._p").alias("pipelines"), F.col("_r._t").alias("threads"), F.col("_r._a").alias("allocated"), F.col("_r._budget").alias("budget"), source.alias("source"))


def predicted_shape(targets: DataFrame, evidence: DataFrame, by: list[str], cpus: str, correction: Column | None = None) -> DataFrame:
    """Pipelines and threads for machine sizes that nothing need have been measured on, with how (relation) and how surely (confidence).

    evidence: by, cpus, pipelines, fraction (share of the budget of two threads a processor); its medians by size
    are the anchors, a few for each group. targets: by, cpus. Groups without evidence give nothing.
    """
    a = evidence.where(F.col(cpus) > 0).groupBy(*by, cpus).agg(F.median("pipelines").cast("double").alias("y"), F.median("fraction").cast("double").alias("f"))
    a = a.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(cpus).cast("double").alias("x"), "y", "f"))).alias("_a"))
    t = F.greatest(F.lit(1.0), F.col(cpus).cast("double"))
    d = targets.select(*by, cpus).distinct().join(a, by).withColumns({"_n": F.size("_a"), "_lo": F.get(F.filter("_a", lambda z: z.x <= t), F.size(F.filter("_a", lambda z: z.x <= t)) - 1), "_hi": F.get(F.filter("_a", lambda z: z.x >= t), F.lit(0))})
    lo, hi, last = F.col("_lo"), F.col("_hi"), F.col("_a")[F.col("_n") - 1]
    relation = F.when(F.col("_n") == 1, "single-anchor").when(lo.isNull(), "extrapolated-below").when(hi.isNull(), "extrapolated-above").when(lo["x"] < hi["x"], "interpolated").otherwise("same-size")
    p = F.when(lo.isNull(), F.col("_a")[0]).when(hi.isNull(), F.get("_a", F.col("_n") - 2)).otherwise(lo)
    q = F.when(lo.isNull(), F.get("_a", F.lit(1))).when(hi.isNull(), last).otherwise(hi)
    d = d.withColumns({"relation": relation, "_p": p, "_q": q})
    p, q = F.col("_p"), F.col("_q")
    y = F.when(F.col("_n") == 1, F.col("_a")[0]["y"] * t / F.col("_a")[0]["x"]).when(F.col("relation") == "same-size", lo["y"]).otherwise(X.power_interpolated(t, p["x"], p["y"], q["x"], q["y"]))
    f = F.when(F.col("relation") == "interpolated", p["f"] + (t - p["x"]) / (q["x"] - p["x"]) * (q["f"] - p["f"])).when(lo.isNull(), F.col("_a")[0]["f"]).when(hi.isNull(), last["f"]).otherwise(lo["f"])
    whole = lambda x: F.greatest(F.lit(1), F.bround(x).cast("int"))
    d = d.withColumns({"_want": whole(y * (F.lit(1.0) if correction is None else correction)), "_budget": F.greatest(F.lit(1), F.col(cpus) * 2).cast("int")})
    d = d.withColumn("_alloc", F.least(F.col("_budget"), whole(F.col("_budget") * F.least(F.lit(1.0), F.greatest(F.lit(0.05), f)))))
    each = whole(F.col("_alloc") / F.col("_want"))
    d = d.withColumn("threads", F.when(F.col("_want") * each > F.col("_budget"), F.greatest(F.lit(1), F.floor(F.col("_budget") / F.col("_want")).cast("int"))).otherwise(each))
    inside = (F.col("_a")[0]["x"] <= t) & (t <= last["x"])
    sure = F.when((F.col("_n") >= 3) & inside, "high").when(F.col("_n") >= 2, "moderate").otherwise("low")
    return d.select(*by, cpus, F.least("_want", "_budget").alias("pipelines"), "threads", "relation", sure.alias("confidence"))


def runner_labels(labels: Column, label: Column, known: dict[str, list[str]], hosted: list[str]) -> Column:
    """A runner's labels: its own without blanks, else those of its known label, else the label among one's own machines, else the hosted ones."""
    own = F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != "")
    name = F.trim(F.coalesce(label, F.lit("")))
    out = F.when((name != "") & ~name.isin("unknown", "github-hosted"), F.array(F.lit("self-hosted"), name)).otherwise(F.array(*map(F.lit, hosted)))
    for k, v in known.items():
        out = F.when(name == k, F.array(*map(F.lit, v))).otherwise(out)
    return F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).otherwise(out)


def environment_text(fields: dict[str, Column]) -> Column:
    """name=value lines: lists as JSON, truth as 1 or 0 by the caller's casts, null as nothing."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()))


def characterised(detectors: DataFrame, known: DataFrame) -> DataFrame:
    """Detectors with their names and role; those without an entry are named after their id, of unknown role. known: detector, friendly, short, role (small)."""
    j = detectors.join(F.broadcast(known), "detector", "left")
    return j.select("detector", F.coalesce("friendly", F.initcap(F.replace(F.col("detector"), F.lit("_"), F.lit(" ")))).alias("friendly"), F.coalesce("short", "detector").alias("short"), F.coalesce("role", F.lit("Unknown")).alias("role"))


def model_variant(detector: Column, requested: Column, defaults: dict[str, str], owners: dict[str, str]) -> Column:
    """The requested variant, which must be the detector's (owners: variant to detector), or an error; default, none and blank stand for the detector's own, null where it has none."""
    want = F.coalesce(F.nullif(F.lower(F.trim(requested)), F.lit("")), F.lit("default"))
    own = F.lower(F.trim(F.coalesce(detector, F.lit(""))))
    default, owner = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, v in defaults.items():
        default = F.when(own == k, v).otherwise(default)
    for k, v in owners.items():
        owner = F.when(want == k, v).otherwise(owner)
    wrong = F.raise_error(F.concat(F.lit("unknown variant of "), own, F.lit(": "), want)).cast("string")
    return F.when(want.isin("default", "n/a", "na", "none"), default).when(owner == own, want).otherwise(wrong)
