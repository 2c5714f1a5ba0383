"""Queries of the observation operators on the shared views, and the SQL that each equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observations as B
from . import views as V
from .registry import query

RUNS, ENTRIES = V.cte("r", V.RUNS), V.cte("e", V.ENTRIES)
OPTIMAL = "source = 'execution-optimizer' AND mode = 'full'"


def _runs(spark, d):
    return V.shared(spark, d, V.RUNS)


def _entries(spark, d):
    return V.shared(spark, d, V.ENTRIES)


# which observations compare
@query(f"WITH {RUNS} SELECT id, detector, wall FROM r WHERE mode = 'full' AND strategy = 'exhaustive' AND actual IS NOT DISTINCT FROM possible AND wall > 0")
def q_comparable_runs(spark, d):
    return B.comparable_runs(_runs(spark, d)).select("id", "detector", "wall")


COMPARABLE = f"{OPTIMAL} AND strategy IN ('exhaustive', 'exhaustive-with-zombies', 'non-dormant', 'low+', 'moderate+', 'important+', 'critical') AND actual > 0 AND (strategy = 'critical' OR actual = possible) AND wall > 0"


@query(f"WITH {RUNS} SELECT id, strategy, actual FROM r WHERE {COMPARABLE}")
def q_comparable_shapes(spark, d):
    return B.comparable_shapes(_runs(spark, d)).select("id", "strategy", "actual")


MEASURED = f"{OPTIMAL} AND strategy = 'exhaustive' AND actual = possible AND wall > 0"
TARGETS = "SELECT n_nationkey AS target, CASE n_nationkey % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' ELSE 'error' END AS detector, 'g' || CAST(n_nationkey % 5 AS STRING) AS dataset, 'c' || CAST(n_nationkey % 3 AS STRING) AS config, CASE WHEN n_nationkey % 6 = 5 THEN 900 ELSE 1800 END AS dimension FROM {nation}"
WORKLOAD = f"""WITH {RUNS}, {V.cte("t", TARGETS)}, j AS (SELECT target, id, CASE WHEN r.config = '' OR r.config = t.config THEN 1 ELSE 2 END AS tier FROM t JOIN r USING (detector, dataset)
  WHERE {MEASURED} AND (r.dimension IS NULL OR r.dimension = t.dimension))"""


@query(WORKLOAD + " SELECT target, id FROM j WHERE tier = 1")
def q_workload_match(spark, d):
    return B.workload_rows(V.shared(spark, d, TARGETS), _runs(spark, d), "target", F.lit(False)).select("target", "id")


@query(f"{WORKLOAD}, k AS (SELECT * FROM j WHERE tier = 1 OR target % 2 = 0) SELECT target, id, tier FROM k JOIN (SELECT target, min(tier) AS tier FROM k GROUP BY 1) USING (target, tier)")
def q_second_chance(spark, d):
    # configurations other than those on record, so that only the second chance finds them
    return B.workload_rows(V.shared(spark, d, TARGETS), _runs(spark, d), "target", F.col("target") % 2 == 0).select("target", "id", "tier")


@query(f"WITH {RUNS} SELECT id FROM r WHERE detector = 'click' AND runner = 'r3' AND pipelines = 4 AND threads = 2 AND strategy = 'exhaustive' AND coalesce(dimension, 900) = 1800 AND mode = 'full'")
def q_resume_match(spark, d):
    wanted = {"detector": "click", "runner": "r3", "pipelines": 4, "threads": 2, "strategy": "exhaustive", "dimension": 1800, "mode": "full"}
    return _runs(spark, d).where(B.matches_all({k: F.lit(v) for k, v in wanted.items()}, {"dimension": 900})).select("id")


@query("SELECT c_custkey, c_nationkey = s_nationkey AND c_custkey % 7 = s_suppkey % 7 AS same FROM customer JOIN supplier ON s_suppkey = c_custkey % 50")
def q_identity_match(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", F.struct("c_nationkey", (F.col("c_custkey") % 7).alias("k")).alias("a"))
    s = V.table(spark, d, "supplier").select("s_suppkey", F.struct("s_nationkey", (F.col("s_suppkey") % 7).alias("k")).alias("b"))
    return c.join(s, F.col("s_suppkey") == F.col("c_custkey") % 50).select("c_custkey", F.col("a").eqNullSafe(F.struct(F.col("b.s_nationkey").alias("c_nationkey"), "b.k")).alias("same"))


@query(f"WITH {ENTRIES} SELECT w, CAST(count(*) AS BIGINT) AS n FROM e, (VALUES (NULL), ('x_current'), ('x_old'), ('y')) v(w) WHERE w IS NULL OR nullif(trim(variant), '') = w OR (nullif(trim(variant), '') IS NULL AND w = 'x_current') GROUP BY w")
def q_variant_match(spark, d):
    wanted = spark.createDataFrame([(None,), ("x_current",), ("x_old",), ("y",)], "w string")
    e = _entries(spark, d).groupBy("variant").agg(F.count("*").alias("n"))  # a row for each variant
    return e.crossJoin(F.broadcast(wanted)).where(B.variant_compatible(F.col("variant"), F.col("w"))).groupBy("w").agg(F.sum("n").alias("n"))


@query(f"WITH {ENTRIES} SELECT id, record FROM e WHERE dataset = 'g1' AND record IN (SELECT 'records/' || p_partkey FROM part WHERE p_size > 20)")
def q_matching_entries(spark, d):
    stored = V.table(spark, d, "part").where("p_size > 20").select(F.concat(F.lit("records/"), F.col("p_partkey").cast("string")).alias("record"))
    return B.matching_entries(_entries(spark, d), stored, "g1").select("id", "record")


@query(f"WITH {RUNS} SELECT id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'plateau' END AS stop_reason FROM r WHERE id % 4 >= 2")
def q_finished_runs(spark, d):
    reason = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, "  ").otherwise("plateau")
    return B.finished(_runs(spark, d).withColumn("stop_reason", reason)).select("id", "stop_reason")


@query(f"WITH {RUNS}, w AS (SELECT p, t FROM range(1, 9) a(p), range(1, 5) b(t)) SELECT CAST(p AS INT) AS pipelines, CAST(t AS INT) AS threads FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE pipelines = p AND threads = t AND run = 'run3')")
def q_shapes_left(spark, d):
    wanted = spark.range(32).select((1 + F.col("id") % 8).cast("int").alias("pipelines"), (1 + F.floor(F.col("id") / 8)).cast("int").alias("threads"))
    return B.shapes_left(wanted, _runs(spark, d).where("run = 'run3'"), ["pipelines", "threads"])


@query(f"WITH {RUNS} SELECT 'run99:run5:' || id AS id, 'run5' AS resumed_from, 'run99' AS run, wall FROM r WHERE run = 'run5'")
def q_resumed_run(spark, d):
    r = _runs(spark, d).withColumn("id", F.concat("run", F.lit(":run5:"), F.col("id").cast("string")))
    return B.resumed(r, "run5", "run99").select("id", "resumed_from", "run", "wall")


# what they derive
DERIVED = f"""WITH {RUNS}, a AS (SELECT id, wall, actual, pipelines, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 6 END AS shards, CASE WHEN id % 8 = 0 THEN NULL ELSE threads END AS threads, CASE WHEN id % 7 <> 0 THEN wall * 8 END AS serial, CASE WHEN id % 14 = 0 THEN 2.5::DOUBLE END AS acc FROM r),
  b AS (SELECT id, wall, actual, greatest(1, coalesce(shards, 1)) AS shards, greatest(1, coalesce(threads, 1)) AS threads, pipelines, serial, acc, CASE WHEN wall > 0 THEN wall END AS w FROM a),
  c AS (SELECT *, least(pipelines, shards) AS active, coalesce(acc, CASE WHEN serial <> 0 THEN serial / w END) AS acceleration FROM b)"""


@query(DERIVED + " SELECT id, active || 'p/' || shards || 's/' || threads || 't' AS shape, acceleration, acceleration / (active * threads) AS efficiency, wall * active * threads AS thread_seconds, actual / w AS sets_per_second, actual * 5 AS evaluations, actual * 5 / w AS evaluations_per_second FROM c")
def q_derived_observations(spark, d):
    i = F.col("id")
    o = _runs(spark, d).withColumns({"shards": F.when(i % 4 != 0, i % 6), "threads": F.when(i % 8 != 0, F.col("threads")), "serial": F.when(i % 7 != 0, F.col("wall") * 8), "acceleration": F.when(i % 14 == 0, 2.5), "pages": F.lit(5), "evaluations": F.lit(None).cast("int")})
    return B.derived(o).select("id", "shape", "acceleration", "efficiency", "thread_seconds", "sets_per_second", "evaluations", "evaluations_per_second")


SHAPES = f"""WITH {RUNS}, c AS (SELECT *, pipelines * threads AS allocated FROM r WHERE {COMPARABLE}), f AS (SELECT *, row_number() OVER (PARTITION BY detector, runner, pipelines, threads ORDER BY wall, id) AS k,
    count(*) OVER (PARTITION BY detector, runner, pipelines, threads) AS n, median(wall) OVER (PARTITION BY detector, runner, pipelines, threads) AS med, min(CASE WHEN pipelines = 1 THEN wall END) OVER (PARTITION BY detector, runner) AS one FROM c),
  s AS (SELECT detector, runner, pipelines, threads, n, wall, med AS median, actual / wall AS rate, allocated, id AS sequence, one / wall AS speedup FROM f WHERE k = 1),
  p AS (SELECT *, row_number() OVER (PARTITION BY detector, runner ORDER BY round_even(rate, 2) DESC, allocated, pipelines, threads, wall, sequence) AS place FROM s)"""


def _shapes(spark, d):
    return B.shape_index(B.comparable_shapes(_runs(spark, d)).withColumn("sequence", F.col("id")), ["detector", "runner"])


@query(SHAPES + " SELECT detector, runner, pipelines, threads, CAST(n AS BIGINT) AS n, wall, median, rate, speedup, place = 1 AS preferred FROM p")
def q_shape_index(spark, d):
    return _shapes(spark, d).select("detector", "runner", "pipelines", "threads", "n", "wall", "median", "rate", "speedup", "preferred")


@query(SHAPES + ", o AS (SELECT * FROM s WHERE detector = 'click' AND runner IN ('r1', 'r4')) SELECT CAST((SELECT count(DISTINCT runner) FROM o) AS BIGINT) AS groups, CAST((SELECT sum(n) FROM o) AS BIGINT) AS observations, pipelines, threads, rate FROM o ORDER BY round_even(rate, 2) DESC, allocated, pipelines, threads, wall, sequence LIMIT 1")
def q_restricted_index(spark, d):
    keys = spark.createDataFrame([("click", "r1"), ("click", "r4"), ("click", "none")], "detector string, runner string")
    return B.restricted(_shapes(spark, d), keys, ["detector", "runner"])


@query(f"WITH {RUNS}, c AS (SELECT *, pipelines * threads AS allocated, actual / wall AS rate FROM r WHERE {MEASURED}), p AS (SELECT *, row_number() OVER (PARTITION BY runner ORDER BY round_even(rate, 2) DESC, allocated, pipelines, threads, wall, id) AS place FROM c) SELECT runner, cpus, pipelines, threads, least(1.0, allocated / (2 * cpus)) AS fraction FROM p WHERE place = 1")
def q_runner_evidence(spark, d):
    return B.runner_evidence(B.measured(_runs(spark, d)).withColumn("sequence", F.col("id")), ["runner", "cpus"]).select("runner", "cpus", "pipelines", "threads", "fraction")


@query(SHAPES + " SELECT detector, runner AS key, upper(runner) AS title, pipelines, threads FROM p WHERE place = 1 AND runner <> 'r2'")
def q_executor_rows(spark, d):
    best = F.when(F.col("runner") != "r2", F.struct("pipelines", "threads")).alias("best")
    nested = _shapes(spark, d).where("preferred").groupBy("detector").agg(F.collect_list(F.struct(F.col("runner").alias("key"), F.upper("runner").alias("title"), best)).alias("runners"))  # a runner's row each
    return B.executor_rows(nested)


METHODS = "CASE k % 4 WHEN 0 THEN 'binary' WHEN 1 THEN 'adaptive, binary' WHEN 2 THEN NULL ELSE ' , ' END"
META = f"m AS (SELECT 'run' || k AS run, {METHODS} AS method, CASE WHEN k % 3 = 0 THEN k * 10.0::DOUBLE END AS search_seconds FROM range(0, 9) t(k))"


def _meta(spark):
    k = F.col("id")
    method = F.when(k % 4 == 0, "binary").when(k % 4 == 1, "adaptive, binary").when(k % 4 == 3, " , ")
    return spark.range(9).select(F.concat(F.lit("run"), k.cast("string")).alias("run"), method.alias("method"), F.when(k % 3 == 0, k * 10.0).alias("search_seconds"))


@query(f"WITH {RUNS}, {META}, s AS (SELECT run, pipelines, min(wall) AS wall FROM r WHERE wall > 0 GROUP BY 1, 2), t AS (SELECT run, sum(wall) AS total FROM s GROUP BY 1) SELECT s.run, pipelines, CASE WHEN m.run IS NULL THEN 'legacy' WHEN method = 'binary' THEN 'powers-of-2' WHEN method = 'adaptive, binary' THEN 'adaptive, powers-of-2' ELSE 'unknown' END AS method, CAST(floor(coalesce(search_seconds, total) * 1000 + 0.5) AS BIGINT) AS search_ms FROM s JOIN t USING (run) LEFT JOIN m USING (run)")
def q_shape_methods(spark, d):
    s = _runs(spark, d).where("wall > 0").groupBy("run", "pipelines").agg(F.min("wall").alias("wall"))
    return B.shape_methods(s, _meta(spark)).select("run", "pipelines", "method", F.floor(F.col("search_seconds") * 1000 + 0.5).cast("long").alias("search_ms"))


@query("SELECT 'adaptive, powers-of-2, powers-of-2, unknown' AS methods")
def q_represented_methods(spark, d):
    return B.represented_methods(_runs(spark, d), _meta(spark))


# which are chosen
@query(f"WITH {RUNS} SELECT detector, id, seen FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY seen DESC, id DESC) AS k FROM r WHERE mode = 'smoke') WHERE k = 1")
def q_newest_smoke(spark, d):
    return B.newest_of(_runs(spark, d).where("mode = 'smoke'"), ["detector"], ["seen", "id"]).select("detector", "id", "seen")


@query(f"WITH {ENTRIES} SELECT detector, id, build FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY created DESC, build DESC, id DESC) AS k FROM e WHERE status = 'provisional') WHERE k = 1")
def q_newest_smoke_records(spark, d):
    # builds are compared as texts: '9' is after '10'
    return B.newest_of(_entries(spark, d).where("status = 'provisional'"), ["detector"], ["created", "build", "id"]).select("detector", "id", "build")


@query(f"WITH {RUNS} SELECT detector, arg_max(run, (seen, run)) AS run FROM r WHERE id % 4 >= 2 GROUP BY detector")
def q_newest_finished_run(spark, d):
    r = _runs(spark, d).withColumn("stop_reason", F.when(F.col("id") % 4 >= 2, "done").otherwise(" "))
    return B.newest_of(B.finished(r), ["detector"], ["seen", "run"]).select("detector", "run")


@query(f"WITH {RUNS}, l AS (SELECT detector, run, max(seen) AS last FROM r WHERE source = 'execution-optimizer' AND run <> 'run7' GROUP BY 1, 2) SELECT detector, run, last FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY last DESC, run DESC) AS k FROM l) WHERE k = 1")
def q_newest_published_run(spark, d):
    r = _runs(spark, d).where("source = 'execution-optimizer'").withColumn("run", F.when(F.col("run") == "run7", " ").otherwise(F.col("run")))
    return B.newest_run(r, ["detector"], "run", "seen")


@query(f"WITH {RUNS}, {ENTRIES} SELECT detector FROM e WHERE status = 'authoritative' UNION SELECT detector FROM r WHERE wall > 50 UNION SELECT 'd' || s_nationkey FROM supplier")
def q_any_evidence(spark, d):
    s = V.table(spark, d, "supplier").select(F.concat(F.lit("d"), F.col("s_nationkey").cast("string")).alias("detector"))
    return B.any_evidence([_entries(spark, d).where("status = 'authoritative'"), _runs(spark, d).where("wall > 50"), s], "detector")


@query(f"WITH {ENTRIES}, o AS (SELECT detector, status, quality, created, id FROM e WHERE id % 2 = 0 AND dataset = 'g0' UNION ALL SELECT detector, 'authoritative', quality - 100000, created, id FROM e WHERE id % 2 = 1 AND dataset = 'g0') SELECT detector, status, quality, id FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY (status = 'authoritative') DESC, CASE WHEN status = 'authoritative' THEN quality ELSE 0 END DESC, created DESC, id DESC) AS k FROM o) WHERE k = 1")
def q_best_known(spark, d):
    from ..operators import selection as X

    e = _entries(spark, d).where("dataset = 'g0'")
    stored = e.where("id % 2 = 0").select("detector", "status", "quality", "created", "id", "record")
    current = e.where("id % 2 = 1").select("detector", F.lit("authoritative").alias("status"), (F.col("quality") - 100000).alias("quality"), "created", "id")
    both = stored.unionByName(current, allowMissingColumns=True)
    return X.best_record(both, ["detector"], F.col("status") == "authoritative", F.col("quality"), "created", "id").select("detector", "status", "quality", "id")


@query(f"WITH {ENTRIES} SELECT detector, dataset, id FROM (SELECT *, row_number() OVER (PARTITION BY detector, dataset ORDER BY (status = 'authoritative') DESC, CASE WHEN status = 'authoritative' THEN quality ELSE 0 END DESC, created DESC, id DESC) AS k FROM e WHERE nullif(trim(variant), '') IS NULL OR variant = 'x_current') WHERE k = 1")
def q_reference_record(spark, d):
    from ..operators import selection as X

    e = _entries(spark, d)
    e = e.where(B.variant_compatible(F.col("variant"), F.lit("x_current")))
    return X.best_record(e, ["detector", "dataset"], F.col("status") == "authoritative", F.col("quality"), "created", "id").select("detector", "dataset", "id")


@query(f"WITH {RUNS}, i AS (SELECT id, seen FROM r WHERE id % 3 = 0), n AS (SELECT id, seen FROM r WHERE id % 2 = 0 AND id % 3 <> 0), u AS (SELECT *, 0 AS b FROM i UNION ALL SELECT *, 1 FROM n) SELECT id FROM u ORDER BY b DESC, seen DESC, id DESC LIMIT 700")
def q_prediction_log(spark, d):
    r = _runs(spark, d).select("id", "seen")
    return B.with_prediction(r.where("id % 3 = 0"), r.where("id % 2 = 0"), "id", ["seen", "id"], 700).select("id")


QUEUE = "WITH d AS (SELECT p_brand AS detector, CASE WHEN p_brand LIKE '%3' THEN NULL ELSE sum(p_size) END AS est, min(p_partkey) AS rank FROM part GROUP BY 1)"


@query(QUEUE + " SELECT 'lpt' AS kind, detector, row_number() OVER (ORDER BY coalesce(est, (SELECT max(est) FROM d)) DESC, detector DESC) AS place FROM d UNION ALL SELECT 'ranked', detector, row_number() OVER (ORDER BY rank, detector) FROM d UNION ALL SELECT 'fifo', detector, row_number() OVER (ORDER BY detector) FROM d")
def q_queue_order(spark, d):
    est = F.when(~F.col("p_brand").like("%3"), F.col("s"))
    t = V.table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("s"), F.min("p_partkey").alias("rank")).select(F.col("p_brand").alias("detector"), est.alias("est"), "rank")
    out = None
    for kind in ("lpt", "ranked", "fifo"):
        q = B.queue(t, "detector", "est", "rank", kind).select(F.lit(kind).alias("kind"), "detector", "place")
        out = q if out is None else out.union(q)
    return out


@query(f"WITH {RUNS} SELECT DISTINCT p_brand AS detector FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || (1 + user_id % 19) FROM events WHERE event_type = 'click')")
def q_missing_preference(spark, d):
    have = V.table(spark, d, "events").where("event_type = 'click'").select(F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 19).cast("string")).alias("detector"))
    return V.table(spark, d, "part").select(F.col("p_brand").alias("detector")).distinct().join(have, "detector", "left_anti")
