"""Queries of the run operators on the star-schema tables, and the SQL that each equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import metrics as M
from ..operators import planning as P
from ..operators import runs as R
from . import views as V
from .registry import query

# shards
SHARDS = "SELECT l_orderkey AS run, CAST(l_linenumber - 1 AS INT) AS shard, CAST(1 + l_orderkey % 7 + CASE WHEN l_orderkey % 40 = 0 AND l_linenumber = 2 THEN 1 ELSE 0 END AS INT) AS n FROM {lineitem}"


@query(f"""WITH {V.cte("s", SHARDS)}, g AS (SELECT run, max(n) AS expected, min(n) AS least, list(DISTINCT shard) AS found FROM s GROUP BY run),
  x AS (SELECT run, expected, least = expected AS one_count, array_to_string(list_filter(range(expected), lambda k: NOT list_contains(found, k)), ',') AS missing, array_to_string(list_sort(list_filter(found, lambda k: k >= expected)), ',') AS extra FROM g)
SELECT run, expected, one_count, coalesce(missing, '') AS missing, coalesce(extra, '') AS extra, one_count AND coalesce(missing, '') = '' AND coalesce(extra, '') = '' AS whole FROM x""")
def q_shard_sets(spark, d):
    return R.shard_sets(V.shared(spark, d, SHARDS), "run", "shard", "n")


@query("SELECT coalesce(a, b) AS key, CASE WHEN b IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT c_custkey AS a FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_totalprice > 400000) ON a = b WHERE a IS NULL OR b IS NULL")
def q_set_difference(spark, d):
    a = V.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return R.set_difference(a, V.table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("key")), ["key"])


# reranking and totals
RERANK = f"WITH {V.EVAL}, m AS (SELECT detector, set_id, {V.MOMENTS} FROM v_eval GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY {V.ORDER}) AS place FROM m), g AS (SELECT detector, CAST(count(*) AS BIGINT) AS n_sets, CAST(sum(n_ok) AS BIGINT) AS n_ok_pages, CAST(count(*) FILTER (n_failed = 0) AS BIGINT) AS n_whole_sets, CAST(sum(n_failed) AS BIGINT) AS n_failures FROM m GROUP BY 1), s AS (SELECT detector, min(set_id) AS previous FROM m WHERE detector <> 'Brand#5' GROUP BY 1)"


@query(RERANK + " SELECT detector, set_id AS winner, mean_iou, previous, coalesce(previous <> set_id, false) AS changed, n_sets, n_ok_pages, n_whole_sets, n_failures FROM k JOIN g USING (detector) LEFT JOIN s USING (detector) WHERE place = 1")
def q_rerank(spark, d):
    e = V.v_eval(spark, d)
    stored = e.where("detector <> 'Brand#5'").groupBy("detector").agg(F.min("set_id").alias("winner"))
    return R.rerank(e, stored, "detector", "set_id")


@query("SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS reranked, CAST(count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS BIGINT) AS changed, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS skipped, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS failed FROM orders")
def q_rebuild_totals(spark, d):
    s = F.col("o_orderstatus")
    return R.rebuild_totals(V.table(spark, d, "orders").select(F.when(s == "F", "reranked").when(s == "O", "skipped").otherwise("failed").alias("outcome"), (F.col("o_orderkey") % 3 == 0).alias("changed")), "outcome", "changed")


RUN_SPANS = f"WITH {V.TASK}, t AS (SELECT lane, o_orderkey % 90 AS sets, o_orderkey % 6 AS pages, \"end\" - \"start\" AS elapsed, \"start\" AS started, \"end\" AS finished, 'v' || o_orderkey % 2 AS version, CASE WHEN lane LIKE '1%' THEN NULL ELSE 8 END AS threads FROM v_task)"


def _spans(spark, d):
    k = F.col("o_orderkey")
    return V.v_task(spark, d).select("lane", (k % 90).alias("sets"), (k % 6).alias("pages"), (F.col("end") - F.col("start")).alias("elapsed"), F.col("start").alias("started"), F.col("end").alias("finished"), F.concat(F.lit("v"), (k % 2).cast("string")).alias("version"), F.when(~F.col("lane").like("1%"), 8).alias("threads"))


@query(RUN_SPANS + " SELECT lane, CAST(count(*) AS BIGINT) AS n_runs, CAST(sum(sets) AS BIGINT) AS n_sets, CAST(sum(sets * pages) AS BIGINT) AS n_evaluations, CAST(sum(elapsed) AS BIGINT) AS elapsed, max(finished) - min(started) AS span, CAST(sum(elapsed) AS DOUBLE) / (max(finished) - min(started)) AS concurrency FROM t GROUP BY 1")
def q_run_totals(spark, d):
    return R.totals(_spans(spark, d), ["lane"])


@query(RUN_SPANS + " SELECT lane, max(finished) - min(started) AS span, 'mixed' AS version, CASE WHEN lane LIKE '1%' THEN NULL ELSE '8' END AS threads FROM t GROUP BY lane")
def q_execution_settings(spark, d):
    return R.execution(_spans(spark, d), ["version", "threads"], ["lane"])


# report rows
VIEW = "WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size / 100.0::DOUBLE END AS w, CASE WHEN p_partkey % 4 = 0 THEN p_size / 200.0::DOUBLE END AS wo, CASE WHEN p_partkey % 5 = 0 THEN p_size / 50.0::DOUBLE END AS s, p_size / 25.0::DOUBLE AS l FROM part)"


@query(VIEW + " SELECT p_partkey, coalesce(w, s, l) AS mean, coalesce(CASE WHEN w IS NOT NULL THEN wo ELSE s / 2 END, w, s, l) AS mean_ok, CASE WHEN w IS NOT NULL THEN 1 ELSE 2 END AS least FROM v")
def q_metric_view(spark, d):
    k, x = F.col("p_partkey"), F.col("p_size")
    w, wo, s = F.when(k % 3 == 0, x / 100.0), F.when(k % 4 == 0, x / 200.0), F.when(k % 5 == 0, x / 50.0)
    one = lambda mean, ok, least: F.struct(mean.alias("mean"), ok.alias("mean_ok"), F.lit(least).alias("least"), F.lit(0.5).alias("deviation"), F.lit(0).alias("failures"))
    p = V.table(spark, d, "part").select("p_partkey", one(w, wo, 1).alias("winner"), one(s, s / 2, 2).alias("selection"), F.struct((x / 25.0).alias("best")).alias("landscape"))
    return R.metric_view(p).select("p_partkey", "mean", "mean_ok", "least")


RESULT = "WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 10000 END AS mean, c_custkey % 4 <> 0 AS there, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 THEN c_nationkey / 50.0::DOUBLE END AS base, c_custkey % 6 AS seconds, c_custkey % 8 AS pages, c_nationkey AS images FROM customer), p AS (SELECT *, CASE WHEN seconds > 0 AND pages > 0 THEN pages / seconds END AS page_rate FROM r)"


@query(RESULT + " SELECT c_custkey, CASE WHEN there THEN coalesce(mean, 0) - coalesce(base, 0) END AS delta, page_rate, CASE WHEN page_rate > 0 AND images > 0 THEN images / page_rate END AS document_seconds, coalesce(mean > base, false) AS surpassed FROM p")
def q_result_rows(spark, d):
    k = F.col("c_custkey")
    r = V.table(spark, d, "customer").select("c_custkey", F.when(k % 9 != 0, F.col("c_acctbal") / 10000).alias("mean"), (k % 4 != 0).alias("baseline_there"), F.when((k % 4 != 0) & (k % 5 != 0), F.col("c_nationkey") / 50.0).alias("baseline_mean"), (k % 6).alias("seconds"), (k % 8).alias("pages"), F.col("c_nationkey").alias("images"))
    return R.result_row(r).select("c_custkey", "delta", "page_rate", "document_seconds", "surpassed")


#: JSON of calibrations, whose braces are written as chr(123) and chr(125).
CALIBRATIONS = """SELECT o_orderkey AS id, 'd' || CAST(o_custkey % 9 AS STRING) AS detector, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'partial' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '1997-02-03T10:00:00Z' END AS created,
  CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'g1' END AS dataset, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'abcdefabcdefabcdef' END AS parameter,
  chr(123) || '"search":' || chr(123) || '"exhaustive_complete":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"parameter_sets":' || CAST(o_orderkey AS STRING) || chr(125) || ',"landscape":' || chr(123) || '"best_mean_iou":0.25' || chr(125)
  || CASE WHEN o_orderkey % 7 < 3 THEN ',"selection":' || chr(123) || '"best_avg_iou":0.5,"minimum_iou":0.125,"recommended":"fedcba9876543210","evidence":"High"' || chr(125) ELSE '' END
  || CASE WHEN o_orderkey % 7 IN (2, 3) THEN ',"winner":' || chr(123) || '"mean":0.75,"mean_ok":0.875,"failures":2,"id":"0123456789abcdef"' || chr(125) ELSE '' END || ',"baseline":' || chr(123) || '"mean":0.0625' || chr(125) || ',"confidence":' || chr(123) || '"rating":"Low"' || chr(125)
  || ',"identity":' || chr(123) || '"created":"1996-01-01T00:00:00Z"' || chr(125) || chr(125) AS payload FROM {orders}"""


@query(f"""WITH {V.cte("c", CALIBRATIONS)}, f AS (SELECT *, id % 7 IN (2, 3) AS w, id % 7 < 3 AS s FROM c)
SELECT id, detector, CASE WHEN id % 5 = 0 THEN 'unknown' ELSE 'g1' END AS dataset, CASE WHEN id % 4 = 0 THEN '1996-01-01' ELSE '1997-02-03' END AS date, CASE WHEN id % 3 <> 0 THEN 'partial' WHEN id % 2 = 0 THEN 'authoritative' ELSE 'partial' END AS status,
  CASE WHEN s THEN 'fedcba987654' WHEN id % 6 <> 0 THEN 'abcdefabcdef' WHEN w THEN '0123456789ab' ELSE 'unknown' END AS parameter, CASE WHEN id % 2 = 0 THEN 'complete' ELSE 'partial' END AS coverage, id AS n_sets,
  CASE WHEN w THEN 0.75 WHEN s THEN 0.5 ELSE 0.25 END::DOUBLE AS mean, CASE WHEN w THEN 0.875 WHEN s THEN 0.5 ELSE 0.25 END::DOUBLE AS mean_ok, CASE WHEN w THEN NULL WHEN s THEN 0.125 END::DOUBLE AS least, CASE WHEN w THEN 2 END::BIGINT AS failures,
  CASE WHEN w THEN 0.75 WHEN s THEN 0.5 ELSE 0.25 END::DOUBLE - 0.0625 AS delta, CASE WHEN s THEN 'High' ELSE 'Low' END AS evidence FROM f""")
def q_record_rows(spark, d):
    r = R.record_rows(V.shared(spark, d, CALIBRATIONS))
    return r.select(F.col("n_sets").alias("id"), "detector", "dataset", "date", "status", "parameter", "coverage", "n_sets", "mean", "mean_ok", "least", "failures", "delta", "evidence")


# verdicts
VERDICT = "WITH v AS (SELECT p_partkey AS id, 1 + p_partkey % 3 AS rank, CASE WHEN p_partkey % 11 <> 0 THEN p_size / 50.0::DOUBLE END AS near, p_partkey % 2 = 0 AS complete, p_size AS evaluated, p_partkey % 60 AS possible, p_partkey % 5 AS parameters, least(p_partkey % 5, p_size % 5) AS dormant, (p_partkey % 10) / 10.0::DOUBLE AS success, p_partkey % 4 AS pages FROM part)"


@query(VERDICT + " SELECT id, CASE WHEN near IS NULL THEN 'unavailable' WHEN rank > 1 THEN 'outranked' WHEN near >= 0.5 AND (complete OR coalesce(evaluated / nullif(possible, 0), 0) >= 0.5) THEN 'calibrated' WHEN near <= 0.05 AND NOT complete AND coalesce(evaluated / nullif(possible, 0), 0) < 0.5 THEN 'continue' ELSE 'retain' END AS advice, CASE WHEN near >= 0.9 AND (parameters = 0 OR dormant / nullif(parameters, 0) >= 0.75) THEN 'low' WHEN success < 0.5 OR pages = 0 THEN 'reliability' WHEN near <= 0.05 AND NOT complete THEN 'broaden' WHEN complete THEN 'characterised' ELSE 'some' END AS worth FROM v")
def q_recommendations(spark, d):
    k, x = F.col("p_partkey"), F.col("p_size")
    near, complete = F.when(k % 11 != 0, x / 50.0), k % 2 == 0
    worth = R.tuning_worth(near, k % 5, F.least(k % 5, (x % 5).cast("long")), (k % 10) / 10.0, k % 4, complete)
    return V.table(spark, d, "part").select(k.alias("id"), R.recommendation(1 + k % 3, near, complete, x, k % 60).alias("advice"), worth.alias("worth"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size % 3 WHEN p_size % 4 > 0 THEN p_size % 4 ELSE 60 END AS important, CASE WHEN p_size % 4 > 0 THEN p_size % 4 ELSE 60 END AS non_dormant, CASE WHEN p_partkey % 3 > 0 THEN greatest(0, p_size - 1 - CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) END AS budget, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 2 = 0 AND p_size > 3 THEN 'batches' ELSE 'dynamic' END AS strategy, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 2 = 0 AND p_size > 3 THEN least(1 + p_partkey % 4, p_size - 3) ELSE 0 END AS seeds FROM part")
def q_scopes_and_claims(spark, d):
    k, x = F.col("p_partkey"), F.col("p_size")
    sizes = F.create_map(F.lit("moderate_plus"), x % 3, F.lit("non_dormant"), x % 4, F.lit("exhaustive"), F.lit(60))
    claim = R.claim_strategy(1 + k % 4, F.when(k % 2 == 0, " LPT").otherwise("fifo"), F.greatest(F.lit(0), x - 3))
    p = V.table(spark, d, "part").select(k, R.scope_sets(sizes, "important_plus").alias("important"), R.scope_sets(sizes, "non_dormant").alias("non_dormant"), R.search_budget(F.when(k % 3 > 0, x), k % 2 == 0).alias("budget"), claim.alias("c"))
    return p.select("p_partkey", "important", "non_dormant", "budget", "c.strategy", "c.seeds")


@query(f"WITH {V.METRICS}, k AS (SELECT set_id, row_number() OVER (ORDER BY {V.ORDER}) AS rank FROM m), j AS (SELECT set_id, page, rank, status FROM v_eval JOIN k USING (set_id)) SELECT 'winner' AS policy, CAST(count(*) AS BIGINT) AS n, CAST(sum(page) AS BIGINT) AS pages FROM j WHERE rank = 1 UNION ALL SELECT 'failures', count(*), CAST(sum(page) AS BIGINT) FROM j WHERE status <> 'ok' UNION ALL SELECT 'all', count(*), CAST(sum(page) AS BIGINT) FROM j UNION ALL SELECT 'none', 0, NULL")
def q_debug_pairs(spark, d):
    e = V.v_eval(spark, d)
    r = M.search_rank(M.set_metrics(e, ["set_id"]), F.lit(True), ["set_id"])
    out = None
    for p in ("winner", "failures", "all", "none"):
        one = R.debug_pairs(r, e, "set_id", p).agg(F.count("*").alias("n"), F.sum("page").alias("pages")).select(F.lit(p).alias("policy"), "n", "pages")
        out = one if out is None else out.union(one)
    return out


# joins of pages
@query("SELECT d.doc_id, d.n_chars, coalesce(l.quality, CASE WHEN l.doc_id IS NULL THEN -1 END) AS quality, CASE WHEN l.doc_id IS NULL THEN 0 ELSE l.toxic END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_manifest_defaults(spark, d):
    return R.with_defaults(V.table(spark, d, "documents").select("doc_id", "n_chars"), V.table(spark, d, "labels"), "doc_id", {"quality": -1, "toxic": 0})


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(greatest(0, CAST(epoch(l_shipdate) AS BIGINT) - 2592000 - CAST(epoch(o_orderdate) AS BIGINT)), 0) AS wait FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) ON l_orderkey = o_orderkey")
def q_claim_waits(spark, d):
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    tasks = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), "l_linenumber", "l_partkey", (sec("l_shipdate") - 2592000).alias("start"))
    claims = V.table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("batch"), sec("o_orderdate").alias("claimed"))
    return R.claim_waits(tasks, claims, "batch").select(F.col("batch").alias("l_orderkey"), "l_linenumber", "l_partkey", "wait")


NUMBERS = """WITH p AS (SELECT c_nationkey AS src, c_custkey AS pos FROM customer), s AS (SELECT src, min(pos) + CASE WHEN src % 4 = 1 THEN 100 ELSE 0 END AS lo, max(pos) - CASE WHEN src % 5 = 2 THEN 50 ELSE 0 END AS hi, CASE WHEN src % 6 = 3 THEN src * 1000 END AS start FROM p GROUP BY 1),
  i AS (SELECT p.*, s.start FROM p JOIN s USING (src) WHERE pos BETWEEN lo AND hi), g AS (SELECT *, (SELECT max(src) FROM s x WHERE x.start IS NOT NULL AND x.src <= i.src) AS seg FROM i)
SELECT src, pos, coalesce((SELECT start FROM s x WHERE x.src = g.seg), 1) + row_number() OVER (PARTITION BY seg ORDER BY src, pos) - 1 AS number FROM g"""


@query(NUMBERS)
def q_source_numbers(spark, d):
    p = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("pos"))
    s = F.col("src")
    o = p.select("src").distinct().select("src", F.when(s % 6 == 3, s * 1000).alias("start"), F.when(s % 4 == 1, 100).alias("head"), F.when(s % 5 == 2, 50).alias("tail"))
    return R.numbered_sources(p, "src", "pos", o)


# planning rules that stand alone
@query(f"WITH {V.cte('r', V.RUNS)} SELECT id, CASE WHEN wall > 0 AND actual > 0 THEN wall * sqrt(threads) / actual * possible END AS serial, CASE WHEN mode = 'full' AND strategy = 'exhaustive' AND id % 3 > 0 THEN 'full-exhaustive' ELSE 'short' END AS workload, CASE WHEN id % 100 >= 90 AND id % 7 = 0 THEN pipelines + 1 WHEN pipelines > 1 AND (id % 100 < 68 OR id % 7 >= 4) THEN pipelines - 1 ELSE pipelines END AS workers, CASE WHEN mode = 'smoke' THEN 'provisional' WHEN coalesce(actual = possible, false) THEN 'authoritative' ELSE 'partial' END AS status FROM r")
def q_run_rules(spark, d):
    r, i = V.shared(spark, d, V.RUNS), F.col("id")
    return r.select("id", P.serial_estimate(F.col("wall"), F.col("actual"), F.col("threads"), F.col("possible")).alias("serial"), P.workload_class(F.col("mode"), F.col("strategy"), F.when(i % 3 > 0, "").otherwise("20")).alias("workload"), P.feedback_workers(F.col("pipelines"), (i % 100) / 100.0, F.when(i % 7 == 0, 0.1).when(i % 7 >= 4, 0.5).otherwise(0.2)).alias("workers"), P.publication_status(F.col("mode"), F.coalesce(F.col("actual") == F.col("possible"), F.lit(False))).alias("status"))


@query("SELECT doc_id, CASE WHEN n_chars % 100 < 45 THEN 'fail' WHEN n_chars % 100 < 70 OR doc_id % 4 = 0 THEN 'review' ELSE 'pass' END AS status FROM documents")
def q_quality_status(spark, d):
    reasons = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("blank"))).otherwise(F.array().cast("array<string>"))
    return V.table(spark, d, "documents").select("doc_id", P.quality_status((F.col("n_chars") % 100) / 100.0, reasons, 0.45, 0.70).alias("status"))


@query("SELECT status, CAST(count(*) AS BIGINT) AS n, median(score) FILTER (status <> 'error') AS median_score, CAST(count(*) FILTER (status IN ('review', 'fail', 'error')) AS BIGINT) AS queued FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'error' WHEN n_chars % 100 < 45 THEN 'fail' WHEN n_chars % 100 < 70 THEN 'review' ELSE 'pass' END AS status, n_chars % 100 AS score FROM documents) GROUP BY status")
def q_quality_summary(spark, d):
    n = F.col("n_chars") % 100
    s = V.table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 == 0, "error").otherwise(P.quality_status(n / 100.0, F.array(), 0.45, 0.70)).alias("status"), n.alias("score"))
    return s.groupBy("status").agg(F.count("*").alias("n"), F.median(F.when(F.col("status") != "error", F.col("score"))).alias("median_score"), F.count(F.when(F.col("status").isin("review", "fail", "error"), 1)).alias("queued"))


@query("SELECT p_size, CASE WHEN p_size % 5 = 0 THEN 'critical' WHEN p_size % 7 > 0 THEN 'non_dormant' ELSE 'exhaustive' END AS strategy FROM (SELECT DISTINCT p_size FROM part)")
def q_effect_strategies(spark, d):
    sizes = sorted(r.p_size for r in V.table(spark, d, "part").select("p_size").distinct().collect())  # fifty sizes of parts
    rows = [(n, E.effect_strategy("critical" if n % 5 == 0 else "moderate_plus", {"critical": 1, "moderate_plus": 0, "low_plus": 0, "non_dormant": n % 7})) for n in sizes]
    return spark.createDataFrame(rows, "p_size int, strategy string")


# candidates, claims, reporters
FOUND = f"WITH {V.EVAL}, c AS (SELECT set_id, page, detector AS method, CASE WHEN status = 'ok' AND set_id % 7 = 0 THEN 'error' ELSE status END AS status, ms, iou FROM v_eval)"


def _found(spark, d):
    status = F.when((F.col("status") == "ok") & (F.col("set_id") % 7 == 0), "error").otherwise(F.col("status"))
    return V.v_eval(spark, d).select("set_id", "page", F.col("detector").alias("method"), status.alias("status"), "ms", F.col("iou").alias("score"))


@query(FOUND + """ SELECT set_id, page, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS n_ok, CAST(count(*) FILTER (status = 'no_candidate') AS BIGINT) AS n_empty, CAST(count(*) FILTER (status = 'error') AS BIGINT) AS n_error,
  coalesce(string_agg(DISTINCT method, ',' ORDER BY method) FILTER (status = 'error'), '') AS failed, coalesce(string_agg(DISTINCT method, ',' ORDER BY method) FILTER (status = 'no_candidate'), '') AS empty FROM c GROUP BY 1, 2""")
def q_candidate_summary(spark, d):
    return R.candidate_summary(_found(spark, d), ["set_id", "page"])


@query(FOUND + " SELECT method, CAST(count(*) AS BIGINT) AS runs, sum(ms) AS total_ms, avg(ms) AS mean_ms, CAST(sum(iou) FILTER (status = 'ok') AS DOUBLE) / count(*) FILTER (status = 'ok') AS mean_score, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (status = 'no_candidate') AS BIGINT) AS no_candidate, CAST(count(*) FILTER (status = 'error') AS BIGINT) AS error FROM c GROUP BY 1")
def q_method_table(spark, d):
    return R.method_table(_found(spark, d))


VOTES = """WITH p AS (SELECT l_orderkey % 200 AS page, l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_quantity AS x, CAST(l_partkey % 60 AS DOUBLE) AS y FROM lineitem), s AS (SELECT c_custkey % 200 AS page, CAST(c_nationkey AS DOUBLE) AS ax, CAST(c_custkey % 50 AS DOUBLE) AS ay, CAST(c_nationkey + 10 AS DOUBLE) AS bx, CAST(c_custkey % 50 + c_nationkey % 3 AS DOUBLE) AS "by" FROM customer),
  t AS (SELECT p.*, s.*, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / ((bx - ax) ** 2 + ("by" - ay) ** 2))) AS k FROM p JOIN s USING (page))"""


@query(VOTES + ' SELECT DISTINCT id, line, part FROM t WHERE sqrt((x - ax - k * (bx - ax)) ** 2 + (y - ay - k * ("by" - ay)) ** 2) <= 2.25')
def q_supported_votes(spark, d):
    k = F.col("c_custkey")
    votes = V.table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("page"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 60).cast("double").alias("y"))
    n = F.col("c_nationkey").cast("double")
    segments = V.table(spark, d, "customer").select((k % 200).alias("page"), n.alias("ax"), (k % 50).cast("double").alias("ay"), (n + 10).alias("bx"), (k % 50 + F.col("c_nationkey") % 3).cast("double").alias("by"))
    return R.supported_votes(votes, segments, "page", "x", "y", 2.25).select("id", "line", "part").distinct()


CLAIMS = "WITH f AS (SELECT c_nationkey AS queue, c_custkey AS task, 1 + c_custkey % 9 AS est FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 12 <> 6 AND c_custkey % 100 > 40)), r AS (SELECT *, sum(est) OVER (PARTITION BY queue ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)"


@query(CLAIMS + " SELECT queue, task, est FROM r WHERE coalesce(before, 0) < 30")
def q_next_claims(spark, d):
    k = F.col("c_custkey")
    c = V.table(spark, d, "customer")
    leases = c.where(k % 3 == 0).select(k.alias("task"), F.when(k % 12 == 6, "corrupt").otherwise((k % 100).cast("string")).alias("expires"))
    tasks = c.select(F.col("c_nationkey").alias("queue"), k.alias("task"), (1 + k % 9).alias("est"))
    return R.next_claim(tasks, leases, "task", ["queue"], ["task"], "est", F.lit(40), 30)


BEATS = """WITH RECURSIVE b AS (SELECT event_type AS kind, event_id AS id, CAST(epoch(ts) AS BIGINT) AS t, row_number() OVER (PARTITION BY event_type ORDER BY epoch(ts), event_id) AS k FROM events WHERE event_id < 3000),
  r AS (SELECT kind, id, t, k, t AS last, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS emitted FROM b WHERE k = 1 UNION ALL SELECT b.kind, b.id, b.t, b.k, CASE WHEN b.t - last >= 3600 THEN b.t ELSE last END, CASE WHEN b.t - last >= 3600 THEN n + 1 ELSE n END, CASE WHEN b.t - last >= 3600 THEN 1 ELSE 0 END FROM r JOIN b ON b.kind = r.kind AND b.k = r.k + 1)"""


@query(BEATS + " SELECT kind, id, emitted, CASE WHEN emitted = 1 AND (n - 1) % 5 = 0 THEN 1 ELSE 0 END AS with_header FROM r")
def q_heartbeats(spark, d):
    from ..operators import folds as K

    e = V.table(spark, d, "events").where("event_id < 3000").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    return K.throttled(e, ["kind"], ["t", "id"], "t", 3600, 5).select("kind", "id", "emitted", F.col("with_header").cast("int").alias("with_header"))


RETAINED = f"WITH {V.cte('r', V.RUNS)}, k AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN source = 'live' THEN detector END, source ORDER BY seen DESC) AS place FROM r)"


@query(RETAINED + " SELECT id, source FROM k WHERE source = 'execution-optimizer' OR place <= 120")
def q_retained_observations(spark, d):
    from ..sources import sinks

    return sinks.retained(V.shared(spark, d, V.RUNS), ["detector"], "seen", 120).select("id", "source")


@query(f"WITH {V.cte('r', V.RUNS)}, n AS (SELECT id FROM r WHERE source = 'live' ORDER BY seen DESC LIMIT 200) SELECT id FROM r WHERE source <> 'live' UNION ALL SELECT id FROM n")
def q_retained_shards(spark, d):
    from ..sources import sinks

    return sinks.retained(V.shared(spark, d, V.RUNS), [], "seen", 200).select("id")


@query("WITH e AS (SELECT event_type AS key, event_id AS seq, value AS busy, event_id * 1.0 AS total FROM events), l AS (SELECT *, lag(busy) OVER w AS b, lag(total) OVER w AS t FROM e WINDOW w AS (PARTITION BY key ORDER BY seq)) SELECT key, seq, CASE WHEN b IS NOT NULL AND total > t THEN greatest(0, busy - b) / (total - t) END AS share FROM l")
def q_stream_counter_shares(spark, d):
    from ..streaming import live
    from .catalogue import _drained

    return _drained(spark, d, lambda s: live.counter_shares(s.withColumn("total", F.col("event_id").cast("double")), "event_type", "event_id", "value", "total"), "append")
