"""The queries of the engine's operators on the star-schema tables, and the SQL that each equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evidence as E
from ..operators import folds as K
from ..operators import grid as G
from ..operators import intelligence as I
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import planning as P
from ..operators import selection as X
from . import views as V
from .registry import query

# metrics and rankings
@query(f"WITH {V.METRICS} SELECT * FROM m")
def q_set_metrics(spark, d):
    return M.set_metrics(V.v_eval(spark, d), ["set_id"])


@query(f"WITH {V.METRICS} SELECT *, row_number() OVER (ORDER BY {V.ORDER}) AS rank FROM m ORDER BY {V.ORDER} LIMIT 20")
def q_rank_topk(spark, d):
    return M.ranked(M.top(M.set_metrics(V.v_eval(spark, d), ["set_id"]), ["set_id"], 20), ["set_id"])


@query(f"WITH {V.METRICS}, r AS (SELECT *, row_number() OVER (ORDER BY {V.ORDER}) AS rank FROM m) SELECT *, CASE WHEN set_id % 7 <> 0 THEN CAST(sum(CASE WHEN set_id % 7 <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END AS search_rank FROM r")
def q_search_rank(spark, d):
    return M.search_rank(M.set_metrics(V.v_eval(spark, d), ["set_id"]), F.pmod("set_id", F.lit(7)) != 0, ["set_id"])


def _winner_pages(spark, d):
    e = V.v_eval(spark, d)
    best = M.top(M.set_metrics(e, ["set_id"]), ["set_id"], 1).select("set_id")
    page = lambda x: x.groupBy("page").agg(F.max("iou").alias("iou"), F.min("status").alias("status"))
    winner = page(e.join(F.broadcast(best), "set_id"))  # one row
    return M.against_baseline(winner, page(e.where("set_id = 1 AND page <> 3")).select("page", "iou"))


WINNER = f"WITH {V.METRICS}, b AS (SELECT set_id FROM m ORDER BY {V.ORDER} LIMIT 1), w AS (SELECT page, max(iou) AS iou, min(status) AS status FROM v_eval JOIN b USING (set_id) GROUP BY page), l AS (SELECT page, max(iou) AS i FROM v_eval WHERE set_id = 1 AND page <> 3 GROUP BY page), j AS (SELECT w.*, coalesce(l.i, 0) AS base_iou, iou - coalesce(l.i, 0) AS delta FROM w LEFT JOIN l USING (page)), x AS (SELECT *, CASE WHEN status = 'error' THEN 'Unprocessed' WHEN status <> 'ok' THEN 'No polygon found' WHEN iou = 0 THEN 'Zero overlap' END AS lost FROM j), p AS (SELECT * EXCLUDE (lost), coalesce(lost, CASE WHEN base_iou = 0 THEN 'Recovered' WHEN delta > 0.1 THEN 'Improved' WHEN delta < -0.1 THEN 'Regressed' ELSE 'Unchanged' END) AS change, concat_ws('+', lost, CASE WHEN status = 'ok' AND iou > 0 AND iou < 50 THEN 'Poor match' END, CASE WHEN delta < -0.1 THEN 'Regressed' END) AS problems FROM x)"


@query(WINNER + " SELECT * FROM p")
def q_winner_vs_baseline(spark, d):
    return _winner_pages(spark, d)


@query(WINNER + " SELECT change, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (problems <> '') AS BIGINT) AS n_problems FROM p GROUP BY change")
def q_problem_counts(spark, d):
    return _winner_pages(spark, d).groupBy("change").agg(F.count("*").alias("n"), F.count(F.when(F.col("problems") != "", 1)).alias("n_problems"))


# metrics of successes alone, as older records have them, become those of all pages: the same as taken from the pages
UPGRADE = f"WITH {V.EVAL}, o AS (SELECT set_id, page, any_value(status) AS status, max(CASE WHEN status = 'ok' THEN iou ELSE 0 END) AS x FROM v_eval GROUP BY 1, 2) SELECT set_id, CAST(floor(avg(x) / 100 * 1e6 + 0.5) AS BIGINT) AS mean_e6, CAST(min(x) AS DOUBLE) / 100 AS min_all, CAST(floor(stddev_pop(x) / 100 * 1e6 + 0.5) AS BIGINT) AS std_e6 FROM o GROUP BY set_id"


@query(UPGRADE)
def q_metric_upgrade(spark, d):
    ok = F.max(F.when(F.col("status") == "ok", F.col("iou"))).alias("iou")
    page = V.v_eval(spark, d).groupBy("set_id", "page").agg(ok)
    x = F.when(F.col("iou") > 0, F.col("iou") / 100.0)
    old = page.groupBy("set_id").agg(F.count("*").alias("n_pages"), F.count(x).alias("n_ok"), F.avg(x).alias("ok_mean"), F.min(x).alias("ok_min"), F.stddev_pop(x).alias("ok_std"))
    return M.upgraded(old).select("set_id", F.floor(F.col("mean_all") * 1e6 + 0.5).cast("long").alias("mean_e6"), F.coalesce("min_all", F.lit(0.0)).alias("min_all"), F.floor(F.col("std_all") * 1e6 + 0.5).cast("long").alias("std_e6"))


@query(f"WITH {V.METRICS}, b AS (SELECT max(mean_iou) AS best FROM m), c AS (SELECT CAST(count(*) AS BIGINT) AS n_sets, count(*) FILTER (n_failed = 0) / CAST(count(*) AS DOUBLE) AS success_rate, count(*) FILTER (best - mean_iou <= 0.001) / CAST(count(*) AS DOUBLE) AS near_best_share FROM m, b), s AS (SELECT *, CAST(2 + (CASE WHEN success_rate >= 0.9 THEN 1 ELSE 0 END) + (CASE WHEN near_best_share >= 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS evidence FROM c) SELECT *, CASE WHEN evidence >= 4 THEN 'High' WHEN evidence >= 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM s")
def q_confidence(spark, d):
    return M.confidence(M.set_metrics(V.v_eval(spark, d), ["set_id"]), exhaustive=True)


# intelligence: sums of IoUs may differ in their last bits by order, so effects are held in millionths
PAIRS = (
    V.SETS
    + ", u AS (SELECT 'nation' AS parameter, CAST(nation AS VARCHAR) AS value, mean_iou AS x FROM v_sets UNION ALL SELECT 'step', CAST(step AS VARCHAR), mean_iou FROM v_sets UNION ALL SELECT 'rich', rich, mean_iou FROM v_sets)"
)
MOM = PAIRS + ", v AS (SELECT parameter, value, count(*) AS n, sum(x) AS s, max(x) AS best FROM u GROUP BY 1, 2)"
MICRO = "CAST(floor({} * 1e6 + 0.5) AS BIGINT)"


def _micro(x):
    return F.floor(x * 1e6 + 0.5).cast("long")


@query(f"WITH {MOM} SELECT parameter, value, CAST(n AS BIGINT) AS n, {MICRO.format('s')} AS s_e6, best FROM v")
def q_influence_moments(spark, d):
    return I.value_moments(V.v_sets(spark, d), V.SET_DIMS).select("parameter", "value", "n", _micro(F.col("s")).alias("s_e6"), "best")


CLASS = "CASE WHEN eta < 0.0005 AND w < 0.0005 THEN 'Zombie' WHEN eta < 0.005 THEN 'Dormant' WHEN eta >= 0.14 THEN 'Critical' WHEN eta >= 0.06 THEN 'Important' WHEN eta >= 0.02 THEN 'Moderate' ELSE 'Low' END"
TOTAL = "t AS (SELECT avg(mean_iou) AS mu, sum((mean_iou - (SELECT avg(mean_iou) FROM v_sets)) ** 2) AS total FROM v_sets)"
INFLUENCE = (
    MOM
    + f""", {TOTAL}, i AS (SELECT parameter, count(*) AS n_values, CASE WHEN any_value(total) <= 1e-15 THEN 0 ELSE least(1, greatest(0, sum(n * (s / n - mu) ** 2) / any_value(total))) END AS eta, max(s / n) - min(s / n) AS w FROM v, t GROUP BY 1),
  c AS (SELECT *, {CLASS} AS influence FROM i)"""
)


@query(f"WITH {INFLUENCE} SELECT parameter, CAST(n_values AS BIGINT) AS n_values, {MICRO.format('eta')} AS eta_e6, {MICRO.format('w')} AS range_e6, influence FROM c")
def q_influence(spark, d):
    return I.influence(V.v_sets(spark, d), V.SET_DIMS).select("parameter", "n_values", _micro(F.col("eta_squared")).alias("eta_e6"), _micro(F.col("mean_range")).alias("range_e6"), "influence")


@query(f"WITH {MOM}, r AS (SELECT *, floor(s / n * 1e6 + 0.5) AS m FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY s / n DESC, value) AS place FROM r) SELECT parameter, place, value, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS mean_e6 FROM k WHERE place <= 3")
def q_best_values(spark, d):
    return I.best_values(V.v_sets(spark, d), V.SET_DIMS).select("parameter", "place", "value", "n", _micro(F.col("mean_iou")).alias("mean_e6"))


INTERACTIONS = f"""WITH {V.SETS}, {TOTAL}, one AS (SELECT p, sum(n * (a - mu) ** 2) / any_value(total) AS eta FROM (
    SELECT 'nation' AS p, count(*) AS n, avg(mean_iou) AS a FROM v_sets GROUP BY nation UNION ALL SELECT 'step', count(*), avg(mean_iou) FROM v_sets GROUP BY step UNION ALL SELECT 'rich', count(*), avg(mean_iou) FROM v_sets GROUP BY rich), t GROUP BY 1),
  two AS (SELECT p, q, sum(n * (a - mu) ** 2) / any_value(total) AS joint FROM (
    SELECT 'nation' AS p, 'step' AS q, count(*) AS n, avg(mean_iou) AS a FROM v_sets GROUP BY nation, step UNION ALL SELECT 'nation', 'rich', count(*), avg(mean_iou) FROM v_sets GROUP BY nation, rich
    UNION ALL SELECT 'step', 'rich', count(*), avg(mean_iou) FROM v_sets GROUP BY step, rich), t GROUP BY 1, 2)
SELECT least(two.p, two.q) AS first, greatest(two.p, two.q) AS second, {MICRO.format('joint')} AS joint_e6, {MICRO.format('greatest(0, joint - greatest(x.eta, y.eta))')} AS interaction_e6 FROM two JOIN one x ON x.p = two.p JOIN one y ON y.p = two.q"""


@query(INTERACTIONS)
def q_interactions(spark, d):
    i = I.interactions(V.v_sets(spark, d), V.SET_DIMS)
    return i.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), _micro(F.col("joint")).alias("joint_e6"), _micro(F.col("interaction")).alias("interaction_e6"))


@query(f"WITH {INFLUENCE}, l AS (SELECT n_values, CASE influence WHEN 'Critical' THEN 4 WHEN 'Important' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Low' THEN 1 WHEN 'Zombie' THEN -1 ELSE 0 END AS lv FROM c), tt(domain, k) AS (VALUES ('critical', 4), ('important_plus', 3), ('moderate_plus', 2), ('low_plus', 1), ('non_dormant', 1), ('exhaustive', -1)) SELECT domain, CAST(count(*) FILTER (lv >= k) AS BIGINT) AS n_parameters, CASE WHEN count(*) FILTER (lv >= k) = 0 THEN 0 ELSE CAST(round(product(CASE WHEN lv >= k THEN n_values ELSE 1 END)) AS BIGINT) END AS n_sets FROM l, tt GROUP BY domain")
def q_domain_counts(spark, d):
    return I.domain_counts(V.v_sets(spark, d), V.SET_DIMS)


@query(f"WITH {V.METRICS}, b AS (SELECT max(mean_iou) AS best FROM m) SELECT CAST(count(*) AS BIGINT) AS n_sets, max(best) AS best, quantile_cont(mean_iou, 0.25) AS q25, quantile_cont(mean_iou, 0.5) AS q50, quantile_cont(mean_iou, 0.75) AS q75, CAST(count(*) FILTER (best - mean_iou <= 0.001) AS BIGINT) AS near_best, CAST(count(*) FILTER (best - mean_iou <= 0.0001) AS BIGINT) AS equivalent FROM m, b")
def q_landscape(spark, d):
    return I.landscape(M.set_metrics(V.v_eval(spark, d), ["set_id"]))


@query(f"WITH {V.METRICS}, b AS (SELECT max(mean_iou) AS best FROM m), x AS (SELECT DISTINCT set_id, size_class FROM v_eval) SELECT CAST(count(DISTINCT size_class) FILTER (best - mean_iou <= 0.001) AS BIGINT) AS near_values, CAST(count(DISTINCT size_class) AS BIGINT) AS all_values FROM x JOIN m USING (set_id), b")
def q_near_values(spark, d):
    e = V.v_eval(spark, d)
    return I.near_values(e, M.set_metrics(e, ["set_id"]), "set_id", "size_class")


@query(f"WITH {V.EVAL} SELECT page, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (status <> 'ok') AS BIGINT) AS n_failed, CAST(sum(iou) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS mean_iou, (max(iou) - min(iou)) / 100.0::DOUBLE AS iou_range FROM v_eval GROUP BY page")
def q_page_sensitivity(spark, d):
    return I.page_sensitivity(V.v_eval(spark, d))


@query(f"WITH {V.EVAL} SELECT detector, status, CAST(count(*) AS BIGINT) AS n, min(ms) AS min_ms, max(ms) AS max_ms, min(page) AS first_page FROM v_eval WHERE status <> 'ok' GROUP BY 1, 2")
def q_failure_reasons(spark, d):
    return I.failure_reasons(V.v_eval(spark, d))


# order
RUN = f"WITH {V.OBS}, r AS (SELECT *, max(wall) OVER (PARTITION BY detector ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM v_obs)"


@query(RUN + " SELECT detector, event_id, wall, prev_best FROM r WHERE prev_best IS NULL OR wall > prev_best")
def q_record_history(spark, d):
    return O.record_history(V.v_obs(spark, d), ["detector"], "event_id", "wall")


@query(RUN + " SELECT detector, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (prev_best IS NULL OR wall > prev_best) AS BIGINT) AS n_records, max(event_id) FILTER (prev_best IS NULL OR wall > prev_best) AS last_record FROM r GROUP BY 1")
def q_improvement_counts(spark, d):
    r = O.running_best(V.v_obs(spark, d), ["detector"], "event_id", "wall")
    new = F.col("prev_best").isNull() | (F.col("wall") > F.col("prev_best"))
    return r.groupBy("detector").agg(F.count("*").alias("n"), F.count(F.when(new, 1)).alias("n_records"), F.max(F.when(new, F.col("event_id"))).alias("last_record"))


@query(RUN + ", g AS (SELECT *, prev_best IS NULL OR (wall - prev_best) * 100 > 1.0::DOUBLE * prev_best AS ok FROM r), l AS (SELECT detector, count(*) AS n, max(wall) AS best, max(event_id) FILTER (ok) AS last_gain FROM g GROUP BY 1) SELECT detector, CAST(n AS BIGINT) AS n, best, last_gain, CAST((SELECT count(*) FROM v_obs o WHERE o.detector = l.detector AND o.event_id > l.last_gain) AS BIGINT) AS since_gain, (SELECT count(*) FROM v_obs o WHERE o.detector = l.detector AND o.event_id > l.last_gain) >= 3 AS stop FROM l")
def q_plateau(spark, d):
    return O.plateau(V.v_obs(spark, d), ["detector"], "event_id", "wall")


@query(f"WITH {V.OBS}, p AS (SELECT *, lag(pipelines) OVER (PARTITION BY runner ORDER BY event_id) AS prev FROM v_obs) SELECT runner, event_id, pipelines, CASE WHEN prev IS NOT NULL THEN greatest(pipelines - prev, 0) END AS delta FROM p")
def q_counter_delta(spark, d):
    return O.counter_delta(V.v_obs(spark, d).select("runner", "event_id", "pipelines"), ["runner"], "event_id", "pipelines")


@query(f"WITH {V.OBS}, p AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY ts DESC, event_id DESC) AS k FROM v_obs) SELECT detector, event_id, wall FROM p WHERE k <= 200")
def q_retention_topn(spark, d):
    return O.newest(V.v_obs(spark, d).select("detector", "event_id", "wall", "ts"), ["detector"], [F.col("ts").desc(), F.col("event_id").desc()], 200).select("detector", "event_id", "wall")


@query(f"WITH {V.OBS} SELECT runner, max(event_id) AS event_id, arg_max(wall, event_id) AS wall, arg_max(detector, event_id) AS detector FROM v_obs GROUP BY runner")
def q_latest(spark, d):
    return O.one_of(V.v_obs(spark, d).select("runner", "event_id", "wall", "detector"), ["runner"], F.col("event_id"))


UPSERT = f"WITH {V.OBS}, b AS (SELECT runner, pipelines, event_id, wall, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS b FROM v_obs), k AS (SELECT *, row_number() OVER (PARTITION BY runner, pipelines ORDER BY b DESC, event_id DESC) AS last, row_number() OVER (PARTITION BY runner, pipelines ORDER BY b, event_id) AS first FROM b)"


def _batches(spark, d):
    o = V.v_obs(spark, d).select("runner", "pipelines", "event_id", "wall")
    return o.where("event_id % 3 = 0"), o.where("event_id % 3 <> 0")


@query(UPSERT + " SELECT runner, pipelines, event_id, wall FROM k WHERE last = 1")
def q_upsert_last_wins(spark, d):
    return O.upsert(*_batches(spark, d), ["runner", "pipelines"], "event_id")


@query(UPSERT + " SELECT runner, pipelines, event_id, wall FROM k WHERE first = 1")
def q_first_wins(spark, d):
    return O.upsert(*_batches(spark, d), ["runner", "pipelines"], "event_id", last_wins=False)


@query(f"WITH {V.PROF}, w AS (SELECT vec_id, pos, sum(v) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s, count(v) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM v_prof) SELECT vec_id, CAST(pos AS INT) AS pos, CAST(s AS DOUBLE) / n AS smooth FROM w")
def q_moving_avg(spark, d):
    return O.moving_average(V.v_prof(spark, d), ["vec_id"], "pos", "v", 2).select("vec_id", "pos", "smooth")


@query(f"WITH {V.PROF}, q AS (SELECT vec_id, pos, pos - lag(pos) OVER (PARTITION BY vec_id ORDER BY pos) AS g FROM v_prof WHERE v > 0), i AS (SELECT *, sum(CASE WHEN g > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY pos) AS i FROM q), r AS (SELECT vec_id, i, min(pos) AS s, max(pos) AS l FROM i GROUP BY 1, 2), e AS (SELECT vec_id, s, CASE WHEN 63 - l <= 1 THEN 64 ELSE l + 1 END AS e FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e - s DESC, s) AS k FROM e) SELECT vec_id, CAST(s AS INT) AS start, CAST(e AS INT) AS \"end\", CAST(e - s AS INT) AS length FROM k WHERE k = 1")
def q_longest_run(spark, d):
    return O.longest_run(V.v_prof(spark, d), ["vec_id"], "pos", F.col("v") > 0, 1, 64)


@query(f"WITH {V.PROF} SELECT vec_id, max(v) AS peak, CAST(arg_min(pos, (-v) * 1000 + pos) AS INT) AS peak_pos, median(v) AS baseline, max(v) - median(v) AS prominence FROM v_prof GROUP BY vec_id")
def q_profile_peak(spark, d):
    p = V.v_prof(spark, d)
    return p.groupBy("vec_id").agg(F.max("v").alias("peak"), F.min_by("pos", -F.col("v") * 1000 + F.col("pos")).alias("peak_pos"), F.median("v").alias("baseline"), (F.max("v") - F.median("v")).alias("prominence"))


SWEEP = f"WITH {V.TASK}, e AS (SELECT lane, \"start\" AS t, 1 AS d FROM v_task UNION ALL SELECT lane, \"end\", -1 FROM v_task), s AS (SELECT lane, t, sum(d) AS d FROM e GROUP BY 1, 2), g AS (SELECT lane, CAST(sum(d) OVER (PARTITION BY lane ORDER BY t) AS BIGINT) AS active, lead(t) OVER (PARTITION BY lane ORDER BY t) - t AS span FROM s)"


@query(SWEEP + " SELECT lane, active, CAST(sum(span) AS BIGINT) AS time FROM g WHERE span IS NOT NULL AND active > 0 GROUP BY 1, 2")
def q_sweep_line(spark, d):
    return O.sweep_line(V.v_task(spark, d), ["lane"], "start", "end")


@query(f"WITH {V.TASK} SELECT lane, CAST(count(*) AS BIGINT) AS n, CAST(sum(\"end\" - \"start\") AS BIGINT) AS busy, CAST(max(\"end\") - min(\"start\") AS BIGINT) AS span, CAST(sum(\"end\" - \"start\") AS DOUBLE) / nullif(CAST(max(\"end\") - min(\"start\") AS DOUBLE), 0) AS utilization FROM v_task GROUP BY lane")
def q_worker_util(spark, d):
    busy, span = F.sum(F.col("end") - F.col("start")), F.max("end") - F.min("start")
    return V.v_task(spark, d).groupBy("lane").agg(F.count("*").alias("n"), busy.alias("busy"), span.alias("span"), F.try_divide(busy.cast("double"), span.cast("double")).alias("utilization"))


HIST = "WITH h AS (SELECT lang, least(CAST(floor(n_chars / 16) AS BIGINT), 255) AS value, count(*) AS n FROM documents GROUP BY 1, 2)"


def _hist(spark, d):
    return V.table(spark, d, "documents").groupBy("lang", F.least(F.floor(F.col("n_chars") / 16).cast("long"), F.lit(255).cast("long")).alias("value")).agg(F.count("*").alias("n"))


@query(HIST + ", c AS (SELECT lang, value, sum(n) OVER (PARTITION BY lang ORDER BY value) AS cum, sum(n) OVER (PARTITION BY lang) AS t FROM h) SELECT lang, min(value) AS percentile FROM c WHERE cum >= t * 0.9::DOUBLE GROUP BY lang")
def q_histogram_percentile(spark, d):
    return O.nearest_rank(_hist(spark, d), ["lang"], "value", 0.9)


@query(HIST + ", t AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM h) SELECT lang, CAST(floor(-sum(p * log2(p)) * 1e6 + 0.5) AS BIGINT) AS entropy_e6 FROM t GROUP BY lang")
def q_entropy(spark, d):
    return O.entropy(_hist(spark, d), ["lang"]).select("lang", _micro(F.col("entropy")).alias("entropy_e6"))


# evidence
@query(f"WITH {V.OBS} SELECT detector, pipelines, CAST(count(*) AS BIGINT) AS n, min(wall) AS fastest, median(wall) AS median, arg_max(wall, event_id) AS latest, (array_agg(event_id ORDER BY wall, event_id))[1] AS fastest_id FROM v_obs GROUP BY 1, 2")
def q_shape_summary(spark, d):
    return X.shape_summary(V.v_obs(spark, d), ["detector", "pipelines"], "wall", "event_id")


def _shapes(spark, d):
    s = X.shape_summary(V.v_obs(spark, d), ["detector", "pipelines"], "wall", "event_id")
    return s.withColumn("rate", F.floor(F.lit(100000.0) / (F.col("median") + 1)).cast("long"))


SHAPES = f"WITH {V.OBS}, s AS (SELECT detector, pipelines, count(*) AS n, CAST(floor(100000.0::DOUBLE / (median(wall) + 1)) AS BIGINT) AS rate FROM v_obs GROUP BY 1, 2)"


@query(SHAPES + ", k AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY rate DESC, pipelines NULLS LAST) AS k FROM s) SELECT detector, pipelines, CAST(n AS BIGINT) AS n, rate FROM k WHERE k = 1")
def q_best_shape(spark, d):
    return X.preferred(_shapes(spark, d).select("detector", "pipelines", "n", "rate"), ["detector"], F.col("rate"), ["pipelines"])


@query(SHAPES + ", b AS (SELECT detector, max(rate) AS b FROM s GROUP BY 1) SELECT detector, string_agg(CAST(pipelines AS VARCHAR), ',' ORDER BY pipelines) AS shapes FROM s JOIN b USING (detector) WHERE rate >= b * 0.98::DOUBLE GROUP BY detector")
def q_shape_range(spark, d):
    return X.near_best_shapes(_shapes(spark, d), ["detector"], "rate", "pipelines")


@query(f"WITH {V.OBS} SELECT detector, CAST(sum(pipelines) AS BIGINT) AS sum_pipelines, max(pipelines) AS peak_pipelines, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first, max(event_id) AS last FROM v_obs GROUP BY 1")
def q_gauge_summary(spark, d):
    return X.gauges(V.v_obs(spark, d), ["detector"], ["pipelines"], "event_id")


@query(f"WITH {V.OBS} SELECT runner, CASE WHEN min(detector) IS NULL THEN 'none' WHEN min(detector) = max(detector) THEN min(detector) ELSE 'mixed' END AS common FROM v_obs GROUP BY 1")
def q_common_value(spark, d):
    return X.common_value(V.v_obs(spark, d), ["runner"], "detector")


@query(f"WITH {V.OBS} SELECT runner, pipelines, CAST(count(*) AS BIGINT) AS n, max(event_id) AS newest, min(detector) AS detector FROM v_obs GROUP BY 1, 2 HAVING count(DISTINCT detector) = 1")
def q_coherent_profile(spark, d):
    return X.coherent(V.v_obs(spark, d), ["runner", "pipelines"], ["detector"], "event_id")


@query(f"WITH {V.OBS}, s AS (SELECT event_id, runner, CAST((CASE WHEN detector = 'click' THEN 64 ELSE 0 END) + (CASE WHEN pipelines >= 50 THEN 32 ELSE 0 END) + (CASE WHEN runner % 2 = 0 THEN 16 ELSE 0 END) AS BIGINT) AS score, concat_ws('+', CASE WHEN detector = 'click' THEN 'detector' END, CASE WHEN pipelines >= 50 THEN 'shape' END, CASE WHEN runner % 2 = 0 THEN 'runner' END) AS reasons FROM v_obs) SELECT runner, max(score * 1000000000 + event_id) % 1000000000 AS event_id, max(score) AS score, arg_max(reasons, score * 1000000000 + event_id) AS reasons FROM s GROUP BY runner")
def q_context_score(spark, d):
    s = X.context_score(V.v_obs(spark, d), [("detector", F.col("detector") == "click", 64), ("shape", F.col("pipelines") >= 50, 32), ("runner", F.pmod("runner", F.lit(2)) == 0, 16)])
    return O.one_of(s.select("runner", "event_id", "score", "reasons"), ["runner"], F.struct("score", "event_id"))


@query(f"WITH {V.OBS}, t AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS own, c_nationkey AS hw FROM customer), a AS (SELECT runner, min(wall) AS wall, (array_agg(event_id ORDER BY wall, event_id))[1] AS event_id FROM v_obs GROUP BY 1), b AS (SELECT pipelines, min(wall) AS wall, (array_agg(event_id ORDER BY wall, event_id))[1] AS event_id FROM v_obs GROUP BY 1) SELECT c_custkey, CAST(CASE WHEN a.wall IS NOT NULL THEN 1 WHEN b.wall IS NOT NULL THEN 2 ELSE 0 END AS BIGINT) AS tier, coalesce(a.wall, b.wall) AS wall, coalesce(a.event_id, b.event_id) AS event_id FROM t LEFT JOIN a ON own = a.runner LEFT JOIN b ON hw = b.pipelines")
def q_tiered_match(spark, d):
    t = V.table(spark, d, "customer").select("c_custkey", F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("c_custkey")).alias("own"), F.col("c_nationkey").alias("hw"))
    return X.tiered_match(t, V.v_obs(spark, d), "c_custkey", [("own", "runner"), ("hw", "pipelines")], ["wall", "event_id"], ["wall", "event_id"])


@query("SELECT c_custkey, c_acctbal, 'native' AS source FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT o_custkey, max(o_totalprice), 'orders' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey")
def q_fallback_union(spark, d):
    native = V.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal", F.lit("native").alias("source"))
    other = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")).withColumn("source", F.lit("orders"))
    return native.unionByName(other.join(native.select("c_custkey"), "c_custkey", "left_anti"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_anti_missing(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", "c_name").join(V.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def q_semi_completed(spark, d):
    return V.table(spark, d, "orders").join(V.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


ANCHORS = f"WITH {V.OBS}, a AS (SELECT detector, CAST(pipelines AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM v_obs WHERE pipelines % 10 = 0 GROUP BY 1, 2), t AS (SELECT DISTINCT detector, CAST(pipelines AS DOUBLE) AS pipelines FROM v_obs WHERE pipelines IS NOT NULL), r AS (SELECT detector, pipelines, max(x) FILTER (x <= pipelines) AS lo_x, arg_max(y, x) FILTER (x <= pipelines) AS lo_y, min(x) FILTER (x >= pipelines) AS hi_x, arg_min(y, x) FILTER (x >= pipelines) AS hi_y FROM t LEFT JOIN a USING (detector) GROUP BY 1, 2)"


def _anchors(spark, d):
    o = V.v_obs(spark, d)
    a = o.where("pipelines % 10 = 0").groupBy("detector", "pipelines").agg(F.count("*").alias("y"))
    return X.anchors(o.where("pipelines is not null").select("detector", "pipelines").distinct(), a, ["detector"], "pipelines", "pipelines", "y")


@query(ANCHORS + " SELECT *, coalesce(CASE WHEN lo_x = hi_x THEN lo_y END, lo_y + (hi_y - lo_y) * (pipelines - lo_x) / nullif(hi_x - lo_x, 0), lo_y, hi_y) AS predicted FROM r")
def q_asof_anchor(spark, d):
    return X.linear(_anchors(spark, d), "pipelines")


BEST = f"WITH {V.CAL}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (status = 'authoritative') DESC, CASE WHEN status = 'authoritative' THEN quality ELSE 0 END DESC, created DESC, build DESC) AS k FROM v_cal)"


@query(BEST + " SELECT grp, status, quality, created, build FROM k WHERE k = 1")
def q_best_record(spark, d):
    return X.best_record(V.v_cal(spark, d), ["grp"], F.col("status") == "authoritative", F.col("quality"), "created", "build")


@query(f"WITH {V.CAL} SELECT grp, arg_max(quality, created * 10000000 + build) AS latest FROM v_cal GROUP BY grp")
def q_latest_quality(spark, d):
    return V.v_cal(spark, d).groupBy("grp").agg(F.max_by("quality", F.struct("created", "build")).alias("latest"))


@query(f"WITH {V.CAL}, k AS (SELECT *, lag(build) OVER (PARTITION BY grp, status ORDER BY build) AS prev FROM v_cal) SELECT grp, status, build, coalesce(CAST(prev AS VARCHAR), 'new') AS previous FROM k")
def q_known_builds(spark, d):
    from pyspark.sql import Window

    prev = F.lag("build").over(Window.partitionBy("grp", "status").orderBy("build"))
    return V.v_cal(spark, d).select("grp", "status", "build", F.coalesce(prev.cast("string"), F.lit("new")).alias("previous"))


@query("WITH t AS (SELECT sha256(text) AS digest, doc_id FROM documents), g AS (SELECT digest, count(*) AS n, min(doc_id) AS first_id FROM t GROUP BY 1 HAVING count(*) > 1) SELECT digest, CAST(n AS BIGINT) AS n, first_id, printf('DUP-%04d', row_number() OVER (ORDER BY first_id)) AS label FROM g")
def q_duplicates(spark, d):
    return X.duplicate_groups(V.table(spark, d, "documents"), F.sha2("text", 256), "doc_id")


QUEUES = "WITH RECURSIVE s AS (SELECT s_nationkey, s_suppkey, CAST(trunc(abs(s_acctbal) + 1) AS BIGINT) AS est FROM supplier)"
#: Lists of tasks dealt to three lanes, one task a step.
LANES = """, r AS (SELECT s_nationkey, s_suppkey, est, k, 0 AS lane, CAST(0 AS BIGINT) AS start, est AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM t WHERE k = 1 UNION ALL
  SELECT t.s_nationkey, t.s_suppkey, t.est, t.k, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END, least(a, b, c), CASE WHEN a <= b AND a <= c THEN a + t.est ELSE a END, CASE WHEN NOT (a <= b AND a <= c) AND b <= c THEN b + t.est ELSE b END, CASE WHEN c < a AND c < b THEN c + t.est ELSE c END
  FROM r JOIN t ON t.s_nationkey = r.s_nationkey AND t.k = r.k + 1)"""


def _queues(spark, d):
    return V.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.abs(F.col("s_acctbal")) + 1).cast("long").alias("est"))


@query(QUEUES + ", t AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY est DESC) AS k FROM s)" + LANES + " SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n_tasks, max(start + est) AS makespan FROM r GROUP BY 1")
def q_lpt_makespan(spark, d):
    return K.makespan(_queues(spark, d), ["s_nationkey"], "est", 3)


@query(QUEUES + """, t AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM s), r AS (SELECT s_nationkey, s_suppkey, est, k, CAST(0 AS BIGINT) AS batch, est AS acc FROM t WHERE k = 1 UNION ALL
  SELECT t.s_nationkey, t.s_suppkey, t.est, t.k, CASE WHEN acc >= 8000 THEN batch + 1 ELSE batch END, CASE WHEN acc >= 8000 THEN t.est ELSE acc + t.est END FROM r JOIN t ON t.s_nationkey = r.s_nationkey AND t.k = r.k + 1) SELECT s_nationkey, s_suppkey, est, batch FROM r""")
def q_claim_batches(spark, d):
    return K.claim_batches(_queues(spark, d), ["s_nationkey"], ["s_suppkey"], "est", 8000)


@query("SELECT s_suppkey, s_suppkey % 4 AS shard FROM supplier")
def q_interleave(spark, d):
    return V.table(spark, d, "supplier").select("s_suppkey", F.pmod("s_suppkey", F.lit(4)).alias("shard"))


# boxes and labels
@query(f"WITH {V.BOX} SELECT l_orderkey, page, dx, dy, iou FROM box")
def q_box_iou(spark, d):
    b = V.v_box(spark, d)
    e = S.edge_errors(F.col("expected"), F.col("predicted"))
    return b.select("l_orderkey", "page", e[0].alias("dx"), e[1].alias("dy"), S.box_iou(F.col("expected"), F.col("predicted")).alias("iou"))


@query(f"WITH {V.BOX} SELECT CASE WHEN iou >= 0.8 AND worst <= 5 THEN 'pass' WHEN iou >= 0.6 AND worst <= 8 THEN 'near_pass' ELSE 'fail' END AS grade, CAST(count(*) AS BIGINT) AS n, min(iou) AS min_iou, max(worst) AS worst FROM box GROUP BY 1")
def q_box_grade(spark, d):
    b = V.v_box(spark, d).select(S.box_iou(F.col("expected"), F.col("predicted")).alias("iou"), F.array_max(S.edge_errors(F.col("expected"), F.col("predicted"))).alias("worst"))
    return b.groupBy(S.grade_box(F.col("iou"), F.col("worst"), 0.8, 5, 0.6, 8).alias("grade")).agg(F.count("*").alias("n"), F.min("iou").alias("min_iou"), F.max("worst").alias("worst"))


@query(f"WITH {V.BOX} SELECT page, CAST(count(*) AS BIGINT) AS n, median(iou) AS median_iou, CAST(sum(dx) AS BIGINT) AS sum_dx, CAST(sum(dy) AS BIGINT) AS sum_dy, CAST(max(worst) AS INT) AS worst FROM box GROUP BY page")
def q_box_summary(spark, d):
    e = S.edge_errors(F.col("expected"), F.col("predicted"))
    b = V.v_box(spark, d).select("page", S.box_iou(F.col("expected"), F.col("predicted")).alias("iou"), e.alias("e"))
    return b.groupBy("page").agg(F.count("*").alias("n"), F.median("iou").alias("median_iou"), F.sum(F.col("e")[0]).alias("sum_dx"), F.sum(F.col("e")[1]).alias("sum_dy"), F.max(F.array_max("e")).alias("worst"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'fail' WHEN l.quality IS NULL THEN 'skip' WHEN l.quality = 1 AND d.n_chars >= 300 THEN 'pass' ELSE 'near_pass' END AS grade FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_label_validation(spark, d):
    docs, labels = V.table(spark, d, "documents").select("doc_id", "n_chars"), V.table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    grade = F.when(F.col("there").isNull(), "fail").when(F.col("quality").isNull(), "skip").when((F.col("quality") == 1) & (F.col("n_chars") >= 300), "pass").otherwise("near_pass")
    return docs.join(labels, "doc_id", "left").select("doc_id", grade.alias("grade"))


# grids, digests, text
GRID = """g AS (SELECT row_number() OVER (ORDER BY supplier, line, flag) - 1 AS ordinal, supplier, line, flag
  FROM (SELECT DISTINCT s_suppkey AS supplier FROM supplier) a, (SELECT DISTINCT l_linenumber AS line FROM lineitem) b, (SELECT DISTINCT l_returnflag AS flag FROM lineitem) c)"""


def _domains(spark, d):
    return G.domains_of(supplier=V.table(spark, d, "supplier").select("s_suppkey"), line=V.table(spark, d, "lineitem").select("l_linenumber"), flag=V.table(spark, d, "lineitem").select("l_returnflag"))


@query(f"WITH {GRID} SELECT * FROM g")
def q_grid(spark, d):
    return G.product(spark, _domains(spark, d))


@query(f"WITH {GRID} SELECT ordinal, ordinal AS again FROM g")
def q_ordinal_round_trip(spark, d):
    domains = _domains(spark, d)
    return G.product(spark, domains).select("ordinal", G.encode(domains).alias("again"))


@query(f"WITH {GRID} SELECT supplier, line, min(ordinal) AS ordinal FROM g WHERE flag = 'N' GROUP BY 1, 2")
def q_pinned_filter(spark, d):
    return G.pinned(G.product(spark, _domains(spark, d)), {"flag": "N"}, ["supplier", "line"])


@query(f"WITH {GRID}, u AS (SELECT -l_orderkey - 1 AS ordinal, l_suppkey AS supplier, l_linenumber AS line, l_returnflag AS flag FROM lineitem UNION ALL SELECT * FROM g) SELECT supplier, line, flag, CAST(min(ordinal) AS BIGINT) AS ordinal FROM u GROUP BY 1, 2, 3")
def q_ordered_union(spark, d):
    """Sets that lines name come before the grid's."""
    named = V.table(spark, d, "lineitem").select((-F.col("l_orderkey") - 1).alias("ordinal"), F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    return named.unionByName(G.product(spark, _domains(spark, d))).groupBy("supplier", "line", "flag").agg(F.min("ordinal").alias("ordinal"))


def _params(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.concat(F.lit('"'), "p_brand", F.lit('"'))).alias("m"))


JSON = "'{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}'"


@query(f"SELECT p_partkey, {JSON} AS json FROM part")
def q_canonical_json(spark, d):
    return _params(spark, d).select("p_partkey", S.canonical_json(F.col("m")).alias("json"))


@query(f"SELECT p_partkey, sha256({JSON}) AS digest, sha256({JSON})[1:12] AS id FROM part")
def q_ids(spark, d):
    return _params(spark, d).select("p_partkey", S.parameter_digest(F.col("m")).alias("digest")).withColumn("id", F.left("digest", F.lit(12)))


@query("SELECT sha256('{\"brand\":\"' || p_brand || '\",\"size\":\"*\"}') AS family, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def q_family_ids(spark, d):
    return _params(spark, d).groupBy(S.family_digest(F.col("m"), ["size"]).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, nullif(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug, trim(regexp_replace(lower(p_type), '\\s+', ' ', 'g')) AS plain FROM part")
def q_slug(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"), S.collapsed(F.col("p_type")).alias("plain"))


@query("WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS s FROM orders) SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM s")
def q_duration(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", S.duration(F.col("o_totalprice") / 10).alias("duration"))


@query("SELECT c_custkey, list_aggregate(list_transform(regexp_extract_all(lower(c_name), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), 'string_agg', '') AS key FROM customer")
def q_natural_sort(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", S.natural_key(F.col("c_name")).alias("key"))


@query("SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS epoch FROM events")
def q_iso_epoch(spark, d):
    return V.table(spark, d, "events").select("event_id", S.iso_epoch(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("epoch"))


@query("SELECT doc_id, CAST(least(100, (CASE WHEN n_chars >= 300 THEN 40 ELSE 0 END) + (CASE WHEN contains(text, '|') THEN 0 ELSE 30 END) + least(30, n_chars // 100)) AS BIGINT) AS score FROM documents")
def q_quality_score(spark, d):
    n = F.col("n_chars")
    return V.table(spark, d, "documents").select("doc_id", F.least(F.lit(100), F.when(n >= 300, 40).otherwise(0) + F.when(F.col("text").contains("|"), 0).otherwise(30) + F.least(F.lit(30), F.floor(n / 100))).cast("long").alias("score"))


PLAN = f"WITH {V.OBS}, p AS (SELECT event_id, wall, pipelines, CASE event_id % 4 WHEN 0 THEN 'large' WHEN 1 THEN ' SMALL ' WHEN 2 THEN '32t' ELSE 'other' END AS label, 5 + CAST(event_id % 20 AS INT) AS cpus FROM v_obs), t AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 64 WHEN 1 THEN 16 WHEN 2 THEN 2 * cpus ELSE least(16, cpus) END AS budget FROM p)"


@query(PLAN + ", s AS (SELECT *, wall * 60 AS serial, list_max(list_filter([1, 2, 4, 8, 16, 32, 48, 64], lambda x: x <= least(CASE WHEN wall < 5 THEN 1 WHEN wall < 15 THEN 4 WHEN wall < 30 THEN 8 ELSE budget END, budget))) AS threads FROM t) SELECT event_id, budget, greatest(1, budget // greatest(1, pipelines)) AS each, threads, CAST(greatest(1, least(least(96, greatest(1, pipelines)), ceil(serial * 1.2::DOUBLE / greatest(1, sqrt(threads)) / 1800))) AS BIGINT) AS shards, least(pipelines + 1, greatest(1, CAST(round_even(sqrt(pipelines + 1), 0) AS INT)), greatest(1, budget // 48)) AS workers FROM s")
def q_planning(spark, d):
    label = F.when(F.col("event_id") % 4 == 0, "large").when(F.col("event_id") % 4 == 1, " SMALL ").when(F.col("event_id") % 4 == 2, "32t").otherwise("other")
    o = V.v_obs(spark, d).withColumn("budget", P.runner_threads(label, F.lit(5) + (F.col("event_id") % 20).cast("int"), {"large": 64, "small": 16}))
    serial = F.col("wall") * 60
    o = o.withColumn("threads", P.automatic_threads(serial, F.col("budget")))
    return o.select("event_id", "budget", P.pipeline_threads(F.col("budget"), F.col("pipelines")).alias("each"), "threads", P.shards(serial, F.col("threads"), F.col("pipelines")).alias("shards"), P.queue_workers(F.col("pipelines") + 1, F.col("budget")).alias("workers"))


@query(f"WITH {V.OBS} SELECT runner, coalesce(least(1.25, greatest(0.75, median(wall / 100))), 1.0) AS correction FROM v_obs GROUP BY runner")
def q_correction(spark, d):
    return V.v_obs(spark, d).groupBy("runner").agg(P.correction(F.col("wall") / 100).alias("correction"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, least(1.0, CASE WHEN l_returnflag = 'A' THEN least(0.25, q) ELSE q END)) AS score FROM (SELECT *, (CASE WHEN l_linestatus = 'O' THEN s - 0.08::DOUBLE ELSE s END) AS q FROM (SELECT *, greatest(0.0, 1 - abs(l_quantity * 5 - 185) / 150) * 0.22::DOUBLE + greatest(0.0, least(1.0, l_quantity / 60)) * 0.30::DOUBLE + greatest(0.0, least(1.0, l_quantity / 35)) * 0.30::DOUBLE + greatest(0.0, least(1.0, l_tax / 0.28::DOUBLE)) * 0.18::DOUBLE AS s FROM lineitem))")
def q_page_quality(spark, d):
    q = F.col("l_quantity")
    score = P.quality(q * 5, q, q, F.col("l_tax"), F.col("l_linestatus") == "O", F.col("l_returnflag") == "A")
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"))


# verdicts and matches
TARGETS = f"WITH {V.OBS}, o AS (SELECT *, event_id % 2 AS kind FROM v_obs), t AS (SELECT c_custkey, c_custkey AS own, c_nationkey AS size, CASE WHEN c_custkey % 3 = 0 THEN 'click' END AS detector, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 END AS kind FROM customer), j AS (SELECT c_custkey, 1 AS tier, wall, event_id FROM t JOIN o ON own = runner AND coalesce(t.detector, o.detector) = o.detector AND coalesce(t.kind, o.kind) = o.kind UNION ALL SELECT c_custkey, 2, wall, event_id FROM t JOIN o ON size = pipelines AND coalesce(t.detector, o.detector) = o.detector AND coalesce(t.kind, o.kind) = o.kind), k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, wall, event_id) AS k FROM j)"


@query(TARGETS + " SELECT c_custkey, CAST(coalesce(tier, 0) AS BIGINT) AS tier, wall, event_id FROM t LEFT JOIN (SELECT c_custkey, tier, wall, event_id FROM k WHERE k = 1) USING (c_custkey)")
def q_verified_predictions(spark, d):
    c = F.col("c_custkey")
    t = V.table(spark, d, "customer").select("c_custkey", c.alias("own"), F.col("c_nationkey").alias("size"), F.when(c % 3 == 0, "click").alias("detector"), F.when(c % 5 != 0, c % 2).alias("kind"))
    return E.wildcard_match(t, V.v_obs(spark, d).withColumn("kind", F.col("event_id") % 2), "c_custkey", ["detector", "kind"], [("own", "runner"), ("size", "pipelines")], ["wall", "event_id"], ["wall", "event_id"])


@query(f"WITH {V.CAL}, k AS (SELECT build, CASE WHEN status = 'provisional' THEN 'smoke' WHEN build % 3 = 0 THEN 'exhaustive' ELSE 'powers-of-2' END AS kind, CASE build % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' END AS rating FROM v_cal) SELECT kind, rating, CASE WHEN kind = 'smoke' OR rating IS NULL THEN 'Provisional' WHEN kind <> 'exhaustive' OR rating = 'Low' THEN 'Candidate' WHEN rating = 'High' THEN 'Approved' ELSE 'Recommended' END AS level, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1, 2, 3")
def q_approval(spark, d):
    b = F.col("build")
    k = V.v_cal(spark, d).select(E.search_type(F.col("status"), b % 3 == 0, F.lit("powers_of_2")).alias("kind"), F.when(b % 4 == 0, "High").when(b % 4 == 1, "Medium").when(b % 4 == 2, "Low").alias("rating"))
    return k.groupBy("kind", "rating", E.approval(F.col("kind"), F.col("rating")).alias("level")).agg(F.count("*").alias("n"))


@query(f"WITH {V.OBS}, p AS (SELECT event_id, CAST(pipelines AS BIGINT) AS done, 80 AS possible, wall, CASE WHEN event_id % 3 = 0 THEN wall / 8 END AS rate FROM v_obs) SELECT event_id, CASE WHEN done IS NULL THEN 'unavailable' WHEN done / 100.0::DOUBLE < 0.1::DOUBLE THEN 'early' WHEN done / 100.0::DOUBLE <= 0.4::DOUBLE THEN 'moderate' WHEN done / 100.0::DOUBLE <= 0.8::DOUBLE THEN 'late' ELSE 'unstable' END AS class, least(1.0::DOUBLE, done / 80.0::DOUBLE) AS share, CASE WHEN done >= 80 THEN 0.0::DOUBLE WHEN rate > 0 THEN (80 - done) * 5 / rate WHEN done > 0 AND wall > 0 THEN (80 - done) * wall / done END AS eta FROM p")
def q_search_progress(spark, d):
    done = F.col("pipelines").cast("long")
    share, eta = E.progress(done, F.lit(80), F.col("wall"), F.when(F.col("event_id") % 3 == 0, F.col("wall") / 8), F.lit(5))
    return V.v_obs(spark, d).select("event_id", E.stabilisation(done / 100.0).alias("class"), share.alias("share"), eta.alias("eta"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN printf('%.2f pg/s', p_size / 4.0::DOUBLE) WHEN p_size >= 4 THEN printf('%.3f pg/s', p_size / 4.0::DOUBLE) ELSE printf('%.4f pg/s', p_size / 4.0::DOUBLE) END AS rate, CASE WHEN p_size % 4 = 3 OR p_partkey = 0 THEN NULL ELSE p_size END AS pipelines, CASE WHEN p_size % 4 = 3 OR p_partkey = 0 THEN NULL ELSE p_partkey END AS threads FROM part WHERE p_size <> 40")
def q_texts_of_shapes(spark, d):
    p = V.table(spark, d, "part").where("p_size <> 40")
    form = F.when(F.col("p_size") % 4 == 0, F.format_string(" %dP / %dT", "p_size", "p_partkey")).when(F.col("p_size") % 4 == 1, F.format_string("%d/%d", "p_size", "p_partkey")).when(F.col("p_size") % 4 == 2, F.format_string("%dpx%d", "p_size", "p_partkey")).otherwise(F.format_string("%d-%d", "p_size", "p_partkey"))
    s = E.manual_shape(form)
    return p.select("p_partkey", E.rate_text(F.col("p_size") / 4.0).alias("rate"), s["pipelines"].alias("pipelines"), s["threads"].cast("long").alias("threads"))


@query("SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'R') THEN 'error' WHEN bool_or(l_returnflag = 'R') THEN 'partial' ELSE 'complete' END AS status FROM lineitem GROUP BY 1")
def q_page_status(spark, d):
    return V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(E.page_status(F.when(F.col("l_returnflag") == "R", "error").otherwise("ok")).alias("status"))


DETECTORS = f"WITH {V.EVAL}, m AS (SELECT detector, {V.MOMENTS}, count(*) / sum(ms) AS page_rate FROM v_eval GROUP BY detector)"


@query(DETECTORS + " SELECT detector, mean_iou, n_failed, row_number() OVER (ORDER BY mean_iou DESC, min_iou DESC, n_failed, std_iou, page_rate DESC, detector) AS rank FROM m")
def q_detector_rank(spark, d):
    from pyspark.sql import Window

    e = V.v_eval(spark, d)
    m = M.set_metrics(e, ["detector"]).join(e.groupBy("detector").agg((F.count("*") / F.sum("ms")).alias("page_rate")), "detector")
    return m.select("detector", "mean_iou", "n_failed", F.row_number().over(Window.orderBy(*E.detector_order(m, "detector"))).cast("long").alias("rank"))  # detectors are few


@query(f"WITH {V.METRICS}, r AS (SELECT set_id, row_number() OVER (ORDER BY {V.ORDER}) AS rank FROM m) SELECT set_id, rank FROM r WHERE (rank - 1) % 3 = 0")
def q_stride_sample(spark, d):
    r = M.search_rank(M.set_metrics(V.v_eval(spark, d), ["set_id"]), F.lit(True), ["set_id"])
    return r.where((F.col("rank") - 1) % 3 == 0).select("set_id", "rank")


@query(f"WITH {V.OBS} SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS completion_index, row_number() OVER (ORDER BY ts, event_id) / CAST(count(*) OVER () AS DOUBLE) AS fraction FROM v_obs")
def q_completion_order(spark, d):
    o = V.v_obs(spark, d).select("event_id", F.unix_micros("ts").alias("at"))
    n = O.numbered(o, "at", [F.col("at").asc(), F.col("event_id").asc()], {"completion_index": F.lit(1)})
    return n.crossJoin(F.broadcast(o.agg(F.count("*").alias("_n")))).select("event_id", "completion_index", (F.col("completion_index") / F.col("_n").cast("double")).alias("fraction"))  # one row


MADE = """SELECT o_custkey AS runner, 'g' || CAST(o_orderkey % 4 AS STRING) AS dataset, CASE WHEN o_orderkey % 10 = 9 THEN 'full' ELSE 'short' END AS workload, CASE WHEN o_orderkey % 30 <> 0 THEN 1 + o_orderkey % 40 END AS detectors,
  o_orderkey % 9 AS workers, 100 * (o_orderkey % 8) AS budget, CAST(floor(o_totalprice / 1000) AS BIGINT) AS makespan, CAST(o_orderkey % 11 AS DOUBLE) / 16 AS utilization, CAST(floor(o_totalprice / 1000) AS BIGINT) * (o_orderkey % 3) / 4 AS tail, o_orderkey AS seen FROM {orders}"""
WANTED = "SELECT c_custkey AS id, c_custkey AS runner, 'g' || CAST(c_custkey % 6 AS STRING) AS dataset, 1 + c_custkey % 30 AS detectors, 50 * (c_custkey % 20) AS budget FROM {customer}"
SCHEDULES = f"""WITH {V.cte("o", MADE)}, {V.cte("t", WANTED)}, r AS (SELECT runner, dataset, greatest(1, coalesce(detectors, 1)) AS n, workers, budget AS b, makespan, utilization - 0.35 * least(1, tail / makespan) AS busy, utilization, tail, seen FROM o WHERE workload = 'short' AND workers > 0 AND budget > 0 AND makespan > 0),
  j AS (SELECT t.id, t.detectors, t.budget, r.*, CASE WHEN t.dataset = r.dataset AND t.runner = r.runner THEN 1 WHEN t.dataset = r.dataset THEN 2 WHEN t.runner = r.runner THEN 3 ELSE 4 END AS tier FROM t, r),
  k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, floor(abs(ln(detectors / n)) * 1e9), makespan, -busy, seen) AS k FROM j),
  w AS (SELECT *, CASE WHEN utilization >= 0.9 AND tail / makespan <= 0.15 THEN workers + 1 WHEN workers > 1 AND (utilization < 0.68 OR tail / makespan >= 0.35) THEN workers - 1 ELSE workers END AS fw FROM k WHERE k = 1),
  x AS (SELECT *, greatest(1, round_even(greatest(1, budget) / greatest(48, b / fw), 0)) AS by_budget FROM w)"""


@query(SCHEDULES + " SELECT id, tier, n AS observed, seen, CAST(least(detectors, greatest(1, greatest(1, budget) // 48), greatest(1, round_even(by_budget * sqrt(detectors / n), 0))) AS INT) AS workers FROM x")
def q_schedule_evidence(spark, d):
    s = E.schedule_evidence(V.shared(spark, d, WANTED), V.shared(spark, d, MADE), "id")
    after = P.feedback_workers(F.col("workers"), F.col("utilization"), E.tail_fraction(F.col("tail"), F.col("makespan")))
    return s.select("id", "tier", "observed", "seen", E.scaled_workers(F.col("detectors"), F.col("budget"), F.col("observed"), F.col("seen_budget"), after).alias("workers"))


@query(f"WITH {V.OBS}, s AS (SELECT runner, count(DISTINCT pipelines) AS n FROM v_obs WHERE pipelines >= 95 GROUP BY 1), r AS (SELECT DISTINCT runner FROM v_obs) SELECT runner, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'low' WHEN n = 2 THEN 'moderate' ELSE 'high' END AS readiness FROM r LEFT JOIN s USING (runner)")
def q_coverage(spark, d):
    o = V.v_obs(spark, d)
    return o.groupBy("runner").agg(E.readiness(F.count_distinct(F.when(F.col("pipelines") >= 95, F.col("pipelines")))).alias("readiness"))


@query(f"WITH {V.OBS} SELECT pipelines AS size, CAST(count(*) AS BIGINT) AS n, median(runner) AS pipelines, median(least(1.0::DOUBLE, event_id / CAST(pipelines AS DOUBLE))) AS fraction FROM v_obs WHERE pipelines > 0 GROUP BY 1")
def q_size_anchors(spark, d):
    return E.size_anchors(V.v_obs(spark, d).select(F.col("pipelines").alias("size"), F.col("runner").alias("p"), F.col("event_id").alias("a")), "size", "p", "a")


RESOLVE = "WITH k AS (SELECT sha256(CAST(p_partkey AS VARCHAR)) AS digest, p_partkey % 3 AS source, p_brand AS brand FROM part), w AS (SELECT c_custkey, upper(left(sha256(CAST(c_custkey AS VARCHAR)), CASE WHEN c_custkey % 4 = 0 THEN 11 ELSE CAST(12 + c_custkey % 50 AS INT) END)) AS wanted FROM customer)"


@query(RESOLVE + " SELECT wanted, digest, CAST(source AS BIGINT) AS source, brand FROM w JOIN k ON starts_with(digest, lower(wanted)) WHERE length(wanted) >= 12")
def q_resolve_ids(spark, d):
    known = V.table(spark, d, "part").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("digest"), (F.col("p_partkey") % 3).alias("source"), F.col("p_brand").alias("brand"))
    c = F.col("c_custkey")
    w = V.table(spark, d, "customer").select(F.upper(F.left(F.sha2(c.cast("string"), 256), F.when(c % 4 == 0, 11).otherwise(12 + c % 50).cast("int"))).alias("wanted"))
    return E.resolved(w, "wanted", known, "digest", "source")


@query(f"WITH {V.TASK} SELECT lane, CAST(count(*) AS BIGINT) AS n_parts, CAST(max(\"end\") - 700000000 AS BIGINT) AS elapsed, CAST(sum(\"end\" - \"start\") AS BIGINT) AS serial, CAST(sum(\"end\" - \"start\") AS DOUBLE) / CAST(max(\"end\") - 700000000 AS DOUBLE) AS acceleration FROM v_task GROUP BY 1")
def q_merged_totals(spark, d):
    t = V.v_task(spark, d).select("lane", (F.col("start") - 700000000).alias("offset"), (F.col("end") - F.col("start")).alias("elapsed"))
    return E.merged_totals(t, ["lane"], "offset", "elapsed")


@query("WITH h AS (SELECT lang, n_chars AS v, sum(1 + doc_id % 4) AS w FROM documents GROUP BY 1, 2), c AS (SELECT lang, v, sum(w) OVER (PARTITION BY lang ORDER BY v) AS c, sum(w) OVER (PARTITION BY lang) AS t FROM h) SELECT lang, min(v) AS percentile FROM c WHERE c >= t * 0.9::DOUBLE GROUP BY 1")
def q_weighted_percentile(spark, d):
    return E.weighted_percentile(V.table(spark, d, "documents").select("lang", "n_chars", (1 + F.col("doc_id") % 4).alias("w")), ["lang"], "n_chars", "w", 0.9)


@query(f"WITH {V.OBS} SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE wall <= 50 END, true) AS expired FROM v_obs")
def q_leases(spark, d):
    return V.v_obs(spark, d).select("event_id", E.lease_expired(F.when(F.col("event_id") % 7 == 0, "corrupt").otherwise(F.col("wall").cast("string")), F.lit(50)).alias("expired"))


@query(QUEUES + ", t AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM s)" + LANES + " SELECT s_nationkey, s_suppkey, est, CAST(lane AS BIGINT) AS lane, start FROM r")
def q_lanes(spark, d):
    return K.lanes(_queues(spark, d), ["s_nationkey"], ["s_suppkey"], "est", 3)


# streams and detectors: rows only, tests hold them against the batch forms and the drawn boxes
def _drained(spark, d, make, mode):
    """The rows of a stream over the whole events table: appended ones through files, the few of other modes through the driver's memory."""
    import uuid

    from .source_queries import _scratch

    stream = spark.readStream.schema(V.table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    if mode == "append":
        rows, place = make(stream), _scratch(spark)
        q = rows.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{place}-state").trigger(availableNow=True).start(place)
        q.awaitTermination()
        return spark.read.schema(rows.schema).parquet(place)
    name = f"stream_{uuid.uuid4().hex}"
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query(RUN + " SELECT detector AS key, event_id AS seq, wall AS value FROM r WHERE prev_best IS NULL OR wall > prev_best")
def q_stream_running_best(spark, d):
    from ..streaming import live

    return _drained(spark, d, lambda s: live.running_best(s.select("event_type", "event_id", "value"), "event_type", "event_id", "value"), "append").select("key", "seq", "value")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, max(value) AS peak FROM events GROUP BY 1, 2")
def q_stream_gauges(spark, d):
    from ..streaming import live

    return _drained(spark, d, lambda s: live.gauges(s, "ts", "event_type", "value"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "peak")


LEASES = """WITH RECURSIVE e AS (SELECT user_id AS k, event_type AS who, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT k, n, who, us, who AS holder, us + 21600000000 AS ends, 'claimed' AS what, NULL::VARCHAR AS gone, NULL::BIGINT AS gone_at FROM e WHERE n = 1
  UNION ALL SELECT e.k, e.n, e.who, e.us, CASE WHEN ends <= e.us OR holder = e.who THEN e.who ELSE holder END, CASE WHEN ends <= e.us OR holder = e.who THEN e.us + 21600000000 ELSE ends END,
    CASE WHEN ends <= e.us THEN 'claimed' WHEN holder = e.who THEN 'renewed' ELSE 'refused' END, CASE WHEN ends <= e.us THEN holder END, CASE WHEN ends <= e.us THEN ends END FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1)
SELECT k AS key, who AS owner, what, us AS at FROM r UNION ALL SELECT k, gone, 'expired', gone_at FROM r WHERE gone IS NOT NULL
UNION ALL SELECT k, arg_max(holder, n), 'expired', arg_max(ends, n) FROM r GROUP BY k HAVING arg_max(ends, n) // 1000 < (SELECT max(us) // 1000 - 86400000 FROM e)"""


@query(LEASES)
def q_stream_leases(spark, d):
    """Events as requests of their type for the lease of a user, for six hours."""
    from ..streaming import live

    return _drained(spark, d, lambda s: live.leases(s, "user_id", "event_type", "ts", 6 * 3600), "append").select("key", "owner", "what", "at")


PAGES = "p AS (SELECT o_orderkey AS page_id, CAST(3 + o_custkey % 20 AS INT) AS l, CAST(2 + o_orderkey % 15 AS INT) AS t, CAST(30 + o_custkey % 31 AS INT) AS r, CAST(22 + o_orderkey % 23 AS INT) AS b FROM orders)"


def _drawn(rows, page: str, other: str, scale: int = 1):
    """Rows as pages with a box each, which two numbers place."""
    from ..operators import detect

    k, c = F.col(page), F.col(other)
    box = F.transform(F.array(3 + c % 20, 2 + k % 15, 30 + c % 31, 22 + k % 23), lambda x: (x * scale).cast("int"))
    return detect.drawn(rows.select(k.alias("page_id"), box.alias("expected")), 48 * scale, 64 * scale)


def _detectors(spark, d):
    """Two detectors of a caller's on orders as pages: one that finds what is bright, one that fails on pages whose box starts at the third column."""
    from ..operators import detect

    def bright(image, p):
        on = image > p.get("least", 100)
        ys, xs = (on.any(a).nonzero()[0] for a in (1, 0))
        return ([xs[0], ys[0], xs[-1] + 1, ys[-1] + 1], 1.0) if len(ys) else None

    def odd(image, p):
        box, score = bright(image, p)
        if box[0] == 3:
            raise ValueError("a page like this has no name")
        return box, score

    detect.register("bright", "least")(bright)
    detect.register("odd")(odd)
    try:
        sets = spark.createDataFrame([("bright", "{}"), ("bright", '{"least": 250}'), ("odd", None), ("absent", "{}")], "method string, parameters string")
        return detect.detect(_drawn(V.table(spark, d, "orders"), "o_orderkey", "o_custkey"), sets)
    finally:
        del detect.REGISTRY["bright"], detect.REGISTRY["odd"]


SETS = "s AS (SELECT * FROM (VALUES ('bright', '{}'), ('bright', '{\"least\": 250}'), ('odd', NULL), ('absent', '{}')) s(method, parameters)), f AS (SELECT *, CASE WHEN method = 'absent' OR (method = 'odd' AND l = 3) THEN 'error' WHEN parameters = '{\"least\": 250}' THEN 'no_candidate' ELSE 'ok' END AS status FROM p, s)"


@query(f"WITH {PAGES}, {SETS} SELECT page_id, method, parameters, status, CASE WHEN status = 'ok' THEN l || ',' || t || ',' || r || ',' || b END AS box FROM f")
def q_udf_detector(spark, d):
    return _detectors(spark, d).select("page_id", "method", "parameters", "status", F.array_join(F.col("box").cast("array<string>"), ",").alias("box"))


@query(f"WITH {PAGES}, {SETS} SELECT method, count(*) AS n, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_error FROM f GROUP BY method")
def q_udtf_multi(spark, d):
    from ..operators import detect

    return detect.method_summary(_detectors(spark, d))


@query()
def q_page_analysis(spark, d):
    from ..operators import pages

    return pages.analyse(_drawn(V.table(spark, d, "supplier"), "s_suppkey", "s_nationkey", 4)).select("page_id", "box", "score", "status", "skew", "entropy")


@query()
def q_document_boxes(spark, d):
    from ..operators import pages

    return pages.detect_document(_drawn(V.table(spark, d, "supplier"), "s_suppkey", "s_nationkey", 4), "projection_box", longest=200).select("page_id", "status", "box")
