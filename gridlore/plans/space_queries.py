"""Queries of parameter spaces, shape resolution and scalar functions, and the SQL that each equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import space as Z
from . import views as V
from .registry import query

#: Specifications: five parameters a detector, the fifth a zombie.
SPEC = "SELECT DISTINCT p_brand AS detector, 'p' || CAST(p_size % 5 AS STRING) AS name, CAST(4 - p_size % 5 AS INT) AS pos, CAST(CAST(floor(p_size / 5) AS INT) AS STRING) AS value, CAST(floor(p_size / 5) AS INT) AS ord, p_size % 5 = 4 AS zombie FROM {part}"
COUNTS = f"WITH {V.cte('s', SPEC)}, n AS (SELECT detector, name, pos, zombie, count(*) AS n, string_agg(value, ',' ORDER BY ord) AS vals FROM s GROUP BY ALL)"


@query(COUNTS + " SELECT detector, CAST(round(product(CASE WHEN zombie THEN 1 ELSE n END)) AS BIGINT) AS live, CAST(round(product(n)) AS BIGINT) AS with_zombies, CASE WHEN detector LIKE '%1' THEN CAST(round(product(n)) AS BIGINT) WHEN detector LIKE '%2' THEN CAST(round(product(CASE WHEN zombie THEN 1 ELSE n END)) AS BIGINT) END AS effective, coalesce(string_agg(name, ',' ORDER BY name) FILTER (zombie), '') AS zombies FROM n GROUP BY detector")
def q_space_contracts(spark, d):
    strategy = F.when(F.col("detector").like("%1"), "exhaustive-with-zombies").when(F.col("detector").like("%2"), "exhaustive").otherwise("random")
    return Z.contracts(V.shared(spark, d, SPEC), strategy).drop("strategy")


@query(COUNTS + " SELECT detector, CAST(round(product(CASE WHEN name IN ('p1', 'p4') THEN n ELSE 1 END)) AS BIGINT) AS family_size FROM n GROUP BY detector")
def q_family_sizes(spark, d):
    return Z.family_sizes(V.shared(spark, d, SPEC), ["p1", "p4"])


@query(COUNTS + """ SELECT detector, sha256('{"order":[' || string_agg('"' || name || '"', ',' ORDER BY pos) || '],"values":{' || string_agg('"' || name || '":[' || vals || ']', ',' ORDER BY name) || '}}') AS digest, CAST(round(product(n)) AS BIGINT) AS n_sets FROM n WHERE NOT zombie GROUP BY detector""")
def q_grid_digests(spark, d):
    return Z.grid_digests(V.shared(spark, d, SPEC))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS same FROM customer")
def q_same_keys(spark, d):
    k = F.col("c_custkey")
    a = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2))
    return V.table(spark, d, "customer").select(k, Z.same_keys(a, F.create_map(F.lit("y"), F.lit(5), F.when(k % 3 == 0, "x").otherwise("z"), F.lit(7))).alias("same"))


PARAMS = "'{\"a\":' || c_nationkey % 5 || ',\"b\":' || c_custkey % 4 || '}'"


def _sets(spark, d):
    m = F.create_map(F.lit("a"), (F.col("c_nationkey") % 5).cast("string"), F.lit("b"), (F.col("c_custkey") % 4).cast("string"))
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), m.alias("parameters")).withColumn("digest", S.parameter_digest(F.col("parameters")))


@query(f"""WITH p AS (SELECT c_custkey AS id, c_nationkey % 5 AS a, c_custkey % 4 AS b, sha256({PARAMS}) AS digest FROM customer), g AS (SELECT k AS build FROM range(0, 6) t(k))
SELECT id, 'g' || build AS build FROM p, g WHERE a <= build AND b <= 3 - build % 2 UNION SELECT id, 'e' || id2 % 7 FROM p JOIN (SELECT c_custkey AS id2, sha256({PARAMS}) AS d2 FROM customer WHERE c_custkey < 30) ON digest = d2""")
def q_memberships(spark, d):
    s = _sets(spark, d)
    explicit = s.where("id < 30").select(F.concat(F.lit("e"), (F.col("id") % 7).cast("string")).alias("build"), "digest")
    k = spark.range(6).select(F.col("id").alias("k"))
    domain = lambda name, top: k.select(F.concat(F.lit("g"), F.col("k").cast("string")).alias("build"), F.lit(name).alias("name"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), top), lambda x: x.cast("string"))).alias("value"))
    grids = domain("a", F.col("k")).unionByName(domain("b", 3 - F.col("k") % 2))
    # a grid with another parameter too holds none of these sets
    grids = grids.unionByName(grids.where("build = 'g5'").withColumn("build", F.lit("h5"))).unionByName(spark.createDataFrame([("h5", "c", "1")], "build string, name string, value string"))
    return Z.memberships(s, explicit, grids)


BUILDS = f"WITH {V.cte('e', V.ENTRIES)}, b AS (SELECT detector, dataset, CASE WHEN id % 50 = 0 THEN 'manual' ELSE build END AS build, created FROM e)"


@query(BUILDS + ", o AS (SELECT detector, dataset, build, max(created) AS created FROM b GROUP BY 1, 2, 3) SELECT detector, dataset, build, created, row_number() OVER (PARTITION BY detector, dataset ORDER BY build = '17' DESC, coalesce(try_cast(build AS INT), -1) DESC, created DESC) AS place FROM o")
def q_family_builds(spark, d):
    e = V.shared(spark, d, V.ENTRIES).select("detector", "dataset", F.when(F.col("id") % 50 == 0, "manual").otherwise(F.col("build")).alias("build"), "created")
    return Z.known_builds(e, ["detector", "dataset"], "build", "created", F.col("build") == "17")


@query(f"WITH {V.cte('e', V.ENTRIES)}, f AS (SELECT 'records/' || p_partkey AS record, sha256(CAST(p_size AS VARCHAR)) AS x, sha256(p_brand) AS y FROM part WHERE p_partkey % 3 = 0) SELECT DISTINCT detector, build, digest FROM (SELECT detector, build, x AS digest FROM e JOIN f USING (record) WHERE status <> 'provisional' UNION ALL SELECT detector, build, y FROM e JOIN f USING (record) WHERE status <> 'provisional')")
def q_provenance_index(spark, d):
    files = V.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("records/"), F.col("p_partkey").cast("string")).alias("record"), F.array(F.sha2(F.col("p_size").cast("string"), 256), F.sha2("p_brand", 256)).alias("digests"))
    return Z.provenance_index(V.shared(spark, d, V.ENTRIES), files)


@query("SELECT p_brand AS detector, CAST(count(*) AS BIGINT) AS evaluated, CAST(count(*) FILTER (p_size % 4 > 0) AS BIGINT) AS on_grid, CAST(count(DISTINCT p_size) FILTER (p_size % 4 = 0) AS BIGINT) AS beside FROM part GROUP BY 1")
def q_provenance_coverage(spark, d):
    return Z.coverage(V.table(spark, d, "part").select(F.col("p_brand").alias("detector"), F.sha2(F.col("p_size").cast("string"), 256).alias("digest"), F.when(F.col("p_size") % 4 > 0, F.col("p_size")).alias("ordinal")))


@query("""SELECT p_partkey, left(sha256(j), 12) AS id, sha256('d1' || chr(31) || '2' || chr(31) || j) AS identity, left(CASE WHEN p_partkey % 2 = 0 THEN repeat('f', 64) ELSE sha256('{"brand":"' || p_brand || '","size":"*"}') END, 12) AS family FROM (SELECT *, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS j FROM part)""")
def q_identities(spark, d):
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.concat(F.lit('"'), "p_brand", F.lit('"')))
    stored = F.when(F.col("p_partkey") % 2 == 0, F.lit("f" * 64))
    p = V.table(spark, d, "part").withColumn("m", m)
    return p.select("p_partkey", F.left(S.parameter_digest(F.col("m")), F.lit(12)).alias("id"), S.identity_digest(F.lit("d1"), F.lit("2"), F.col("m")).alias("identity"), F.left(F.coalesce(stored, S.family_digest(F.col("m"), ["size"])), F.lit(12)).alias("family"))


@query(f"""WITH {V.cte('e', V.ENTRIES)} SELECT id, sha256('{{"dataset":"' || dataset || '","detector":"' || detector || '","variant":' || CASE WHEN variant IS NULL OR variant LIKE '%_current' THEN 'null' ELSE '"' || variant || '"' END || '}}') AS key FROM e""")
def q_compatibility_keys(spark, d):
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    e = V.shared(spark, d, V.ENTRIES)
    context = F.create_map(F.lit("variant"), F.when(~F.col("variant").endswith("_current"), q("variant")), F.lit("dataset"), q("dataset"), F.lit("detector"), q("detector"))
    return e.select("id", S.compatibility_key(context).alias("key"))


AUDIT = "WITH c AS (SELECT p_brand AS detector, CAST(p_partkey AS VARCHAR) AS name, p_size % 3 > 0 AS live, p_size % 3 <> 1 AS zombie, p_size % 4 AS n_values, CASE WHEN p_partkey % 3 > 0 THEN '1' END AS pinned, p_partkey % 5 > 0 AS known, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE 'r' END AS reason, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 's' END AS scope, p_partkey % 9 > 0 AS base FROM part), x AS (SELECT *, CASE WHEN NOT zombie THEN [] WHEN live THEN [name || ': also live'] WHEN n_values = 0 THEN [name || ': values'] ELSE list_filter([CASE WHEN pinned IS NULL THEN name || ': pinned_value' END, CASE WHEN pinned IS NOT NULL AND NOT known THEN name || ': pinned_outside' END, CASE WHEN trim(reason) = '' THEN name || ': reason' END, CASE WHEN scope IS NULL THEN name || ': audit_scope' END, CASE WHEN NOT base THEN name || ': baseline' END], lambda e: e IS NOT NULL) END AS errors FROM c), g AS (SELECT detector, list_sort(flatten(list(errors))) AS errors, count(*) FILTER (live) AS n_live, count(*) FILTER (zombie) AS n_zombies, count(*) FILTER (live AND n_values = 1) AS n_single FROM x GROUP BY 1)"


@query(AUDIT + " SELECT detector, n_live, n_zombies, n_single, CAST(len(errors) AS BIGINT) AS n_errors, coalesce(array_to_string(errors, '; '), '') AS errors FROM g")
def q_space_audit(spark, d):
    k, x = F.col("p_partkey"), F.col("p_size")
    c = V.table(spark, d, "part").select(
        F.col("p_brand").alias("detector"), k.cast("string").alias("name"), (x % 3 > 0).alias("live"), (x % 3 != 1).alias("zombie"), (x % 4).alias("n_values"), F.when(k % 3 > 0, "1").alias("pinned"), (k % 5 > 0).alias("pinned_known"),
        F.when(k % 7 == 0, " ").otherwise("r").alias("reason"), F.when(k % 8 != 0, "s").alias("scope"), (k % 9 > 0).alias("in_baseline"),
    )
    return Z.audit(c)


# shapes to try
LEGAL = "WITH p AS (SELECT p_partkey AS id, CAST(1 + p_partkey % 5 AS INT) AS low, p_size AS high, CAST(8 * (1 + p_partkey % 9) AS INT) AS budget, CAST(1 + p_partkey % 4 AS INT) AS least, p_partkey % 10 = 0 AS beyond FROM part), l AS (SELECT *, CASE WHEN beyond THEN high ELSE least(high, budget // least) END AS top FROM p), g AS (SELECT *, list_filter(range(low, top + 1), lambda x: true) AS legal FROM l)"


@query(LEGAL + " SELECT id, coalesce(array_to_string(legal, ','), '') AS legal, coalesce(array_to_string(list_sort(list_distinct(list_concat(CASE WHEN len(legal) > 0 THEN [low, top] ELSE [] END, list_filter([1, 2, 4, 8, 16, 32, 64], lambda x: x >= low AND x <= top)))), ','), '') AS doubling, coalesce(array_to_string(list_filter(legal, lambda x: budget % x = 0), ','), '') AS divisors FROM g")
def q_shapes_to_try(spark, d):
    k = F.col("p_partkey")
    p = V.table(spark, d, "part").select(k.alias("id"), (1 + k % 5).cast("int").alias("low"), F.col("p_size").alias("high"), (8 * (1 + k % 9)).cast("int").alias("budget"), (1 + k % 4).alias("least"), (k % 10 == 0).alias("beyond"))
    p = p.withColumn("_legal", Z.legal_pipelines(F.col("low"), F.col("high"), F.col("budget"), F.col("least"), F.col("beyond")))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return p.select("id", text(F.col("_legal")).alias("legal"), text(Z.doubling(F.col("_legal"))).alias("doubling"), text(Z.divisors(F.col("_legal"), F.col("budget"))).alias("divisors"))


# resolving shapes
WORKFLOW = """WITH q AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'manual' WHEN 2 THEN NULL ELSE ' Preferred' END AS mode, CASE WHEN o_orderkey % 7 = 0 THEN 'smoke' ELSE 'full' END AS regression, CASE WHEN o_orderkey % 11 = 0 THEN 'random' ELSE 'exhaustive' END AS strategy,
  CASE WHEN o_orderkey % 13 = 0 THEN '20' END AS lim, o_orderkey % 3 = 0 AS several, 8 * (o_orderkey % 9) AS budget, o_orderkey % 29 = 0 AS g, o_orderkey % 4 > 0 AS m, o_orderkey % 2 = 0 AS u, o_orderkey % 6 < 2 AS e, o_orderkey % 8 < 5 AS p FROM orders),
  s AS (SELECT *, regression <> 'full' OR strategy <> 'exhaustive' OR lim IS NOT NULL AS short FROM q), c AS (SELECT *, CASE WHEN g THEN 'preferred-dispatch' WHEN mode IS NULL OR mode = 'auto' THEN 'auto' WHEN mode = 'manual' AND m THEN 'manual' WHEN mode = 'manual' THEN 'error-no-manual-shape'
  WHEN several AND short AND u THEN 'preferred-multidetector' WHEN several AND short THEN 'auto-fallback-no-multidetector-history' WHEN short THEN 'auto-fallback-incompatible-workload' WHEN several THEN 'auto-fallback-all-full-exhaustive' WHEN e THEN 'preferred-measured' WHEN p THEN 'predicted' ELSE 'auto-fallback-no-shape-history' END AS src FROM s),
  x AS (SELECT id, budget, src, CASE src WHEN 'preferred-dispatch' THEN 2 WHEN 'manual' THEN 4 WHEN 'preferred-multidetector' THEN 3 WHEN 'preferred-measured' THEN 8 WHEN 'predicted' THEN 1 END AS pipelines, CASE src WHEN 'preferred-dispatch' THEN 4 WHEN 'manual' THEN 8 WHEN 'preferred-multidetector' THEN 16 WHEN 'preferred-measured' THEN 2 WHEN 'predicted' THEN 5 END AS threads FROM c)"""


@query(WORKFLOW + " SELECT id, coalesce(pipelines * threads <= budget, false) AS exact, pipelines, threads, CASE WHEN pipelines * threads > budget THEN 'error-beyond-budget' ELSE src END AS source FROM x")
def q_workflow_shapes(spark, d):
    k = F.col("o_orderkey")
    shape = lambda p, t, hit: F.when(hit, F.struct(F.lit(p).alias("pipelines"), F.lit(t).alias("threads")))
    q = V.table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 5 == 0, "auto").when(k % 5 == 1, "manual").when(k % 5 > 2, " Preferred").alias("mode"), F.when(k % 7 == 0, "smoke").otherwise("full").alias("regression"), F.when(k % 11 == 0, "random").otherwise("exhaustive").alias("strategy"),
        F.when(k % 13 == 0, "20").alias("limit"), (k % 3 == 0).alias("several"), (8 * (k % 9)).alias("budget"), shape(2, 4, k % 29 == 0).alias("given"), shape(4, 8, k % 4 > 0).alias("manual"), shape(3, 16, k % 2 == 0).alias("multi"), shape(8, 2, k % 6 < 2).alias("measured"), shape(1, 5, k % 8 < 5).alias("predicted"),
    )
    return Z.workflow_shape(q).select("id", "exact", F.col("pipelines"), F.col("threads"), "source")


DISPATCH = f"""WITH {V.cte("r", V.RUNS)}, t AS (SELECT n_nationkey AS target, CASE n_nationkey % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' ELSE 'error' END AS detector, 'g' || n_nationkey % 5 AS dataset, 'c' || n_nationkey % 3 AS config, n_nationkey % 7 > 0 AS pref FROM nation),
  j AS (SELECT target, r.*, actual / wall AS rate, pipelines * threads AS allocated FROM t JOIN r USING (detector, dataset) WHERE pref AND source = 'execution-optimizer' AND mode = 'full' AND strategy = 'exhaustive' AND actual = possible AND wall > 0 AND (r.config = '' OR r.config = t.config) AND (r.dimension IS NULL OR r.dimension = 1800)),
  b AS (SELECT target, pipelines AS p, threads AS th, rate AS rt, allocated AS al FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round_even(rate, 2) DESC, allocated, pipelines, threads, wall, id) AS k FROM j) WHERE k = 1),
  w AS (SELECT target, runner, p, th, al, greatest(CASE WHEN runner = 'r1' THEN 2 ELSE 8 END, al) AS budget, row_number() OVER (PARTITION BY target ORDER BY runner IN ('r2', 'r5'), id) AS k FROM j JOIN b USING (target) WHERE pipelines = p AND threads = th AND rate = rt)"""


@query(DISPATCH + " SELECT target, coalesce(runner, 'asked') AS runner, runner IS NOT NULL AS exact, p AS pipelines, th AS threads, al AS allocated, budget, CASE WHEN runner IS NOT NULL THEN 'preferred-dispatch' WHEN pref THEN 'requested-runner-no-preferred-history' ELSE 'requested-runner' END AS source FROM t LEFT JOIN (SELECT * FROM w WHERE k = 1) USING (target)")
def q_preferred_dispatch(spark, d):
    from .observation_queries import TARGETS

    t = V.shared(spark, d, TARGETS).withColumns({"preferred": F.col("target") % 7 > 0, "requested": F.lit("asked"), "dimension": F.lit(1800)})
    r = V.shared(spark, d, V.RUNS).withColumn("hosted", F.col("runner").isin("r2", "r5"))
    return Z.dispatch(t, r, "target", F.when(F.col("runner") == "r1", 2).otherwise(8))


PREDICTED = """WITH e AS (SELECT CAST(c_nationkey % 7 AS INT) AS grp, CAST(4 * (1 + c_custkey % (1 + c_nationkey % 7)) AS INT) AS cpus, 1 + c_custkey % 9 AS pipelines, (1 + c_custkey % 8) / 8.0::DOUBLE AS fraction FROM customer), a AS (SELECT grp, CAST(cpus AS DOUBLE) AS x, median(pipelines) AS y, median(fraction) AS f, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY cpus) AS k FROM e GROUP BY grp, cpus),
  t AS (SELECT DISTINCT grp, c AS cpus FROM e, (VALUES (2), (4), (6), (16), (18), (40)) v(c)), l AS (SELECT grp, cpus, (SELECT max(k) FROM a WHERE a.grp = t.grp AND x <= cpus) AS lo, (SELECT min(k) FROM a WHERE a.grp = t.grp AND x >= cpus) AS hi, (SELECT max(k) FROM a WHERE a.grp = t.grp) AS n FROM t),
  r AS (SELECT *, CASE WHEN n = 1 THEN 'single-anchor' WHEN lo IS NULL THEN 'extrapolated-below' WHEN hi IS NULL THEN 'extrapolated-above' WHEN lo < hi THEN 'interpolated' ELSE 'same-size' END AS relation, CASE WHEN lo IS NULL THEN 1 WHEN hi IS NULL THEN greatest(n - 1, 1) ELSE lo END AS i, CASE WHEN lo IS NULL THEN least(2, n) WHEN hi IS NULL THEN n ELSE hi END AS j FROM l),
  g AS (SELECT r.*, p.x AS x1, p.y AS y1, p.f AS f1, q.x AS x2, q.y AS y2, q.f AS f2 FROM r JOIN a p ON p.grp = r.grp AND p.k = i JOIN a q ON q.grp = r.grp AND q.k = j),
  s AS (SELECT *, CASE WHEN x1 < x2 THEN ln(y2 / y1) / ln(x2 / x1) END AS slope FROM g),
  y AS (SELECT *, CASE relation WHEN 'single-anchor' THEN y1 * cpus / x1 WHEN 'same-size' THEN y1 WHEN 'interpolated' THEN y1 * pow(cpus / x1, slope) WHEN 'extrapolated-below' THEN y1 * pow(cpus / x1, least(1, greatest(0, slope))) ELSE y2 * pow(cpus / x2, least(1, greatest(0, slope))) END AS est,
    CASE relation WHEN 'interpolated' THEN f1 + (cpus - x1) / (x2 - x1) * (f2 - f1) WHEN 'extrapolated-above' THEN f2 ELSE f1 END AS frac FROM s),
  z AS (SELECT *, greatest(1, CAST(round_even(est, 0) AS INT)) AS want, CAST(2 * cpus AS INT) AS budget FROM y), u AS (SELECT *, least(budget, greatest(1, CAST(round_even(budget * least(1, greatest(0.05, frac)), 0) AS INT))) AS alloc FROM z),
  v AS (SELECT *, greatest(1, CAST(round_even(alloc / want, 0) AS INT)) AS each FROM u)"""


@query(PREDICTED + " SELECT grp, cpus, least(want, budget) AS pipelines, CASE WHEN want * each > budget THEN greatest(1, budget // want) ELSE each END AS threads, relation, CASE WHEN n >= 3 AND lo IS NOT NULL AND hi IS NOT NULL THEN 'high' WHEN n >= 2 THEN 'moderate' ELSE 'low' END AS confidence FROM v")
def q_predicted_shapes(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    e = V.table(spark, d, "customer").select((n % 7).cast("int").alias("grp"), (4 * (1 + k % (1 + n % 7))).cast("int").alias("cpus"), (1 + k % 9).alias("pipelines"), ((1 + k % 8) / 8.0).alias("fraction"))
    t = e.select("grp", F.explode(F.array(*map(F.lit, (2, 4, 6, 16, 18, 40)))).alias("cpus"))
    return Z.predicted_shape(t, e, ["grp"], "cpus")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'a,b' WHEN p_size % 5 = 1 THEN 'self-hosted,Linux,big' WHEN p_size % 5 = 2 THEN 'self-hosted,' || p_brand ELSE 'ubuntu-latest' END AS labels FROM part")
def q_runner_labels(spark, d):
    x = F.col("p_size") % 5
    labels = F.when(x == 0, F.array(F.lit(" a"), F.lit(" "), F.lit("b"))).when(x == 1, F.array(F.lit("  ")))
    label = F.when(x == 1, " big ").when(x == 2, F.col("p_brand")).when(x == 3, "unknown")
    return V.table(spark, d, "part").select("p_partkey", F.array_join(Z.runner_labels(labels, label, {"big": ["self-hosted", "Linux", "big"]}, ["ubuntu-latest"]), ",").alias("labels"))


@query("""SELECT p_partkey, 'runs_on=["self-hosted","' || p_brand || '"]' || chr(10) || 'budget=' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END || chr(10) || 'exact=' || CASE WHEN p_size > 9 THEN '1' ELSE '0' END AS env FROM part""")
def q_dispatch_text(spark, d):
    fields = {"runs_on": F.to_json(F.array(F.lit("self-hosted"), "p_brand")), "budget": F.when(F.col("p_size") % 2 == 0, F.col("p_size")), "exact": (F.col("p_size") > 9).cast("int")}
    return V.table(spark, d, "part").select("p_partkey", Z.environment_text(fields).alias("env"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Page Frame' WHEN 1 THEN 'Line Fit' ELSE 'Other Way 2' END AS friendly, CASE p_size % 3 WHEN 0 THEN 'PF' WHEN 1 THEN 'LF' ELSE 'other_way_2' END AS short, CASE p_size % 3 WHEN 0 THEN 'Generator' WHEN 1 THEN 'Refiner' ELSE 'Unknown' END AS role, CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_partkey % 2 = 0 THEN 'v_current' ELSE 'v_old' END AS variant FROM part")
def q_characterised(spark, d):
    x = F.col("p_size") % 3
    name = F.when(x == 0, "page_frame").when(x == 1, "line_fit").otherwise("other_way_2")
    known = spark.createDataFrame([("page_frame", "Page Frame", "PF", "Generator"), ("line_fit", "Line Fit", "LF", "Refiner")], "detector string, friendly string, short string, role string")
    p = V.table(spark, d, "part").select("p_partkey", name.alias("detector"))
    variant = Z.model_variant(F.when(F.col("detector") == "other_way_2", "other").otherwise("masks"), F.when((F.col("p_partkey") % 2 == 0) | (F.col("detector") == "other_way_2"), " Default").otherwise("V_old"), {"masks": "v_current"}, {"v_current": "masks", "v_old": "masks"})
    return Z.characterised(p.select("detector").distinct(), known).join(p, "detector").withColumn("variant", variant).select("p_partkey", "friendly", "short", "role", "variant")


# scalar functions
@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, CAST(floor(least(l_discount * 100 - 2, l_quantity + 0.5)) AS INT)) AS x0, least(40, CAST(ceil(greatest(l_discount * 100 - 2, l_quantity + 0.5)) AS INT)) AS x1, least(1.0, 20 / greatest(l_quantity, 7.0)) AS scale,
  least(greatest(CAST(round_even(l_linenumber * 2.5::DOUBLE, 0) AS INT), 0), 9) AS clamped, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 5 END AS first FROM lineitem""")
def q_box_functions(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    points = F.array(F.array(F.col("l_discount") * 100 - 2, q * 0 + 3.2), F.array(q + 0.5, q * 0 + 8.9))
    box = S.box_of_points(points, F.lit(40), F.lit(12))
    none = F.array(F.lit(5), F.lit(None).cast("int"), F.lit(9), F.lit(9))
    first = S.first_box(F.when(F.col("l_returnflag") == "R", F.array(*map(F.lit, (1, 2, 3, 4)))), none, F.array(*map(F.lit, (5, 6, 7, 8))))
    clamped = S.clamp_box(F.array(n, n, n, n).cast("array<double>"), F.lit(2.5), F.lit(9), F.lit(9))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box[0].alias("x0"), box[2].alias("x1"), S.downscale(q, F.lit(7.0), F.lit(20)).alias("scale"), clamped[0].alias("clamped"), first[0].alias("first"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS x, CASE WHEN p_size % 2 = 0 THEN NULL ELSE 2.0::DOUBLE END AS y, '0,0;' || (10 + p_size) || ',1;' || (9 + p_size) || ',12;1,11' AS corners FROM part")
def q_corners(spark, d):
    x = F.col("p_size").cast("double")
    a = F.array(F.lit(1.0), F.lit(0.0), x)
    b = F.when(F.col("p_size") % 2 == 0, F.array(F.lit(2.0), F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(3.0), F.lit(6.0)))
    cross = S.crossing(a, b)
    points = F.array(F.array(9 + x, F.lit(12.0)), F.array(F.lit(1.0), F.lit(11.0)), F.array(10 + x, F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0)))
    text = F.array_join(F.transform(S.corners_in_order(points), lambda p: F.concat_ws(",", p[0].cast("int").cast("string"), p[1].cast("int").cast("string"))), ";")
    return V.table(spark, d, "part").select("p_partkey", cross[0].alias("x"), cross[1].alias("y"), text.alias("corners"))


@query("""SELECT p_partkey, printf('%.4f', p_size / 8.0::DOUBLE) AS number, CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE printf('%.1f%%', p_size * 12.5::DOUBLE) END AS share, left(p_name, 5) AS short, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 THEN p_type ELSE left(p_name, 12) END AS name,
  CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE p_type END || CASE WHEN p_size % 2 = 0 THEN ' — ' || p_brand ELSE '' END || CASE WHEN p_size % 7 > 0 THEN ' (' || p_size % 7 || ' vCPU)' ELSE '' END AS title, regexp_replace(p_name, '[^a-zA-Z0-9_.-]', '_', 'g') AS safe FROM part""")
def q_report_texts(spark, d):
    x = F.col("p_size")
    title = S.runner_title(F.when(x % 5 == 0, "").otherwise(F.col("p_type")), F.when(x % 2 == 0, F.col("p_brand")).otherwise(F.lower(F.when(x % 5 == 0, "UNKNOWN").otherwise(F.col("p_type")))), x % 7)
    return V.table(spark, d, "part").select(
        "p_partkey", S.decimal_text((x / 8.0).cast("string")).alias("number"), S.percent_text(F.when(x % 3 == 0, "none").otherwise((x / 8.0).cast("string"))).alias("share"), S.short_text(F.col("p_name"), 5).alias("short"),
        S.short_name(F.when(x % 4 == 0, F.col("p_brand")), F.when(x % 4 == 1, F.col("p_type")), F.col("p_name")).alias("name"), title.alias("title"), S.safe_name(F.col("p_name")).alias("safe"),
    )


@query("""SELECT doc_id, 'a' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '<d>' || lang || '</d>' ELSE '' END || 'tail' AS cut, CASE WHEN doc_id % 2 = 0 THEN 'run-' || doc_id END AS run FROM documents""")
def q_sections(spark, d):
    k = F.col("doc_id")
    inner = F.concat(F.lit("<d>M one <d>two</d> <d><d>x</d></d> three</d>"), F.lit("tail"))
    text = F.concat(F.lit("a\n"), F.when(k % 3 == 0, F.concat(F.lit("<d>"), "lang", F.lit("</d>tail"))).otherwise(inner))
    run = S.found_id(F.concat(F.lit("Optimizer run: `"), F.when(k % 2 == 0, F.concat(F.lit("run-"), k.cast("string"))).otherwise(" "), F.lit("`")), "run: `([^`]*)`")
    return V.table(spark, d, "documents").select("doc_id", S.without_section(text, "<d>", "</d>", "M").alias("cut"), run.alias("run"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text, epoch_us(ts) + 2500000 AS later, epoch_us(ts) + event_id AS micros, event_id % 2 = 0 AS valid FROM events")
def q_time_functions(spark, d):
    t = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise("not a time")
    e = V.table(spark, d, "events")
    return e.select("event_id", S.utc_text(t).alias("text"), F.unix_micros(S.shifted(t, F.lit(2.5))).alias("later"), F.unix_micros(S.shifted(t, None, F.col("event_id"))).alias("micros"), F.try_to_timestamp(text).isNotNull().alias("valid"))


@query("""SELECT p_partkey, printf('%.6g', p_retailprice / 7) AS number, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE p_name END AS other, CASE WHEN p_size % 3 = 0 THEN '{"a":{"x":"1"}}' ELSE '{"a":{"x":"1","y":"' || p_size || '"},"b":{"z":"0"}}' END AS merged, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS fields FROM part""")
def q_json_functions(spark, d):
    x = F.col("p_size")
    one = F.create_map(F.lit("a"), F.create_map(F.lit("x"), F.when(x % 3 == 0, "1").otherwise("7")))
    two = F.create_map(F.lit("a"), F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), x.cast("string")), F.lit("b"), F.create_map(F.lit("z"), F.lit("0")))
    none = F.create_map().cast("map<string,map<string,string>>")
    merged = F.to_json(S.merged_json(one, F.when(x % 3 == 0, none).otherwise(two)))
    shown = S.displayed(F.when(x % 2 == 0, "true").otherwise(F.concat(F.lit('"'), "p_name", F.lit('"'))))
    return V.table(spark, d, "part").select("p_partkey", S.displayed((F.col("p_retailprice") / 7).cast("string")).alias("number"), shown.alias("other"), merged.alias("merged"), F.size(S.defaulted(F.when(x % 4 == 0, F.create_map(F.lit("k"), F.lit("v"))))).alias("fields"))


@query("SELECT c_custkey, left(sha256('{\"cpu_model\":\"m\",\"labels\":\"a,b\",\"logical_cpu_count\":' || c_nationkey || ',\"runner_label\":\"' || c_mktsegment || '\",\"runner_name\":null}'), 16) AS key FROM customer")
def q_runner_keys(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", S.runner_key(F.col("c_mktsegment"), F.lit(None).cast("string"), F.array(F.lit("b"), F.lit("a")), F.lit("m"), F.col("c_nationkey")).alias("key"))
