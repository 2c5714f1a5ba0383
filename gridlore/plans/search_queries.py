"""Queries of searches that go step by step: next shapes, refinement, ancestry, boxes that grow."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import ancestry as A
from ..operators import evidence as E
from ..operators import search as S
from . import views as V
from .registry import query

PROBES = f"""WITH {V.OBS}, g AS (SELECT DISTINCT runner, detector, 1 + runner % 6 AS low, least(8 + runner % 60, (24 + runner % 41) // (1 + runner % 2)) AS up, 24 + runner % 41 AS budget FROM v_obs),
m AS (SELECT runner, detector, pipelines AS s, arg_max(wall, event_id) AS rate FROM v_obs WHERE pipelines > 0 AND wall > 0 GROUP BY ALL),
l AS (SELECT g.*, x.s, m.rate, max(m.rate) OVER (PARTITION BY g.runner, g.detector) AS best FROM g, LATERAL (SELECT unnest(range(low, up + 1)) AS s) x LEFT JOIN m ON m.runner = g.runner AND m.detector = g.detector AND m.s = x.s),
n AS (SELECT *, coalesce(rate >= 0.98::DOUBLE * best, false) AS near, min(CASE WHEN rate = best THEN s END) OVER (PARTITION BY runner, detector) AS peak FROM l),
k AS (SELECT *, lead(s) OVER w AS after, lead(near) OVER w AS near_after FROM n WHERE rate IS NOT NULL WINDOW w AS (PARTITION BY runner, detector ORDER BY s)),
f AS (SELECT runner, detector, min(s + 1) AS gap FROM k WHERE near AND near_after AND after - s BETWEEN 2 AND 3 GROUP BY ALL),
a AS (SELECT runner, detector, any_value(low) AS low, any_value(up) AS up, any_value(peak) AS peak, count(*) - count(rate) AS unknown, coalesce(min(s) FILTER (budget % s = 0), min(s)) AS first, coalesce(max(s) FILTER (budget % s = 0), max(s)) AS last,
  list(s) FILTER (rate IS NOT NULL) AS known, coalesce(max(s) FILTER (s < peak AND NOT near), min(s) - 1) AS lc, coalesce(min(s) FILTER (s > peak AND NOT near), max(s) + 1) AS rc,
  min(s) FILTER (near) AS near_low, max(s) FILTER (near) AS near_high, bool_or(s < peak AND rate IS NOT NULL) AND bool_or(s > peak AND rate IS NOT NULL) AS between_ FROM n GROUP BY ALL),
b AS (SELECT *, coalesce(list_max(list_filter(known, lambda x: x < near_low)), low) AS below, coalesce(list_min(list_filter(known, lambda x: x > near_high)), up) AS above FROM a),
i AS (SELECT runner, detector, below AS x, near_low AS y FROM b UNION ALL SELECT runner, detector, near_high, above FROM b),
c AS (SELECT i.runner, i.detector, i.x, y - x AS width, arg_min(s, struct_pack(r := CAST(greatest(s * s, x * y) AS DOUBLE) / least(s * s, x * y), s := s)) AS s FROM i, LATERAL (SELECT unnest(range(x + 1, y)) AS s) u GROUP BY ALL),
w AS (SELECT runner, detector, arg_max(s, struct_pack(w := width, s := -s)) AS s FROM c GROUP BY ALL)
SELECT g.runner, g.detector, CASE WHEN b.unknown IS NULL OR b.unknown = 0 THEN NULL WHEN NOT coalesce(list_contains(known, first), false) THEN first WHEN NOT list_contains(known, last) THEN last WHEN gap IS NOT NULL THEN gap
  WHEN between_ THEN CASE WHEN lc >= b.low AND NOT list_contains(known, lc) AND (rc > b.up OR list_contains(known, rc) OR peak - lc <= rc - peak) THEN lc WHEN rc <= b.up AND NOT list_contains(known, rc) THEN rc END ELSE w.s END AS next_shape
FROM g LEFT JOIN b USING (runner, detector) LEFT JOIN f USING (runner, detector) LEFT JOIN w USING (runner, detector)"""


@query(PROBES)
def q_next_probe(spark, d):
    obs = V.v_obs(spark, d)
    r = F.col("runner")
    groups = obs.select("runner", "detector").distinct().select("runner", "detector", (1 + r % 6).alias("low"), (8 + r % 60).alias("high"), (24 + r % 41).alias("budget"), (1 + r % 2).alias("thread_min"))
    return S.next_probe(groups, S.measured(obs, ["runner", "detector"], "pipelines", "wall", "event_id"), ["runner", "detector"]).select("runner", "detector", "next_shape")


REFINED = """WITH RECURSIVE f AS (SELECT l_partkey AS k, l_linenumber AS x, CAST(l_quantity AS INT) AS y, min(l_extendedprice) AS c FROM lineitem GROUP BY ALL),
s AS (SELECT k, list_sort(list_distinct(list(x))) AS xs, list_sort(list_distinct(list(y))) AS ys, map_from_entries(list((x * 1000 + y, c))) AS m FROM f GROUP BY k),
r AS (SELECT k, 0 AS step, 1 AS pass, 0 AS dim, 0 AS lo, len(xs) - 1 AS hi, len(xs) // 2 AS cx, len(ys) // 2 AS cy, coalesce(m[xs[len(xs) // 2 + 1] * 1000 + ys[len(ys) // 2 + 1]], 'inf'::DOUBLE) AS cc,
    len(xs) // 2 AS bk, coalesce(m[xs[len(xs) // 2 + 1] * 1000 + ys[len(ys) // 2 + 1]], 'inf'::DOUBLE) AS bc, false AS moved, [xs[len(xs) // 2 + 1] * 1000 + ys[len(ys) // 2 + 1]] AS seen, false AS over FROM s
  UNION ALL
  SELECT k, step + 1, CASE WHEN ended AND dim = 1 THEN pass + 1 ELSE pass END, CASE WHEN ended THEN 1 - dim ELSE dim END,
    CASE WHEN ended THEN 0 WHEN p > mid THEN mid ELSE lo END, CASE WHEN ended THEN CASE WHEN dim = 0 THEN ny ELSE nx END - 1 WHEN p <= mid THEN mid ELSE hi END,
    CASE WHEN ended AND dim = 0 THEN nk ELSE cx END, CASE WHEN ended AND dim = 1 THEN nk ELSE cy END, CASE WHEN ended THEN nc ELSE cc END,
    CASE WHEN ended THEN CASE WHEN dim = 0 THEN cy ELSE cx END ELSE nk END, nc,
    CASE WHEN ended AND dim = 1 THEN false WHEN ended THEN moved OR nk <> cx ELSE moved END, list_concat(seen, keys), ended AND dim = 1 AND (pass = 3 OR NOT (moved OR nk <> cy))
  FROM (SELECT *, CASE WHEN c < bc THEN p ELSE bk END AS nk, least(c, bc) AS nc, n < 2 OR hi - lo <= 2 AS ended
    FROM (SELECT *, CASE WHEN n < 2 THEN bk WHEN c0 <= c1 AND c0 <= c2 THEN lo WHEN c1 <= c2 THEN mid ELSE hi END AS p, CASE WHEN n < 2 THEN bc ELSE least(c0, c1, c2) END AS c
      FROM (SELECT *, coalesce(m[k0], 'inf'::DOUBLE) AS c0, coalesce(m[k1], 'inf'::DOUBLE) AS c1, coalesce(m[k2], 'inf'::DOUBLE) AS c2, CASE WHEN n < 2 THEN [] ELSE [k0, k1, k2] END AS keys
        FROM (SELECT *, CASE dim WHEN 0 THEN xs[lo + 1] * 1000 + ys[cy + 1] ELSE xs[cx + 1] * 1000 + ys[lo + 1] END AS k0, CASE dim WHEN 0 THEN xs[mid + 1] * 1000 + ys[cy + 1] ELSE xs[cx + 1] * 1000 + ys[mid + 1] END AS k1,
            CASE dim WHEN 0 THEN xs[hi + 1] * 1000 + ys[cy + 1] ELSE xs[cx + 1] * 1000 + ys[hi + 1] END AS k2
          FROM (SELECT r.*, xs, ys, m, (lo + hi) // 2 AS mid, len(xs) AS nx, len(ys) AS ny, CASE dim WHEN 0 THEN len(xs) ELSE len(ys) END AS n FROM r JOIN s USING (k) WHERE NOT over) q) q) q) q) q),
e AS (SELECT r.k, r.seen, xs[greatest(cx, 1) : cx + 2] AS nx, ys[greatest(cy, 1) : cy + 2] AS ny FROM r JOIN s USING (k) WHERE over),
v AS (SELECT k, unnest(seen) AS v FROM e UNION SELECT e.k, x * 1000 + y FROM e, LATERAL (SELECT unnest(nx) AS x) a, LATERAL (SELECT unnest(ny) AS y) b)
SELECT v.k, v // 1000 AS x, v % 1000 AS y, s.m[v] AS cost FROM v JOIN s USING (k)"""


@query(REFINED)
def q_refined_search(spark, d):
    """A search a part: line number by quantity for the least price."""
    facts = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("int").alias("y"), "l_extendedprice")
    look = S.lookup(facts, "k", ["x", "y"], "l_extendedprice")
    places = S.domains(look.known, "k", ["x", "y"]).withColumns({f"start_{c}": F.floor(F.size(c) / 2) for c in ("x", "y")})
    return S.refine(places, look, "k", ["x", "y"])


DESCENT = """WITH RECURSIVE e AS (SELECT o_orderkey AS revision, lag(o_orderkey) OVER (PARTITION BY o_custkey // 30 ORDER BY o_orderkey) AS parent FROM orders
  UNION ALL SELECT l_orderkey, l_partkey % l_orderkey FROM lineitem WHERE l_orderkey > 0 AND l_returnflag = 'R' AND l_linenumber = 7),
f AS (SELECT min(o_orderkey) AS revision FROM orders WHERE o_orderpriority = '1-URGENT'),
r AS (SELECT revision FROM f UNION SELECT e.revision FROM e JOIN r ON e.parent = r.revision)
SELECT o_orderkey AS number, o_orderkey AS revision, r.revision IS NOT NULL AS descends FROM orders LEFT JOIN r ON r.revision = o_orderkey"""


@query(DESCENT)
def q_descended_runs(spark, d):
    """Orders as revisions after the one before of 30 customers; returned lines are merges."""
    o, li = V.table(spark, d, "orders"), V.table(spark, d, "lineitem")
    lines = o.select(F.col("o_orderkey").alias("revision"), F.lag("o_orderkey").over(Window.partitionBy(F.floor(F.col("o_custkey") / 30)).orderBy("o_orderkey")).alias("parent"))
    merges = li.where("l_orderkey > 0 AND l_returnflag = 'R' AND l_linenumber = 7").select(F.col("l_orderkey").alias("revision"), F.expr("l_partkey % l_orderkey").alias("parent"))
    floor = o.where("o_orderpriority = '1-URGENT'").agg(F.min("o_orderkey").alias("revision"))
    return A.descended(o.select(F.col("o_orderkey").alias("number"), F.col("o_orderkey").alias("revision")), lines.unionByName(merges), floor)


BOXES = """WITH RECURSIVE b AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, l_partkey AS x0, CAST(floor(l_extendedprice / 50) AS BIGINT) AS y0, l_partkey + CAST(l_quantity AS BIGINT) AS x1, CAST(floor(l_extendedprice / 50) AS BIGINT) + 2 * CAST(l_quantity AS BIGINT) AS y1 FROM lineitem),
p AS (SELECT page, list(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1)) AS bs, arg_min(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1), struct_pack(a := -(x1 - x0) * (y1 - y0), i := id)) AS s FROM b GROUP BY page),
r AS (SELECT page, s.x0 AS x0, s.y0 AS y0, s.x1 AS x1, s.y1 AS y1 FROM p
  UNION SELECT page, list_min(list_transform(t, lambda c: c.x0)), list_min(list_transform(t, lambda c: c.y0)), list_max(list_transform(t, lambda c: c.x1)), list_max(list_transform(t, lambda c: c.y1))
  FROM (SELECT r.page, list_append(list_filter(bs, lambda c: c.x0 <= r.x1 + 6 AND r.x0 <= c.x1 + 6 AND c.y0 <= r.y1 + 6 AND r.y0 <= c.y1 + 6), struct_pack(x0 := r.x0, y0 := r.y0, x1 := r.x1, y1 := r.y1)) AS t FROM r JOIN p USING (page)) q),
e AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r GROUP BY page)
SELECT e.*, CAST(len(list_filter(bs, lambda c: c.x0 <= e.x1 + 6 AND e.x0 <= c.x1 + 6 AND c.y0 <= e.y1 + 6 AND e.y0 <= c.y1 + 6)) AS BIGINT) AS n_joined FROM e JOIN p USING (page)"""


@query(BOXES)
def q_grown_boxes(spark, d):
    """Lines of a supplier as boxes on a page."""
    q, price = F.col("l_quantity").cast("long"), F.floor(F.col("l_extendedprice") / 50)
    b = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("x0"), price.alias("y0"), (F.col("l_partkey") + q).alias("x1"), (price + 2 * q).alias("y1"))
    return E.grown_boxes(b, "page", "id", 6)
