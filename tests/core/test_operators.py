import json

import pytest

from gridlore.functions import scalar as S
from gridlore.operators import detect, evidence, folds, grid, metrics, ordered, selection
from gridlore.sources import indices, sinks
from pyspark.sql import functions as F


def test_all_page_mean_counts_failures(spark):
    rows = [("s", 1, "ok", 96, 3)] + [("s", k, "no_candidate", None, None) for k in range(2, 6)]
    r = metrics.set_metrics(spark.createDataFrame(rows, "set_id string, page int, status string, iou int, edge int"), ["set_id"]).first()
    assert (r.n_pages, r.n_failed, r.mean_iou, r.ok_mean_iou, r.min_iou, r.mean_edge) == (5, 4, 0.192, 0.96, 0.0, 3.0)
    u = metrics.upgraded(spark.createDataFrame([(5, 4, 0.9, 0.0)], "n_pages int, n_ok int, ok_mean double, ok_std double")).first()
    assert u.mean_all == pytest.approx(0.72)


def test_running_best_in_ranges_is_the_plain_one(spark):
    import random

    random.seed(3)
    rows = [(g, k, random.randint(0, 50)) for g in "ab" for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, v int")
    for width in (1, 7, 1000):
        got = {(r.g, r.k): r.prev_best for r in ordered.running_best(df, ["g"], "k", "v", width).collect()}
        for g, k, _ in rows:
            assert got[g, k] == max((v for h, j, v in rows if h == g and j < k), default=None)


def test_longest_run_rules(spark):
    def run(bits, gap):
        df = spark.createDataFrame([(1, k, b) for k, b in enumerate(bits)], "id int, pos int, b int")
        return [tuple(r)[1:3] for r in ordered.longest_run(df, ["id"], "pos", F.col("b") == 1, gap, len(bits)).collect()]

    assert run([1, 1, 0, 0, 1, 1], 1) == [(0, 2)]  # the first of equal ones
    assert run([0, 1, 1, 0, 1, 0], 1) == [(1, 6)]  # open at the end: with the gap
    assert run([0, 0], 1) == []


def test_grid_and_search(spark):
    domains = {"a": [1, 2], "b": ["x", "y", "z"]}
    rows = grid.product(spark, domains).orderBy("ordinal").collect()
    assert [(r.a, r.b) for r in rows] == [(a, b) for a in (1, 2) for b in "xyz"]
    assert grid.powers_of_two(3, 52) == [3, 4, 8, 16, 32, 52] and grid.divisors(24, 5, 30) == [6, 8, 12, 24]


def test_makespan_and_batches(spark):
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate((5, 4, 3, 3))], "g string, k int, v long")
    assert folds.makespan(df, ["g"], "v", 2).first().makespan == 8
    got = [(r.k, r.batch) for r in folds.claim_batches(df, ["g"], ["k"], "v", 6).orderBy("k").collect()]
    assert got == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_anchors_are_the_nearest_on_both_sides(spark):
    a = spark.createDataFrame([("g", x, float(x * x)) for x in (1, 4, 9)], "g string, x int, y double")
    t = spark.createDataFrame([("g", x) for x in (0, 1, 5, 10)], "g string, at int")
    got = {r.at: (r.lo_x, r.hi_x, r.predicted) for r in selection.linear(selection.anchors(t, a, ["g"], "at", "x", "y"), "at").collect()}
    assert got == {0: (None, 1, 1), 1: (1, 1, 1), 5: (4, 9, 29), 10: (9, None, 81)}


def test_sweep_line(spark):
    df = spark.createDataFrame([("g", 0, 10), ("g", 0, 6)], "g string, s long, e long")
    assert {r.active: r.time for r in ordered.sweep_line(df, ["g"], "s", "e").collect()} == {2: 6, 1: 4}


def test_scalars(spark):
    row = spark.range(1).select(
        S.box_iou(F.array(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), F.array(F.lit(5), F.lit(0), F.lit(15), F.lit(10))).alias("iou"), S.slug(F.lit("  A b--C! ")).alias("slug"), S.duration(F.lit(3723)).alias("d"),
        S.natural_key(F.lit("Page 10")).alias("k10"), S.natural_key(F.lit("page 9")).alias("k9"), S.iso_epoch(F.lit("1970-01-01T00:01:00Z")).alias("e"), S.iso_epoch(F.lit("no")).alias("bad"), S.whole(F.lit("3.0")).alias("w"),
        S.canonical_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit('"x"'))).alias("j"), S.byte_size(F.lit(1536)).alias("b"), S.valid_box(F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(4))).alias("v"),
        S.segment_distance(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("dist"),
    ).first()
    assert row.iou == pytest.approx(1 / 3) and row.slug == "a-b-c" and row.d == "1h 02m 03s" and row.k9 < row.k10 and row.e == 60 and row.bad == 0 and row.w is None
    assert row.j == '{"a":"x","b":1}' and row.b == "1.5 KiB" and not row.v and row.dist == 1


def test_detectors_find_rectangles(spark):
    pages = detect.rectangles(spark, 8)
    sets = detect.catalogue(spark).select("method", F.lit("{}").alias("parameters"))
    found = detect.detect(pages, sets.union(spark.createDataFrame([("absent", "{}")], sets.schema))).join(pages.select("page_id", "expected"), "page_id").collect()
    assert len(found) == 8 * (len(detect.REGISTRY) + 1)
    for r in found:
        if r.method == "absent":
            assert r.status == "error" and "KeyError" in r.error
        else:
            assert r.status == "ok" and max(abs(a - b) for a, b in zip(r.box, r.expected)) <= 18, r.method


def test_sources(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"observations": [{"observation_id": "a", "detector_id": "d", "shards": 2}, None]}))
    rows = indices.json_rows(spark, str(tmp_path / "i.json"), "observations", indices.OBSERVATION).collect()
    assert [(r.schema_version, r.observation_id, r.shards) for r in rows] == [("legacy", "a", 2)]
    (tmp_path / "l.jsonl").write_text('{"run": "1", "x": 2}\nnot json\n\n{"run": "2", "x": 3}\n')
    assert [r.x for r in indices.json_lines(spark, str(tmp_path / "l.jsonl"), "run string, x int", run="2").collect()] == [3]


def test_sinks(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, at long, v int")
    path = str(tmp_path / "table")
    sinks.upsert_table(spark, path, rows(("a", 1, 1), ("b", 2, 2)), ["k"], "at")
    got = sinks.upsert_table(spark, path, rows(("a", 3, 9), ("c", 4, 4)), ["k"], "at", keep=2)
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 9), ("c", 4)]
    kept = sinks.within_bytes(spark.createDataFrame([(1, "aaaa"), (2, "bb"), (3, "cccc")], "p int, t string"), "p", "t", 7)
    assert [r.p for r in kept.collect()] == [1, 2]  # four, a separator, two


def test_callers_detectors_travel(spark):
    detect.register("whole")(lambda image, p: ([0, 0, image.shape[1], image.shape[0]], 1.0))
    try:
        found = detect.detect(detect.rectangles(spark, 2), spark.createDataFrame([("whole", "{}")], "method string, parameters string")).collect()
        assert [r.box for r in found] == [[0, 0, 320, 240]] * 2
    finally:
        del detect.REGISTRY["whole"]


def test_numbering_in_ranges_is_the_plain_one(spark):
    rows = [(k, float(v) if v != 5 else None) for k, v in enumerate([3, 3, 5, 1, 9, 9, 2, 5, 7])]
    df = spark.createDataFrame(rows, "k int, v double")
    for down in (False, True):
        order = [F.col("v").desc_nulls_last() if down else F.col("v").asc_nulls_last(), F.col("k").asc()]
        got = {r.k: r.n for r in ordered.numbered(df, "v", order, {"n": F.lit(1)}, descending=down, parts=3).collect()}
        want = sorted(rows, key=lambda r: (r[1] is None, (-1 if down else 1) * (r[1] or 0), r[0]))
        assert got == {r[0]: i + 1 for i, r in enumerate(want)}
    same = spark.createDataFrame([(1, 4.0), (2, 4.0)], "k int, v double")
    assert {r.k: r.n for r in ordered.numbered(same, "v", [F.col("k").asc()], {"n": F.lit(1)}).collect()} == {1: 1, 2: 2}
    assert ordered.numbered(same.where("k > 9"), "v", [F.col("k").asc()], {"n": F.lit(1)}).count() == 0


def test_lanes_boxes_and_refinement(spark):
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate((5, 4, 3, 3))], "g string, k int, v long")
    assert [(r.k, r.lane, r.start) for r in folds.lanes(df, ["g"], ["k"], "v", 2).orderBy("k").collect()] == [(0, 0, 0), (1, 1, 0), (2, 1, 4), (3, 0, 5)]
    assert evidence.grow_box([[0, 0, 10, 10], [12, 0, 14, 4], [18, 0, 20, 4], [40, 40, 41, 41]], 4) == ([0, 0, 20, 10], 3)
    assert evidence.effect_strategy("critical", {"moderate_plus": 4}) == "moderate_plus" and evidence.effect_strategy("critical", {}) == "exhaustive" and evidence.effect_strategy("smoke", {}) == "smoke"


def test_wildcards_and_texts(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "q", "y"), (4, None, None)], "id int, own string, kind string").withColumn("size", F.lit(8))
    rows = spark.createDataFrame([("a", 8, "y", 5), ("a", 9, "x", 7), ("b", 8, None, 1)], "runner string, cpus int, kind string, wall int")
    got = {r.id: (r.tier, r.wall) for r in evidence.wildcard_match(t, rows, "id", ["kind"], [("own", "runner"), ("size", "cpus")], ["wall"], ["wall"]).collect()}
    assert got == {1: (1, 5), 2: (1, 7), 3: (2, 5), 4: (2, 1)}
    forms = ["8p/48t", " 8 P / 48 T", "8/48", "8p,48", "8px48t", "8p:48", "8p/48", "8/48t", "0/4", "x"]
    got = [r[0] for r in spark.createDataFrame([(k, f) for k, f in enumerate(forms)], "k int, f string").orderBy("k").select(evidence.manual_shape(F.col("f"))).collect()]
    assert [g and tuple(g) for g in got] == [(8, 48)] * 6 + [None] * 4


def test_memberships_are_told_in_bounded_tasks(spark, tmp_path, monkeypatch):
    # the task that read the sets' one file grouped all their (parameter, build) pairs
    import random

    from gridlore.operators import space

    monkeypatch.setattr(space, "SETS_A_TASK", 50)
    r = random.Random(3)
    sets = [(k, f"x{k % 9}", {n: r.choice(["1", "2", "3", None]) for n in r.sample("abc", r.randrange(4))}) for k in range(300)] + [(0, "x0", {"a": "1"}), (301, None, None)]
    grids = [(f"g{k}", n, v) for k in range(8) for n in r.sample("abc", r.randrange(1, 4)) for v in r.sample(["1", "2", "3", None], r.randrange(1, 4))] * 2 + [("n", "a", "1"), ("n", "b", None), (None, "a", "1")]
    explicit = [("e1", "x1"), ("e1", "x1"), ("e2", "x8"), ("e2", None), ("g0", "x0")]
    spark.createDataFrame(sets, "id long, digest string, parameters map<string, string>").coalesce(1).write.parquet(f"{tmp_path}/sets")
    got = space.memberships(spark.read.parquet(f"{tmp_path}/sets"), spark.createDataFrame(explicit, "build string, digest string"), spark.createDataFrame(grids, "build string, name string, value string"))
    want = {(i, b) for i, x, _ in sets for b, y in explicit if x == y and x}
    for b in {b for b, _, _ in grids if b}:
        of = {n: {v for c, m, v in grids if (c, m) == (b, n) and v} for c, n, _ in grids if c == b}
        want |= {(i, b) for i, _, p in sets if p and set(p) == set(of) and all(p[n] in of[n] for n in p)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(b.startswith("g") for _, b in want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [id") == 2 and "explode(parameters" not in plan


def test_counters_of_a_large_group_go_on_in_chunks(monkeypatch):
    # a group's rows were held as frames, many times over, and given as one
    import tracemalloc

    import numpy as np
    import pandas as pd
    from gridlore.streaming import live

    n = 400_000
    make = lambda: (pd.DataFrame({"key": "a key of some length", "seq": np.arange(k, k + 10_000)[::-1], "busy": 0.5, "total": np.arange(k, k + 10_000)[::-1] * 2.0}) for k in range(0, n, 10_000))
    tracemalloc.start()
    at, b, t = live.ordered(make(), "seq", "busy", "total")
    rows = sum(len(x) for x in live.shares(at, b, t, (0.0, -2.0)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and (at == np.arange(n)).all() and (t == 2.0 * at).all() and peak < 80 * n
    monkeypatch.setattr(live, "CHUNK_ROWS", 2)
    nan = float("nan")
    got = list(live.shares(np.arange(5), np.array([3.0, 1, nan, 7, 9]), np.array([2.0, 4, 6, 8, 8]), (1.0, 1.0)))
    assert [len(x) for x in got] == [2, 2, 1]
    assert [None if np.isnan(x) else x for x in pd.concat(got).share] == [2.0, 0.0, None, None, None]  # a null counter before is none, not an older one
