"""Next shapes by hand, refinement and ancestry and boxes against plain versions."""

import itertools
import random

import pytest

from gridlore.operators import ancestry, evidence, search

# low, high, budget, thread_min, measured shapes and rates, the shape to measure next
PROBES = {
    "nothing measured: the least divisor of the budget": (1, 64, 64, 1, {}, 1),
    "the least divisor within bounds": (5, 60, 64, 1, {}, 8),
    "then the greatest": (5, 60, 64, 1, {8: 1.0}, 32),
    "no divisor: the ends": (5, 7, 64, 1, {}, 5),
    "no divisor: the other end": (5, 7, 64, 1, {5: 1.0}, 7),
    "an edge that is best is approached by the geometric middle": (1, 64, 64, 1, {1: 10.0, 64: 12.0}, 8),
    "and again": (1, 64, 64, 1, {1: 10.0, 8: 11.0, 64: 12.0}, 23),  # sqrt(512) = 22.6
    "a small gap between near-best shapes is filled": (1, 8, 8, 1, {1: 99.0, 3: 100.0, 8: 5.0}, 2),
    "its lower part first": (1, 16, 16, 1, {1: 50.0, 4: 99.0, 7: 100.0, 16: 5.0}, 5),
    "a bracketed best: the lower neighbour of equals": (1, 64, 64, 1, {1: 10.0, 8: 100.0, 64: 30.0}, 7),
    "then the upper one": (1, 64, 64, 1, {1: 10.0, 7: 90.0, 8: 100.0, 64: 30.0}, 9),
    "a near-best neighbour moves the edge, the nearer edge comes first": (1, 64, 64, 1, {1: 10.0, 7: 99.0, 8: 100.0, 64: 30.0}, 9),
    "then the farther one": (1, 64, 64, 1, {1: 10.0, 7: 99.0, 8: 100.0, 9: 50.0, 64: 30.0}, 6),
    "both edges measured: nothing": (1, 64, 64, 1, {1: 10.0, 7: 90.0, 8: 100.0, 9: 90.0, 64: 30.0}, None),
    "near-best shapes elsewhere are not walked": (1, 64, 64, 1, {1: 10.0, 7: 90.0, 8: 100.0, 9: 90.0, 40: 99.0, 64: 30.0}, None),
    "threads bound the shapes": (1, 64, 64, 16, {1: 1.0}, 4),
    "all measured: nothing": (1, 4, 64, 16, {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}, None),
    "no legal shape": (9, 12, 64, 16, {}, None),
    "shapes outside count for nothing": (1, 64, 64, 1, {100: 50.0}, 1),
    "far shapes that are near the best don't hide its edge": (1, 64, 64, 1, {1: 99.0, 16: 100.0, 32: 99.5, 64: 99.9}, 15),
    "a best at the lower end: towards the next one": (1, 64, 64, 1, {1: 12.0, 64: 10.0}, 8),
    "the wider interval beside near-best shapes": (1, 64, 64, 1, {1: 10.0, 20: 50.0, 64: 50.5}, 4),  # 1 to 20, of whose middles 4 and 5 are as near to the root of 20
}


def test_next_probe_by_hand(spark):
    groups = spark.createDataFrame([(name, *p[:4]) for name, p in PROBES.items()], "g string, low int, high int, budget int, thread_min int")
    obs = spark.createDataFrame([(name, s, r, 2) for name, p in PROBES.items() for s, r in p[4].items()] + [(name, s, r / 3, 1) for name, p in PROBES.items() for s, r in p[4].items()] + [("and again", 5, None, 9), ("and again", None, 5.0, 9), ("and again", 5, -1.0, 9), ("nobody", 1, 1.0, 1)], "g string, s int, r double, at int")
    got = {r.g: r.next_shape for r in search.next_probe(groups, search.measured(obs, ["g"], "s", "r", "at"), ["g"]).collect()}
    assert got == {name: p[5] for name, p in PROBES.items()}


def plain_refine(values, cost, start, passes=3, radius=1):
    seen, at = {}, list(start)

    def of(places):
        key = tuple(v[k] for v, k in zip(values, places))
        seen[key] = cost.get(key, float("inf"))
        return seen[key]

    of(at)
    for _ in range(passes):
        before = list(at)
        for d, v in enumerate(values):
            if len(v) < 2:
                continue
            lo, hi, best, best_cost = 0, len(v) - 1, at[d], of(at)
            while True:
                mid = (lo + hi) // 2
                c, k = min((of([*at[:d], k, *at[d + 1 :]]), k) for k in {lo, mid, hi})
                if c < best_cost:
                    best, best_cost = k, c
                if hi - lo <= 2:
                    break
                lo, hi = (lo, mid) if k <= mid else (mid, hi)
            at[d] = best
        if at == before:
            break
    for places in itertools.product(*(range(max(0, k - radius), min(len(v), k + radius + 1)) for v, k in zip(values, at))):
        of(places)
    return {k: None if c == float("inf") else c for k, c in seen.items()}


def test_many_searches_at_once(spark):
    r = random.Random(4)
    facts, want, starts = [], {}, []
    for key in range(25):
        values = [sorted(r.sample(range(100), n)) for n in (r.randrange(1, 14), r.randrange(1, 9), 1 + key % 2)]
        cost = {k: float(r.randrange(8)) for k in itertools.product(*values) if r.random() < 0.8}
        start = [r.randrange(len(v)) for v in values]
        facts += [(key, *k, c) for k, c in cost.items()]
        starts.append((key, *values, *start))
        want |= {(key, *k): c for k, c in plain_refine(values, cost, start).items()}
    asked = []
    look = search.lookup(spark.createDataFrame(facts, "k int, a int, b int, c int, cost double"), "k", ["a", "b", "c"], "cost")

    def evaluate(sets):
        asked.append([tuple(x) for x in sets.select("k", "a", "b", "c").collect()])
        return look(sets)

    table = spark.createDataFrame(starts, "k int, a array<int>, b array<int>, c array<int>, start_a int, start_b int, start_c int")
    got = search.refine(table, evaluate, "k", ["a", "b", "c"]).collect()
    assert {tuple(x[:4]): x.cost for x in got} == want and len(got) == len(want)
    flat = [s for step in asked for s in step]
    assert len(flat) == len(set(flat)) == len(want)  # no set twice
    assert search.refine(table.limit(0), look, "k", ["a", "b", "c"]).count() == 0


def test_refinement_moves_no_facts(spark):
    r = random.Random(7)
    values = [list(range(9)), list(range(12))]
    cost = {k: {p: float(r.randrange(50)) for p in itertools.product(*values) if r.random() < 0.9} for k in range(40)}
    rows = [(k, *p, c) for k, costs in cost.items() for p, c in costs.items()]
    facts = spark.createDataFrame(rows + [(k, a, b, c + 1) for k, a, b, c in rows] + [(None, 1, 1, 0.0)], "k int, a int, b int, cost double")
    look, plans = search.lookup(facts, "k", ["a", "b"], "cost"), []

    def evaluate(sets):
        plans.append(look(sets).groupBy("k").count()._jdf.queryExecution().executedPlan().toString())
        return look(sets)

    evaluate.buckets = look.buckets
    starts = search.domains(look.known, "k", ["a", "b"]).selectExpr("*", "2 start_a", "3 start_b")
    got = search.refine(starts, evaluate, "k", ["a", "b"]).collect()
    want = {(k, *p): c for k, costs in cost.items() for p, c in plain_refine(values, costs, [2, 3]).items()}
    assert {tuple(x[:3]): x.cost for x in got} == want and len(got) == len(want)
    assert len(plans) > 10 and not [p for p in plans if "Exchange hashpartitioning" in p]
    assert not spark.catalog.listTables()


def plain_descendants(edges, floors):
    children, found = {}, {f for f in floors if f is not None}
    for c, p in edges:
        children.setdefault(p, []).append(c)
    stack = list(found)
    while stack:
        for c in children.get(stack.pop(), []):
            if c is not None and c not in found:
                found.add(c)
                stack.append(c)
    return found


def test_descent(spark):
    r = random.Random(5)
    chain = [(k, k - 1) for k in range(1, 10_001)]
    merges = [(k, r.randrange(20_000, k)) for k in range(20_001, 20_400) for _ in range(r.randrange(1, 4))]
    odd = [(None, 5), (5, None), (7, 7), (50_000, 50_001), (50_001, 50_000), (50_002, 50_001)] + [(60_000 + k, 20_010) for k in range(200)] + [(20_390, 20_391)]
    edges = chain + merges + odd
    table = spark.createDataFrame(edges, "revision long, parent long")
    for floors in ([4], [20_007, 50_000, None, 99]):
        got = [x.revision for x in ancestry.descendants(table, spark.createDataFrame([(f,) for f in floors], "revision long")).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_descendants(edges, floors)
    assert ancestry.descendants(table, spark.createDataFrame([], "revision long")).count() == 0


def test_selected_runs(spark):
    runs = spark.createDataFrame([("b", 2), ("a", 1), ("z", 3), (None, 4)], "revision string, number int")
    edges = spark.createDataFrame([("a", "f"), ("b", "a"), ("b", "x")], "revision string, parent string")
    d = ancestry.descended(runs, edges, spark.createDataFrame([("f",)], "revision string"))
    assert {(r.number, r.descends) for r in d.collect()} == {(1, True), (2, True), (3, False), (4, False)}
    assert sorted(r.number for r in ancestry.selected(d).collect()) == [1, 2] and [r.revision for r in ancestry.selected(d, 2).collect()] == ["b"]
    with pytest.raises(ValueError, match="does not descend"):
        ancestry.selected(d, 3)
    with pytest.raises(ValueError, match="no run 9"):
        ancestry.selected(d, 9)


@pytest.mark.parametrize("most", [50_000, 40])
def test_boxes_grow_block_by_block(spark, most):
    r = random.Random(6)
    boxes = {p: [(x := r.randrange(400), y := r.randrange(400), x + r.randrange(25), y + r.randrange(25)) for _ in range(n)] for p, n in ((1, 200), (2, 90), (None, 60), (3, 1))}
    boxes[4] = [(5 * k, 5 * k, 5 * k + 3, 5 * k + 3) for k in range(150)]  # a diagonal, each near the next one only
    boxes[5] = [(7, 10 * k, 9, 10 * k + 8) for k in range(100)]  # one left edge
    rows = [(p, k, *b) for p, bs in boxes.items() for k, b in enumerate(bs)] + [(6, 0, None, 1, 2, 3), (1, 999, 0, None, 2, 3)]
    got = evidence.grown_boxes(spark.createDataFrame(rows, "page int, id int, x0 int, y0 int, x1 int, y1 int").repartition(3), "page", "id", 2, most=most)
    want = {p: evidence.grow_box([list(b) for b in bs], 2) for p, bs in boxes.items()}
    assert {r.page: ([r.x0, r.y0, r.x1, r.y1], r.n_joined) for r in got.collect()} == want
