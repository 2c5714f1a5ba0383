import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import components, jaccard  # noqa: E402

from . import brute  # noqa: E402


def groups(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hub", [3, 1000])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    edges = [(k, k + 1) for k in range(100, 160)] + [(k, 500) for k in range(300, 340)] + [(9, 8), (8, 9), (9, 9), (None, 3), (3, None), (7, 7), (600, 601), (601, 602), (602, 600), (-5, 339)]
    got = components.components(spark.createDataFrame(edges, "u long, v long").repartition(3))
    assert {r.node: r.component for r in got.collect()} == groups(edges)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    monkeypatch.setattr(components, "LINKED", 10)
    with pytest.raises(RuntimeError, match="did not settle"):
        components.components(spark.createDataFrame(edges, "u long, v long"), rounds=1)


def test_chained_groups_are_cut_and_lose_no_link(spark, monkeypatch):
    """Neighbours share five sixths of their words, others ever less: one candidate group, many tasks."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 11)
    monkeypatch.setattr(jaccard, "BLOCK_SKETCHES", 5)
    monkeypatch.setattr(jaccard, "CUT_BLOCKS", 1)
    rows = [(k, " ".join(f"w{j}" for j in range(12 * k, 12 * k + 150))) for k in range(40)]
    rows += [(100 + k, " ".join(f"v{j}" if j % 60 != k % 60 else f"x{k}" for j in range(200))) for k in range(50)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None)]
    for _ in range(2):
        got = {r.doc_id: (r.class_id, r.n_links, r.copies) for r in jaccard.join(brute.frame(spark, rows)).collect()}
        assert got == brute.jaccard(rows)


@pytest.mark.parametrize(("linked", "hub"), [(7, 3), (50, 1000), (200_000, 1000)])
def test_components_by_rounds(spark, monkeypatch, linked, hub):
    import random

    monkeypatch.setattr(components, "HUB", hub)
    monkeypatch.setattr(components, "LINKED", linked)
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(k, 500) for k in range(300, 340)] + [(9, 9), (None, 3), (3, None), (-5, 339), (2**62, 9)] + [(r.randrange(1000, 2000), r.randrange(1000, 2000)) for _ in range(700)]
    got = components.components(spark.createDataFrame(edges, "u long, v long").repartition(3))
    assert got.columns == ["node", "component"] and {r.node: r.component for r in got.collect()} == groups(edges)
    assert components.components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "grid"])
def test_a_million_edges(spark, shape):
    """Over five tasks, each with its own part of what hangs together."""
    n = 1_000_000
    ends, nodes = {
        "chain": (["(id * 7919) % 1000003 as u", "((id + 1) * 7919) % 1000003 as v"], n + 1),
        "star": (["id + 1 as u", "0L as v"], n + 1),
        "grid": (["id div 2 as u", "id div 2 + CASE WHEN id % 2 = 0 THEN 1 ELSE 707 END as v"], n // 2 + 706 + 1),
    }[shape]
    got = components.components(spark.range(n).selectExpr(*ends))
    assert tuple(got.selectExpr("count(distinct component)", "count(*)", "min(component)").first()) == (1, nodes, 0)


def test_shuffle_files_go_with_the_action_that_made_them(spark):
    # pipeline: on check_h the rounds' small files filled the disk until the driver happened to collect its garbage
    import time

    from gridlore.llm import common

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "/shuffle_" in f}

    edges = spark.range(2000).selectExpr("id as u", "id - id % 7 as v").where("id % 11 > 0")
    before = files()
    node = components.components(edges)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert node.groupBy("component").count().count() > 100
    ran = edges.groupBy("v").count()
    once = sorted(ran.collect())
    assert sorted(common.cut(ran).collect()) == sorted(common.taken(ran)) == sorted(ran.collect()) == once and common.counted(ran) == len(once)
