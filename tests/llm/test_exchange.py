from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import common, exchange, lm, repeats  # noqa: E402

from . import brute  # noqa: E402


def got_repeats(docs):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.dedup(docs).collect())


def plain_nodes(rows, least):
    """Internal nodes by their strings: depth and leaves of every prefix of `least` words or more after which suffixes differ or end."""
    leaves = defaultdict(list)
    for i, r in enumerate(rows):
        for d in range(least, len(r) + 1):
            leaves[tuple(r[:d])].append(i)
    return sorted((len(p), sorted(x)) for p, x in leaves.items() if len(x) > 1 and (len(p) == len(rows[0]) or len({rows[i][len(p)] for i in x}) > 1))


def test_internal_nodes_are_those_of_the_tree():
    rng = np.random.default_rng(4)
    for _ in range(60):
        rows = rng.integers(0, int(rng.integers(1, 4)), (int(rng.integers(1, 40)), int(rng.integers(1, 7)))).astype(np.int32)
        tree = repeats.Subtree(rows)
        for least in (1, rows.shape[1]):
            got = sorted((d, sorted(tree.order[a:b].tolist())) for d, first, last in tree.internal(least) for a, b in zip(first.tolist(), last.tolist()))
            assert got == plain_nodes(rows.tolist(), least)
    assert repeats.Subtree(np.empty((0, 13), np.int32)).internal(13)[0][1].size == 0


def test_chunks_by_bytes_and_ids(spark, monkeypatch):
    rows = [(k, "x" * 100) for k in range(100)] + [(50, "y" * k) for k in range(300)] + [(None, f"n{k}" * 9) for k in range(200)] + [(-7, None)]
    docs = common.documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    for parts in ("1", "4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        plan = exchange.layout(docs, 2000, 2000)
        got = exchange.chunked(docs, plan).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        size, ids = Counter(), defaultdict(set)
        for r in got:
            size[r.chunk] += len(r.text)
            ids[r.chunk].add(-(1 << 63) if r.doc_id is None else r.doc_id)
        assert len(got) == len(rows) and max(size.values()) < 8000 and max(size) < plan.chunks
        order = sorted((min(x), max(x), plan.rank(c)) for c, x in ids.items())
        assert all(a[1] < b[0] or (a == b and a[0] == a[1]) for a, b in zip(order, order[1:]))
        assert [r for _, _, r in order] == sorted(r for _, _, r in order) and (len({r for a, _, r in order if a == 50}), sum(a == 50 for a, _, _ in order)) >= (1, 10)
    empty = exchange.layout(docs.limit(0))
    assert (empty.chunks, empty.groups, empty.rank(0)) == (1, 1, 0)


def test_levels_give_what_one_gives(spark, monkeypatch):
    """Two and three levels of merged messages, more groups than messages, and a passage of 10,000 words that a third of all share."""
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 900, n))
    passage = word(10_000)
    data = [(k, passage + " " + word(20) if k % 3 == 0 else word(int(rng.integers(5, 400)))) for k in range(30)] + [(100 + k, brute.SHARED + f" {k}") for k in range(20)]
    docs, want = brute.frame(spark, data), brute.repeats(data)
    plain = {r.doc_id: tuple(r) for r in lm.score(docs).collect()}
    monkeypatch.setattr(exchange.layout, "__defaults__", (6000, 400))
    for fan in (2000, 9, 4):
        monkeypatch.setattr(exchange, "FAN", fan)
        assert exchange.layout(common.documents(docs)).groups == min(fan, -(-sum(len(t) for _, t in data) // 400))
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.dedup(docs).collect()} == want
        again = {r.doc_id: tuple(r) for r in lm.score(docs).collect()}
        assert again.keys() == plain.keys() and all(np.allclose(again[k][2:], plain[k][2:], rtol=1e-9) for k in plain)


def test_rows_without_ids_or_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(exchange.layout, "__defaults__", (600, 600))
    same = [(None, brute.SHARED + f" {k}") for k in range(40)] + [(7, brute.SHARED + f" x {k}") for k in range(40)]
    docs = spark.createDataFrame(same, "doc_id long, text string").repartition(4)
    got = repeats.dedup(docs).collect()
    # a null doc_id is below all, and no smaller than another null
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 60)] * 40 + [(True, 0)] * 40
    assert sorted(r.n_removed for r in repeats.dedup(docs.where("doc_id is null")).collect()) == [0] * 40
    assert lm.score(docs).count() == 80
    monkeypatch.setattr(exchange.layout, "__defaults__", (1 << 20, 1 << 20))  # all in one chunk
    assert sorted((r.doc_id is None, r.n_removed) for r in repeats.dedup(docs).collect()) == [(False, 60)] * 40 + [(True, 0)] * 40
    spans = repeats.maximal(docs).collect()
    assert {(r.start, r.length) for r in spans} == {(0, 60)} and len(spans) == 40
