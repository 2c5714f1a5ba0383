"""Commits, conflicts, writers that die, batches that come twice."""

import pytest

from gridlore.sources.log import Conflict, Log, upsert_stream


def rows(spark, *x):
    return spark.createDataFrame(list(x), "k long, at long, v string")


def held(log, version=None):
    return sorted(((r.k, r.at, r.v) for r in log.read(version).collect()), key=lambda r: (r[0] is not None, r))


def test_snapshots_and_conflicts(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"))
    assert log.version() == -1 and log.read() is None
    log.upsert(rows(spark, *((k, 1, "a") for k in range(100))), ["k"], "at")
    low, high, wide = log.begin(), log.begin(), log.begin()
    low.upsert(rows(spark, (200, 2, "b")), ["k"], "at")  # beyond all files
    high.upsert(rows(spark, (500, 2, "c")), ["k"], "at")
    wide.upsert(rows(spark, (100, 2, "w"), (300, 2, "w")), ["k"], "at")
    assert low.removed == [] and low.commit() == 1 and high.commit() == 2  # apart: the second goes on to the next number
    with pytest.raises(Conflict):
        wide.commit()
    wide.abandon()
    assert log.version() == 2 and len(held(log)) == 102 and len(held(log, 0)) == 100
    log.upsert(rows(spark, (3, 0, "late"), (4, 9, "new")), ["k"], "at")
    now = dict((k, v) for k, _, v in held(log))
    assert now[3] == "a" and now[4] == "new" and held(log, 2)[4] == (4, 1, "a")


def test_only_files_in_range_are_read(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"))
    for k in (0, 1000, 2000):
        log.upsert(rows(spark, *((k + i, 1, "a") for i in range(50))), ["k"], "at")
    t = log.begin()
    t.upsert(rows(spark, (1010, 5, "x")), ["k"], "at")
    assert t.removed and all(1000 <= f.low and f.high < 1050 for f in t.removed)
    t.commit()
    assert dict((k, v) for k, _, v in held(log))[1010] == "x" and len(held(log)) == 150


def test_a_dead_writer_leaves_no_lock(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"))
    log.upsert(rows(spark, (1, 1, "a")), ["k"], "at")
    dead = log.begin()
    dead.upsert(rows(spark, (1, 2, "dead")), ["k"], "at")  # written, never committed
    (tmp_path / "t" / "_log" / ".half").write_text("{")
    log.upsert(rows(spark, (1, 3, "alive")), ["k"], "at")
    assert held(log) == [(1, 3, "alive")]
    folders = lambda: {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")}
    assert dead.folders[0] in folders() and log.vacuum(1, older_s=3600) == 0
    assert log.vacuum(1, older_s=-60) == 2 and dead.folders[0] not in folders() and held(log) == [(1, 3, "alive")]


def test_null_keys_retention_and_other_key_types(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"))
    log.upsert(rows(spark, (None, 1, "n"), (1, 1, "a")), ["k"], "at")
    log.upsert(rows(spark, (None, 2, "m"), (7, 3, "z")), ["k"], "at")
    assert held(log) == [(None, 2, "m"), (1, 1, "a"), (7, 3, "z")]
    log.upsert(rows(spark, (8, 4, "y")), ["k"], "at", keep=2)
    assert held(log) == [(7, 3, "z"), (8, 4, "y")]
    texts = Log(spark, str(tmp_path / "s"))
    for v in range(3):
        texts.upsert(spark.createDataFrame([("é" if v % 2 else "a", v)], "k string, v int"), ["k"], "v")
    assert sorted((r.k, r.v) for r in texts.read().collect()) == [("a", 2), ("é", 1)]
    none = Log(spark, str(tmp_path / "e"))
    none.upsert(rows(spark), ["k"], "at")
    assert held(none) == []


def test_a_batch_counts_once(spark, tmp_path):
    src, path, checkpoint = tmp_path / "src", str(tmp_path / "t"), str(tmp_path / "cp")
    schema = "k long, at long, v string"
    rows(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "c")).coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    upsert_stream(stream(), path, ["k"], "at", checkpoint).awaitTermination()
    log = Log(spark, path)
    assert held(log) == [(1, 2, "b"), (2, 1, "c")] and log.version() == 0
    # the writer died between the commit and the checkpoint: the batch is run again
    for f in (tmp_path / "cp" / "commits").iterdir():
        f.unlink()
    upsert_stream(stream(), path, ["k"], "at", checkpoint).awaitTermination()
    assert log.version() == 0
    rows(spark, (1, 9, "z")).coalesce(1).write.mode("append").parquet(str(src))
    upsert_stream(stream(), path, ["k"], "at", checkpoint).awaitTermination()
    assert log.version() == 1 and held(log) == [(1, 9, "z"), (2, 1, "c")]
    # a lost checkpoint: all rows come again under another id
    upsert_stream(stream(), path, ["k"], "at", str(tmp_path / "other")).awaitTermination()
    assert held(log) == [(1, 9, "z"), (2, 1, "c")] and len(log.entry(log.version())["ledger"]) == 2
    # the writer dies before the commit
    rows(spark, (5, 1, "q")).coalesce(1).write.mode("append").parquet(str(src))

    def die(number):
        raise OSError("gone")

    with pytest.raises(Exception, match="gone"):
        upsert_stream(stream(), path, ["k"], "at", checkpoint, wait=die).awaitTermination()
    assert (5, 1, "q") not in held(log)
    upsert_stream(stream(), path, ["k"], "at", checkpoint).awaitTermination()
    assert (5, 1, "q") in held(log)


def test_contents_are_stored_once_and_collected(spark, tmp_path):
    from gridlore.sources.store import Store

    store = Store(spark, str(tmp_path / "s"))
    put = lambda *x: store.put(spark.createDataFrame(list(x), "name string, content string, at long"))
    put(("a", "one", 1), ("b", "one", 1), ("c", "two", 1), ("c", "three", 2), (None, "nobody's", 1), ("d", None, 1))
    sizes = lambda: sorted((r.size, r.n_names, r.name) for r in store.index().collect())
    assert sizes() == [(3, 0, None), (3, 2, "a"), (5, 1, "c"), (8, 0, None)]
    put(("b", "three", 3), ("a", "old news", 0))  # an older content of a name
    assert sum(n for _, n, _ in sizes()) == 3 and (5, 2, "b") in sizes()
    assert store.sweep(before=1) == 1 and store.sweep() == 2 and store.sweep() == 0
    assert sizes() == [(3, 1, "a"), (5, 2, "b")]
    put(("e", "two", 9))  # a collected content comes again
    assert (3, 1, "e") in sizes()
    store.put(spark.createDataFrame([], "name string, content string, at long"))
    assert len(sizes()) == 3
