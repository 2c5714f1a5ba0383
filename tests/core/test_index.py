"""An index kept by batches equals one made anew, after crashes too."""

import random
import statistics

import pytest

from gridlore.sources.index import Index


def plain(rows, keep):
    named = {}
    for g, i, at, v in rows:
        if g is not None and v is not None:
            named[g, i] = (at, i, v)
    groups = {}
    for (g, _), x in named.items():
        groups.setdefault(g, []).append(x)
    out = set()
    for g, xs in groups.items():
        v = [x[2] for x in sorted(xs)[-keep:]]
        out.add((g, len(v), sum(v), min(v), max(v), float(statistics.median(v))))
    return out


def test_batches_retractions_and_crashes(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    index = Index(spark, str(tmp_path / "i"), "g", "id", "at", "v", 5)
    frame = lambda rows: spark.createDataFrame(rows, "g long, id long, at long, v long")
    seen, clock = [], 0
    for n in range(5):
        rows = []
        for _ in range(25):
            clock += 1
            rows.append((r.choice([1, 2, 3, 50 + n, None]), clock, clock, r.choice([None, 1, 2, 3, 9])))
        if n == 2:  # the writer dies after the counts
            put = Index._put
            monkeypatch.setattr(Index, "_put", lambda self, log, *a: put(self, log, *a) if log is self.counts else (_ for _ in ()).throw(OSError("gone")))
            with pytest.raises(OSError):
                index.apply(frame(rows), n)
            monkeypatch.setattr(Index, "_put", put)
        index.apply(frame(rows), n)
        seen += rows
        assert {tuple(x) for x in index.read().collect()} == plain(seen, 5)
    before = index.rows.version()
    index.apply(frame(seen[:5]), 4)  # a batch that was there
    index.apply(frame([]), 5)
    assert index.rows.version() == before
    # an old group's files are left alone
    keep = {f.name for f in index.rows.entry(before)["files"] if f.high < 40}
    index.apply(frame([(60, 1, 1, 1)]), 6)
    assert keep <= {f.name for f in index.rows.entry(index.rows.version())["files"]} and (60, 1, 1, 1, 1, 1.0) in {tuple(x) for x in index.read().collect()}
