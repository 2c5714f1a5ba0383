import numpy as np
import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import decontam  # noqa: E402

from . import brute  # noqa: E402


def test_items_without_id_mark_words_and_long_ones_are_cut(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_WORDS", 30)
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 4000, n))
    items = [(1, word(500)), (None, word(80)), (None, "lone pair"), (3, word(39)), (3, word(12)), (4, None), (5, "..."), (6, "lone pair")]
    take = lambda t, a, b: " ".join(t.split()[a:b])
    texts = [None, "", take(items[0][1], 20, 60), take(items[0][1], 485, 500), "x lone PAIR, y", take(items[1][1], 5, 40) + " tail", take(items[3][1], 0, 9), word(2000), " ".join(take(items[0][1], a, a + 10) for a in range(0, 490, 7))]
    data = list(enumerate(texts)) + [(50, texts[2])]
    docs = spark.createDataFrame([(i, t, b"x", [1]) for i, t in data], "doc_id long, text string, _hits binary, _items array<int>").repartition(3)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string").repartition(2)
    want = brute.contamination(data, items)
    for size in (16 << 20, 300):
        marks = decontam.mark_names(docs.columns)
        got = {r.doc_id: len(r[marks[0]]) // 4 for r in decontam.hits(docs, bench, 10, size).collect()}
        assert got == {i: w[1] for i, w in want.items()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, bench).collect()}
    assert got == want and want[5][1] and not want[5][2]
    assert decontam.decontaminate(docs, bench).columns == docs.columns


def test_tables_of_a_large_benchmark_stay_small():
    """In a process of its own: ten million bytes of items in under 500 MB, and a table that still skips."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import resource
import numpy as np
import pyarrow as pa
from gridlore.llm import decontam
from gridlore.llm import words as W
rng = np.random.default_rng(1)
items = [(str(k), " ".join(f"t{x}" for x in rng.integers(0, 300_000, 150_000))) for k in range(9)]
assert sum(len(t) for _, t in items) > 9_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
tables = decontam.compile_patterns(items, 10)
b = W.split(pa.array([items[4][1][:4000], "other words " * 500]), W.ALNUM, lower=True)
starts, whose = tables[0].search(b, W.word_hashes(b))
assert len(starts) > 300 and all(x == ["4"] for x in whose)
assert (tables[0].shift > 0).mean() > 0.8
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin"}, timeout=120)
    assert out.returncode == 0, out.stderr[-800:]
    assert int(out.stdout) < 500
