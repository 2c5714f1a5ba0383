"""Every operator on nulls in any column, repeated and missing ids, ties, very long texts, empty tables and clashing names."""

import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import chat, common, decontam, jaccard, licenses, line_rules, lm, packing, repeats, secrets, toxicity  # noqa: E402

from . import brute  # noqa: E402

LONG = "".join(f"word{k % 977} and then {k} more. " + ("\n" if k % 9 == 0 else "") for k in range(60_000))  # over a million characters
ROWS = [(1, "password = hunter2abc Licensed under the MIT License. " * 3), (1, "another text of this id, " * 30), (1, "another text of this id, " * 30), (None, "no id here: token: abc123def"), (None, None), (2, None), (2, ""), (3, "  \n "), (4, LONG), (4, LONG), (-9, "😀 é"), (2**62, "x" * 300_000)]
CLASH = "doc_id long, text string, n_words int, _hits string, _salt int, label int, chunk string, component array<int>, n_chars int, band string, _same int, _toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *([None] * 10 if k % 2 else [1, "a", 2, 3, "c", [4], 5, "b", 6, 7])) for k, (i, t) in enumerate(ROWS)], CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "another text of this id, another text of this id, another"), (None, "no id here"), (2, None), (2, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None), (-9, 0)], "doc_id long, toxic int")


def ids(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)


def test_row_for_row_operators(docs, bench, labels):
    want = sorted((i is not None, i or 0) for i, _ in ROWS)
    for out in (secrets.scan(docs), line_rules.line_report(docs), licenses.scan(docs), decontam.contamination(docs, bench), toxicity.score(docs, labels), lm.score(docs), repeats.dedup(docs), jaccard.join(docs)):
        rows = out.collect()
        assert ids(rows) == want, out.columns
        again = sorted(map(str, rows))
        assert again == sorted(map(str, out.collect()))
    got = {r.doc_id: r for r in repeats.dedup(docs).collect() if r.doc_id in (4, 2**62)}
    assert got[4].n_words == len(LONG.split()) and got[2**62].n_words == 1
    hit = {(r.doc_id, r.n_hit) for r in decontam.contamination(docs, bench).collect()}
    assert (None, 3) in hit and (1, 150) in hit
    pieces = packing.pack(docs).groupBy("doc_id", "piece").count().collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in ROWS}


def test_whole_row_operators_keep_columns(docs, bench):
    for out in (line_rules.clean(docs), jaccard.deduplicate(docs), decontam.decontaminate(docs, bench), secrets.redact(docs)):
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert out.count() <= len(ROWS)
    kept = [(r.doc_id, r.text) for r in jaccard.deduplicate(docs).collect()]
    assert sorted(r for r in kept if r[0] == 4) == [(4, LONG)] and sum(i is None for i, _ in kept) == 2 and sum(i == 1 for i, _ in kept) == 2


def test_empty_tables(docs, bench, labels):
    none = docs.limit(0)
    for out in (secrets.scan(none), line_rules.line_report(none), line_rules.clean(none), licenses.scan(none), decontam.contamination(none, bench), decontam.decontaminate(none, bench), toxicity.score(none, labels), lm.score(none), repeats.dedup(none), repeats.maximal(none), jaccard.join(none), jaccard.deduplicate(none), packing.pack(none)):
        assert out.count() == 0
    assert not any(r.contaminated for r in decontam.contamination(docs, bench.limit(0)).collect())


def test_equal_turns_are_cut(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    rows = chat.repair(spark.createDataFrame([(1, 1, "user", "same")] * 400 + [(None, None, None, None)] * 3, "conv_id long, turn long, role string, text string")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == 403 and sorted(r.position for r in rows if r.conv_id == 1) == list(range(400))


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
