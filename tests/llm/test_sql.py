import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import queries  # noqa: E402

from ..compare import differences  # noqa: E402


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


def test_pipeline(spark, sf_dir):
    """Each stage against a brute-force version on the stage's own input."""
    import corpus_pipeline

    from . import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    prose = " ".join(f"plain{k}" for k in range(60)) + "."
    planted = [f"{prose}\n{' '.join(items[3][1].split()[:14])}.", f"{prose}\nThe secret: aB3dE6gH9kL2 is here.\n{' '.join(items[5][1].split()[4:30])}!", f"{prose}\nno end of line", None, prose + " pwd: x9#Lq2!vR7kk done."]
    docs = docs.unionByName(spark.createDataFrame([(10_000 + k, t, "en", "x", len(t or "")) for k, t in enumerate(planted)], docs.schema))
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = docs.collect()
        rows[name] = len(after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and all(r.n_chars == len(r.text) for r in after)
        texts = {r.doc_id: r.text for r in after} if "text" in docs.columns else {}
        if name == "quality_rules":
            want = {i: brute.cleaned(r.text) for i, r in before.items()}
            assert texts == {i: t for i, t in want.items() if t is not None}
        if name == "ngram_jaccard_join":
            found = brute.jaccard([(i, r.text) for i, r in before.items()])
            assert texts == {i: r.text for i, r in before.items() if found[i][0] == i}
        if name == "benchmark_decontamination":
            assert texts == {i: brute.decontaminated(r.text, items) for i, r in before.items()}
            assert any(t != before[i].text for i, t in texts.items())
        if name == "secret_scans":
            assert texts == {i: brute.redacted(r.text) for i, r in before.items()}
            assert any(t != before[i].text for i, t in texts.items())
    assert {r.doc_id for r in after} == set(before)
    assert rows["quality_rules"] < 200 and corpus_pipeline.run(spark, sf_dir).count() == sum(r.doc_id < 10_000 for r in after)
