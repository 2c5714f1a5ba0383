"""Files as the workload writes them: evaluation CSV, telemetry, lines with numbers."""

import math

import pytest
from pyspark.sql import functions as F

from gridlore.sources import indices

HEAD = [n for n, _ in indices.EVAL_COLUMNS]


def csv(rows):
    cell = lambda x: '"' + str(x).replace('"', '""') + '"'
    return "\n".join([",".join(HEAD), *(",".join(cell(r[n]) if n in r else "" for n in HEAD) for r in rows)]) + "\n"


def test_evaluation_csv(spark, tmp_path):
    assert len(HEAD) == len(set(HEAD)) == 36
    page = {"approved_bbox_json": "[1, 2, 3, 4]", "predicted_bbox_json": "null", "parameters_json": '{"k": 1, "s": "x,y"}', "label": 'a "b", c'}
    rows = [
        page | {"parameter_set_id": "p", "parameter_identity_sha256": "i", "global_ordinal": 10, "status": "Success", "iou": 0.5, "edge_error_mean_px": 2, "left_error_px": 1.5, "elapsed_ms": 3, "search_rank": 4},
        page | {"parameter_set_id": "p", "parameter_identity_sha256": "i", "global_ordinal": 9, "status": "error", "error_type": "E", "error_message": "m", "completion_index": 7, "requested_search_member": "True"},
        page | {"parameter_set_id": "q", "global_ordinal": 1, "status": " ok", "iou": 1, "edge_error_mean_px": 1, "search_space_member": "0", "requested_search_member": "1", "reference_roles_json": '["a"]'},
    ]
    (tmp_path / "e.csv").write_text(csv(rows))
    pages = {(r.identity, r.global_ordinal): r for r in indices.page_evaluations(spark, str(tmp_path / "e.csv")).collect()}
    a, b, c = pages["i", 10], pages["i", 9], pages["q", 1]
    assert (a.label, a.iou, a.edge_errors, a.error, a.predicted_bbox, a.approved_bbox, a.search_rank, a.reference_roles) == ('a "b", c', 0.5, {"left": 1.5}, None, None, [1, 2, 3, 4], 4, [])
    assert (b.iou, b.elapsed_ms, b.error.type, b.requested_search_member, b.search_space_member) == (0, 0, "E", True, True)
    assert (c.requested_search_member, c.search_space_member, c.reference_roles, c.parameters) == (True, False, ["a"], {"k": "1", "s": "x,y"})
    sets = {r.identity: r for r in indices.nested_results(indices.page_evaluations(spark, str(tmp_path / "e.csv"))).collect()}
    assert [p.global_ordinal for p in sets["i"].pages] == [9, 10] and sets["i"].mean_edge_error_px == 2 and sets["i"].elapsed_ms_total == 3 and sets["i"].search_observation.completion_index == 7
    assert sets["q"].search_observation is None and sets["q"].parameter_set_id == "q"
    # other columns, in another order, and most of them absent
    (tmp_path / "f.csv").write_text('own,global_ordinal,parameter_set_id,parameters_json,approved_bbox_json,predicted_bbox_json,status\nx,1,z,{},[],[],ok\n')
    few = indices.page_evaluations(spark, str(tmp_path / "f.csv")).first()
    assert (few.identity, few.global_ordinal, few.profile, few.parameters) == ("z", 1, None, {})
    (tmp_path / "g.csv").write_text(csv([page | {"parameter_set_id": "p", "global_ordinal": "one"}]))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        indices.page_evaluations(spark, str(tmp_path / "g.csv")).collect()


def test_lists_are_read_as_json(spark):
    numbers = ["[]", "[0]", "[ 1]", "[1, 2,3.25]", "[1,2", "[012]", "[-0]", "[-0.5, -7]", "[1.]", "[.5]", "[1e3]", "[1,,2]", "[1,  2]", "[NaN]", "[123456789012345678901]", "[123456789012345.0123456789]", '["1"]', "null", "[null]", "[1]x", "[1]\n", "", None, "7", "[[1]]", "[0.1,0.7]"]
    texts = ["[]", '["a"]', '["a", "b"]', '["a","b, c","", "[é]"]', '["a\\"b"]', '["a" ,"b"]', '["a",  "b"]', '["a", 1]', '["a", null]', '["a""b"]', '["a\tb"]', '["a", "b"', "null", None, '["\\u0041"]', '[", ", "x"]', '["]"]']
    for kind, cells in (("array<double>", numbers), ("array<string>", texts)):
        df = spark.createDataFrame([(n, c) for n, c in enumerate(cells)], "n int, c string").repartition(2)
        for r in df.select("c", indices._json(F.col("c"), kind).alias("got"), F.from_json("c", kind).alias("want")).collect():
            assert repr(r.got) == repr(r.want), r


def test_sets_are_nested_after_one_shuffle_of_pages(spark, tmp_path):
    (tmp_path / "e.csv").write_text(csv([{"parameter_set_id": "p", "global_ordinal": 1, "status": "ok", "parameters_json": '{"k": 1}'}]))
    sets = indices.nested_results(indices.page_evaluations(spark, str(tmp_path / "e.csv")))
    assert sets.first().parameters == {"k": "1"} and sets.first().pages[0].edge_errors == {}
    plan = sets.select("identity", "pages")._jdf.queryExecution().executedPlan().toString()
    assert "parameters_json" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning") :]


def test_telemetry(spark, tmp_path):
    for name, text in {
        "w/3.tsv": "start\t5.5\nend\t9\n", "w/4.tsv": "start\t9\nstart\t8\r\nend\t7\r\n", "t/0.tsv": "claim\t1\t2\tdet\t0\t4\t8\nstart\t3\nfinish\t9\tok\n",
        "t/17.tsv": "start\t3\t2\tdet\t1\t4\t8\tb-1\nfinish\t2\tfailed\n", "c/x.tsv": "claim_batch\t1.5\t2\t8\t60\t4,5,,6\tb-1\n", "c/y.tsv": "claim_batch\t2\t2\t8\t0.5\t\tb-2\n",
        "bad/1.tsv": "start\t5\n", "bad/2.tsv": "finish\t5\tok\n", "bad/3.tsv": "start\tnan\nend\t4\n", "bad/4.tsv": "claim_batch\t1\t2\t8\t60\t4\n", "bad/5.tsv": "start\tsoon\nend\t4\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    read = lambda x, g="*.tsv": indices.telemetry(spark, str(tmp_path / x), g)
    assert sorted(map(tuple, indices.worker_spans(read("w")).collect())) == [(3, 5.5, 9, 3.5), (4, 8, 7, 0)]
    old, new = sorted(indices.task_events(read("t")).collect(), key=lambda r: r.task_index)
    assert tuple(old) == (0, 2, "det", 0, 4, 8, None, 1, 3, 9, "ok", 6, 2)
    assert tuple(new) == (17, 2, "det", 1, 4, 8, "b-1", None, 3, 2, "failed", 0, None)
    assert sorted(map(tuple, indices.claim_lists(read("c")).collect())) == [("b-1", 1.5, 2, 8, 60, [4, 5, 6], 3), ("b-2", 2, 2, 8, 0.5, [], 0)]
    for name, reader, said in ((1, indices.worker_spans, "incomplete worker telemetry: 1"), (1, indices.task_events, "incomplete task telemetry: 1"), (2, indices.task_events, "incomplete task"), (3, indices.worker_spans, "not finite"), (4, indices.claim_lists, "invalid claim batch telemetry: 4"), (5, indices.worker_spans, "CAST_INVALID_INPUT")):
        with pytest.raises(Exception, match=said):
            reader(read("bad", f"{name}.tsv")).collect()


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f'{{"id": {k}, "pad": "{"x" * (k % 90)}"}}' if k % 50 else ("" if k % 100 else "nonsense") for k in range(1, 4001)]
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    (tmp_path / "m.jsonl").write_text('{"id": 1}\n\n[{"id": 2}]\n"x"\n{"id": 3\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = indices.numbered_lines(spark, str(tmp_path / "l.jsonl"))
        assert spark.read.text(str(tmp_path / "l.jsonl")).rdd.getNumPartitions() >= math.floor(sum(map(len, lines)) / 20000) > 5
        assert sorted((r.number, r.value) for r in rows.collect()) == list(enumerate(lines, 1))
        bad = indices.failing_lines(spark, str(tmp_path), "id long, pad string").collect()
        assert sorted((r.file[-7], r.number) for r in bad) == [("l", k) for k in range(100, 4001, 100)] + [("m", k) for k in (3, 4, 5)]
        with pytest.raises(Exception, match="line [345] of .*m.jsonl is no record"):
            indices.strict_lines(spark, str(tmp_path / "m.jsonl"), "id long").collect()
        (tmp_path / "o.jsonl").write_text('\n{"id": 1, "more": 2}\n \n{"id": 4}\n')
        assert sorted(map(tuple, indices.strict_lines(spark, str(tmp_path / "o.jsonl"), "id long").collect())) == [(2, 1), (4, 4)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_telemetry_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    # the little text of all files went to one task, which wrote one file after another
    from gridlore.plans import source_queries

    monkeypatch.setattr(source_queries, "FILES", 50)
    monkeypatch.setattr(source_queries, "_scratch", lambda _: f"{tmp_path}/files")
    rows = spark.range(300).selectExpr("id AS file", "concat('start\t', id, '\nend\t', id + 2) AS value").coalesce(1)
    got = indices.worker_spans(source_queries._telemetry(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [(k, float(k), float(k + 2), 2.0) for k in range(300)]
    written = [p.name for p in (tmp_path / "files").glob("part=*/file=*/part-*.txt")]
    assert len(written) == 300 and len({n.split("-")[1] for n in written}) == len(list((tmp_path / "files").glob("part=*"))) == 6
