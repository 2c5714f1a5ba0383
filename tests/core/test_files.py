import io
import json
import struct
import zipfile

import pytest
from gridlore.functions import scalar as S
from gridlore.operators import intelligence, runs
from gridlore.plans import run_queries, source_queries
from gridlore.sources import files, indices, sinks
from pyspark.sql import functions as F

REL, DRAW = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/drawingml/2006/main"
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", 30, 20, 8, 2) + b"\0" * 7


def word_file(ids):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        rels = "".join(f'<Relationship Id="r{k}" Target="{t}"/>' for k, t in enumerate(("media/a.png", "/word/media/b.png", "media/gone.png")))
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("word/document.xml", f'<d xmlns:a="{DRAW}" xmlns:r="{REL}">' + "".join(f'<a:blip r:embed="r{k}"/>' for k in ids) + "</d>")
        z.writestr("word/media/a.png", PNG)
        z.writestr("word/media/b.png", b"GIF89a" + struct.pack("<HH", 5, 6))
    return out.getvalue()


def test_images_of_word_files(spark, tmp_path):
    for name, data in (("p10.docx", word_file([1, 0, 2, 1])), ("P9.docx", word_file([0])), ("bad.docx", b"no zip")):
        (tmp_path / name).write_bytes(data)
    docs = files.word_documents(spark, str(tmp_path))
    assert [r.name for r in docs.orderBy("place").collect()] == ["bad.docx", "P9.docx", "p10.docx"]
    got = files.image_headers(files.embedded_images(docs), "bytes").orderBy("path", "pos").collect()
    assert [(r.path.rsplit("/", 1)[1], r.pos, r.id, r.format, r.width, r.height) for r in got] == [("P9.docx", 0, "r0", "PNG", 30, 20), ("bad.docx", None, None, None, None, None), ("p10.docx", 0, "r1", "GIF", 5, 6), ("p10.docx", 1, "r0", "PNG", 30, 20), ("p10.docx", 2, "r1", "GIF", 5, 6)]
    assert got[1].error.startswith("BadZipFile") and got[0].mode == "RGB"
    assert files.image_header(b"\xff\xd8\xff\xe0\x00\x04xx\xff\xc0" + struct.pack(">HBHHB", 11, 8, 7, 9, 3) + b"\0" * 9) == ("JPEG", 9, 7, "RGB")
    assert files.image_header(None) == files.image_header(b"BM") == (None,) * 4


def test_page_images(spark):
    paths = ["/x/fs_0001.jpg", "/x/raw/fs_0001.jpg", "/x/fs_0001.tif", "/x/raw/fs_0002.webp", "/x/fs_0003.txt", "/x/fs_12.png"]
    images = files.page_images(spark.createDataFrame([(p, p.rsplit("/", 1)[1]) for p in paths], "path string, name string"), "fs_")
    assert {r.ordinal: r.path for r in images.collect()} == {1: "/x/raw/fs_0001.jpg", 2: "/x/raw/fs_0002.webp", 12: "/x/fs_12.png"}
    labels = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [5.0, 2.0, 3.0, 4.0])], "ordinal int, approved array<double>")
    assert [r.ordinal for r in files.labelled_pages(labels, images).collect()] == [1]
    with pytest.raises(Exception, match="no image of page 7"):
        files.labelled_pages(spark.createDataFrame([(7, [1.0, 2.0, 3.0, 4.0])], "ordinal int, approved array<double>"), images).collect()
    rec = spark.createDataFrame([(1, " ", None), (2, "a", "b"), (5, None, "b")], "ordinal int, raw string, out string")
    assert {r.ordinal: r.image_path for r in files.record_path(["raw", "out"], images, rec).collect()} == {1: "/x/raw/fs_0001.jpg", 2: "a", 5: "b"}


def test_tables_and_counters(spark, tmp_path):
    text = "| A | B |\n|---|---|\n| 1 | x |\n\n| Pipelines | Runner | Rate |\n|--:|:--|---|\n| 4 | big | 2.5 |\n| 8 | small | 3.5 |\n\n| 9 | no | 1 |\n"
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "pos int, line string")
    assert [(r.Runner, r.Pipelines) for r in files.table_rows(lines, ["Runner", "Pipelines"]).orderBy("pos").collect()] == [("big", "4"), ("small", "8")]
    assert files.table_rows(lines, ["None"]).count() == 0
    (tmp_path / "stat").write_text("cpu  1 2 3 4 5 6\ncpu0 1 1 1 1 1\n")
    (tmp_path / "load").write_text("0.5 1.5 2.5 1/2 3\n")
    assert files.processor_counters(spark, str(tmp_path / "stat")).first()[:7] == (1, 2, 3, 4, 5, 6, 0)
    assert tuple(files.load_averages(spark, str(tmp_path / "load")).first()) == (0.5, 1.5, 2.5)
    assert files.environment(spark, "abc").first().revision == "abc"


def test_checks(spark, tmp_path):
    a = spark.createDataFrame([("a.DOCX", "0" * 64), ("b.pdf", "0" * 64), ("c.docx", "xyz"), (None, None)], "name string, sha256 string")
    assert [r.error for r in files.manifest_errors(a).collect()] == [None, "name", "digest", "name"]
    one = spark.createDataFrame([(b"abc", [1, 2], "id")], "content binary, o array<int>, id string")
    digest = F.sha2("content", 256)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(files.artifact_problem(F.col("content"), digest, F.lit(True))) is None and get(files.artifact_problem(F.col("content"), F.lit("00"), F.lit(True))) == "digest mismatch"
    assert get(files.artifact_problem(F.lit(None).cast("binary"), digest, F.lit(True))) == "missing" and get(files.artifact_problem(F.col("content"), digest, F.lit(False))) == "validator failure"
    frozen = lambda o, i="id": get(files.freeze_problems(F.col("content"), digest, F.col("id"), F.lit(i), F.col("o"), F.array(*map(F.lit, o))))
    assert [frozen([1, 2]), frozen([2, 1]), frozen([1, 2], "other")] == [None, "membership", "identity"]
    (tmp_path / "x.json").write_text(json.dumps({"detector": "x", "automatic": False}))
    (tmp_path / "y.json").write_text(json.dumps({"detector": "y"}))
    assert [r.detector for r in files.configurations(spark, str(tmp_path), "detector string", True).collect()] == ["y"]
    s = spark.createDataFrame([([("m", None, "M"), (" ", "n", "n"), ("k", "K", None)], {"m": (3, 1.5)}, {"m": {"ok": 2, "error": 1}})], "detectors array<struct<method:string,name:string,display_name:string>>, performance map<string,struct<runs:int,average_ms:double>>, statuses map<string,map<string,int>>")
    assert sorted(tuple(r) for r in files.performance_rows(s).collect()) == [("k", "K", None, None, 0, 0, 0), ("m", "M", 3, 1.5, 2, 0, 1)]
    assert get(files.first_whole(F.lit("x"), F.lit(None).cast("string"), F.lit(" 7"), F.lit("8"))) == 7


def test_runs_on_record(spark):
    m = spark.createDataFrame([("/r/a/m1.json", "Complete", "exhaustive"), ("/r/a/m2.json", "complete", "exhaustive"), ("/r/b/m.json", "complete", "random"), ("/r/c/m.json", "running", "exhaustive")], "path string, status string, strategy string")
    assert [r.path for r in files.finished_runs(m).collect()] == ["/r/a/m2.json"]


def test_writers(spark, tmp_path):
    p = str(tmp_path)
    sinks.write_json(spark.createDataFrame([(1, "x")], "a int, b string"), f"{p}/j")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{p}/j").collect())) == {"a": 1, "b": "x"}
    pages = spark.createDataFrame([(1, "pass"), (2, "review"), (3, "error")], "page int, quality_status string")
    sinks.write_review(pages, f"{p}/all", f"{p}/queue")
    raw = [f.read_bytes().decode().splitlines() for f in (tmp_path / "queue").glob("*.csv")]
    assert all(x[0] == "\ufeffpage,quality_status" for x in raw) and sorted(v for x in raw for v in x[1:]) == ["2,review", "3,error"]
    sinks.write_rankings(spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "rank int, id string"), f"{p}/rank", 2)
    assert [r.id for r in spark.read.option("header", True).csv(f"{p}/rank").orderBy("rank").collect()] == ["a", "b"]
    run = lambda i, done: spark.createDataFrame([(i, "d", "g", done, {"k": "1"}, i)], "id string, detector string, dataset string, complete boolean, context map<string,string>, created string")
    sinks.publish_entry(spark, f"{p}/index", run("1", True), "full")
    e = sinks.publish_entry(spark, f"{p}/index", run("2", False), "smoke")
    assert sorted((r.id, r.status, r.record.count("/")) for r in e.collect()) == [("1", "authoritative", 3), ("2", "provisional", 3)]
    obs = spark.createDataFrame([(k, "execution-optimizer" if k % 3 == 0 else "live", k) for k in range(12)], "id int, source string, seen int")
    assert sorted(r.id for r in sinks.retained(obs, [], "seen", 2).collect()) == [0, 3, 6, 9, 10, 11]
    data = spark.createDataFrame([(b"a",), (b"a",), (b"bc",)], "content binary")
    first = sinks.store_by_digest(data, None, f"{p}/store")
    again = sinks.store_by_digest(spark.createDataFrame([(b"bc",), (b"d",)], "content binary"), first, f"{p}/store")
    assert sorted(r["size"] for r in again.collect()) == [1, 1, 2]
    assert sinks.stage_record("s", 10.0, "", " OK", 12.3456, "now") == {"stage": "s", "status": "ok", "started_at_utc": "unknown", "completed_at_utc": "now", "elapsed_seconds": 2.346}
    assert sinks.stage_record("s", None, "t", "", 12.0, "now")["elapsed_seconds"] == 0.0


def test_effects_by_hand(spark):
    """Two additive effects: the pair explains all, the stronger one 0.8 of it, so the pair adds the weaker one's 0.2."""
    sets = spark.createDataFrame([(a, b, 0.2 * a + 0.1 * b) for a in (0, 1) for b in (0, 1)], "a int, b int, mean_iou double")
    one = {r.parameter: r for r in intelligence.influence(sets, ["a", "b"]).collect()}
    assert one["a"].eta_squared == pytest.approx(0.8) and one["b"].eta_squared == pytest.approx(0.2) and one["a"].mean_range == pytest.approx(0.2)
    pair = intelligence.interactions(sets, ["a", "b"]).collect()
    assert len(pair) == 1 and pair[0].joint == pytest.approx(1.0) and pair[0].interaction == pytest.approx(0.2)
    flat = spark.createDataFrame([(0, 0, 0.5), (1, 1, 0.5)], "a int, b int, mean_iou double")
    assert {r.influence for r in intelligence.influence(flat, ["a", "b"]).collect()} == {"Zombie"}


def test_shards_must_be_whole(spark):
    s = spark.createDataFrame([("a", 0, 2), ("a", 1, 2), ("b", 0, 3), ("b", 5, 3)], "run string, i int, n int")
    assert {r.run: (r.missing, r.extra, r.whole) for r in runs.shard_sets(s, "run", "i", "n").collect()} == {"a": ("", "", True), "b": ("1,2", "5", False)}
    assert runs.whole_shards(s.where("run = 'a'"), "run", "i", "n").count() == 2
    with pytest.raises(Exception, match="invalid shard set of b: missing 1,2, extra 5"):
        runs.whole_shards(s, "run", "i", "n").collect()


def test_sections_keep_what_is_not_theirs(spark):
    texts = ["<d>M a<d>b</d></d>z", "<d>M never closed <d></d>", "x<d>other</d>", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r.x for r in df.orderBy("k").select(S.without_section(F.col("t"), "<d>", "</d>", "M").alias("x")).collect()] == ["z", *texts[1:]]


def test_made_once(spark, tmp_path):
    row = lambda k, v: spark.createDataFrame([(k, v)], "k int, v int")
    made = []
    for _ in range(2):
        once = sinks.computed_once(spark, str(tmp_path / "once"), lambda: made.append(1) or row(1, 2))
    assert once.count() == 1 and len(made) == 1


def test_object_maps_of_many_and_odd_names(spark, tmp_path):
    # Spark's reader gave up documents of many names by chance of a seed; every document's rows must all come
    many = {f"Supplier#{k:09d}": {"id": k, "wall": k / 4} for k in range(60_000)}
    for k in range(8):
        (tmp_path / f"{k}.json").write_text(json.dumps({"other": [{"runs": 1}], "runs": many}))
    got = indices.json_map(spark, str(tmp_path), "runs", "id bigint, wall double")
    assert got.agg(F.count("*"), F.countDistinct("key"), F.sum("id"), F.sum("wall")).first() == (480_000, 60_000, 8 * 59_999 * 30_000, 8 * 59_999 * 7_500)
    odd = tmp_path / "odd"
    odd.write_text('\n{"runs": 3, "runs" : { "a\\"b\\\\" :{"id": 1}, "":null, "x\\n\\u2028 " : {"id": 2, "wall": -0.5e1, "more": [{}]}, "a\\"b\\\\":{"id": 3}, "n": 7}\n, "z": []} ', encoding="utf-8")
    assert sorted(map(tuple, indices.json_map(spark, str(odd), "runs", "id bigint, wall double").collect()), key=str) == sorted([('a"b\\', 1, None), ('a"b\\', 3, None), ("", None, None), ("x\n  ", 2, -5.0), ("n", None, None)], key=str)
    assert indices.entries(' {"runs": {}, "a": 1} ', "runs") == indices.entries('{"runs": [1]}', "runs") == indices.entries(" ", "runs") == []
    for broken in ("[]", '{"runs": {"a": 1}', '{"runs": {"a": 1,}}', '{"runs": {"a" 1}}', '{"runs": {1: 1}}', "{} {}", '{"runs": {"a": 1 "b": 2}}'):
        with pytest.raises(ValueError):
            indices.entries(broken, "runs")


def test_json_map_query_takes_any_name(spark, tmp_path):
    names = ['a"b\\c', "x\ny z", "", "$1}", "plain", "\u0085"]
    spark.createDataFrame([(k + 1, n, 0, 0.5) for k, n in enumerate(names)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {(n, k + 1, 0.5) for k, n in enumerate(names)}
    assert set(map(tuple, source_queries.q_json_map(spark, str(tmp_path)).collect())) == want
    assert {(r.name, r.id, r.wall) for r in source_queries.q_json_index(spark, str(tmp_path)).collect()} == want


def test_supported_votes_by_squares_are_the_plain_ones(spark):
    # every vote was held against each segment of its page
    import random

    r = random.Random(5)
    at = lambda: r.choice([r.uniform(-9, 9), r.uniform(-900, 900), float(r.randrange(-9, 9)), 1e7 + r.uniform(0, 9)])
    segments = [(r.randrange(4), a := at(), b := at(), r.choice([a, a + r.uniform(-3, 3), at()]), r.choice([b, b + 2.25, at()])) for _ in range(400)] + [(0, None, 1.0, 2.0, 3.0), (None, 0.0, 0.0, 1.0, 1.0), (1, float("nan"), 0.0, 1.0, 1.0), (1, 0.0, 0.0, float("inf"), 0.0), (2, 0.0, 0.0, 0.0, 0.0)]
    votes = [(k, r.randrange(5), at(), at()) for k in range(3000)] + [(-1, 0, None, 1.0), (-2, None, 0.0, 0.0), (-3, 1, float("nan"), 0.0), (-4, 2, float("inf"), 0.0), (-5, 2, 2.25, 0.0), (-5, 2, 2.25, -0.0), (-6, 2, 1e300, 0.0)]
    v, s = spark.createDataFrame(votes, "id long, page int, x double, y double"), spark.createDataFrame(segments, "page int, ax double, ay double, bx double, by double")
    for near in (2.25, 0.0, 40.0):
        plain = v.join(s, (v.page == s.page) & (S.segment_distance(*map(F.col, ("x", "y", "ax", "ay", "bx", "by"))) <= near), "left_semi").select("page", "id", "x", "y")
        got = runs.supported_votes(v, s, "page", "x", "y", near)
        assert got.columns == ["page", "id", "x", "y"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert not [n for n in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "exists(" in n]
    assert runs.supported_votes(v, s.limit(0), "page", "x", "y", 1.0).count() == 0


def test_appended_rows_of_streams_stay_off_the_driver(spark, sf_dir):
    # the memory sink held all rows of the events on the driver
    got = run_queries.q_stream_counter_shares(spark, sf_dir)
    assert len(got.inputFiles()) > 0
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type AS key", "event_id AS seq", "value AS busy")
    last, want = {}, []
    for r in sorted(e.collect(), key=lambda r: r.seq):
        before = last.get(r.key)
        want.append((r.key, r.seq, before and max(0, r.busy - before[0]) / (r.seq - before[1])))
        last[r.key] = (r.busy, r.seq)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(share is None for _, _, share in want)
