import numpy as np
import pytest
from gridlore.operators import detect, pages
from pyspark.sql import functions as F


def drawn(height=240, width=320, box=(60, 40, 270, 200)):
    rng = np.random.default_rng(3)
    image = np.full((height, width, 3), (10, 20, 60), np.uint8) + rng.integers(0, 5, (height, width, 3), dtype=np.uint8)
    image[box[1] : box[3], box[0] : box[2]] = (225, 215, 190)
    for y in range(box[1] + 20, box[3] - 20, 12):
        image[y : y + 4, box[0] + 20 : box[2] - 20] = (40, 35, 30)
    return image


def test_ground_and_page_box():
    image = drawn()
    assert np.abs(pages.ground_colour(image) - [12, 22, 62]).max() <= 1
    mask = pages.ground_mask(image, pages.ground_colour(image))
    assert mask[40:200, 60:270].all() and not mask[:38].any()
    assert np.abs(np.array(pages.page_box(image)) - [57, 38, 273, 202]).max() <= 3
    assert pages.page_box(np.full((100, 100, 3), 50, np.uint8)) is None
    assert pages.content_box(np.zeros((50, 50), bool)) is None
    one = np.zeros((100, 200), bool)
    one[40:60, 50:90] = True
    assert pages.content_box(one) == [46, 37, 94, 63]


def test_runs_and_means_by_hand():
    assert pages.longest_run(np.array([1, 1, 0, 1, 0, 0, 1, 1, 1, 0], bool)) == (0, 4)
    assert pages.longest_run(np.array([0, 1, 0, 0, 1, 1, 0], bool)) == (4, 7) and pages.longest_run(np.zeros(5, bool)) is None
    assert pages.smoothed(np.array([0.0, 3, 6, 9]), 1).tolist() == [1.5, 3, 6, 7.5]


@pytest.mark.parametrize("angle", [-2.0, 0.0, 1.5])
def test_skew(angle):
    lines = np.full((300, 400), 255, np.uint8)
    for y in range(60, 240, 16):
        lines[y : y + 4, 60:340] = 0
    ink = pages.turned(lines < 128, angle)
    found, sure = pages.skew(np.where(ink, 0, 255).astype(np.uint8))
    assert abs(found - angle) <= 0.5 and 0 <= sure <= 1


def test_tones_and_scores():
    g = pages.grey(drawn())
    t = pages.tones(g)
    p = np.bincount(g.ravel(), minlength=256) / g.size
    assert t["brightness"] == pytest.approx(g.mean()) and t["contrast"] == pytest.approx(g.std()) and t["entropy"] == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum())
    flat = np.full((60, 60), 77, np.uint8)
    assert pages.uniformity(flat) == 1.0 and pages.faint_texture(flat) == 0.0
    mask = np.zeros((100, 100), bool)
    mask[10:90, 10:90] = True
    assert pages.mask_score(mask, [10, 10, 90, 90]) == pytest.approx(1.0) and pages.mask_score(mask, None) == pages.mask_score(mask, [5, 5, 5, 9]) == 0.0
    square = np.array([[0, 0], [9, 0], [9, 9], [0, 9]])
    assert pages.polygon_iou(square, square, (20, 20)) == 1.0 and pages.polygon_iou(square, square + [5, 0], (20, 20)) == pytest.approx(50 / 150)
    assert pages.polygon_iou(square, square + 30, (20, 20)) == 0.0
    half, scale = pages.reduced(np.arange(16, dtype=np.uint8).reshape(4, 4) * 10, 2)
    assert scale == 0.5 and half.tolist() == [[25, 45], [105, 125]]


def test_rows_for_pages_and_failures(spark):
    good = drawn()
    rows = [(1, 240, 320, bytearray(good.tobytes())), (2, 240, 320, bytearray(b"short")), (3, 60, 80, bytearray(np.full((60, 80), 250, np.uint8).tobytes()))]
    images = spark.createDataFrame(rows, "page_id long, height int, width int, pixels binary")
    got = {r.page_id: r for r in pages.analyse(images).collect()}
    assert got[1].status in ("pass", "review") and got[1].error is None and np.abs(np.array(got[1].box) - [57, 38, 273, 202]).max() <= 3
    assert (got[2].status, got[2].score, got[2].reasons) == ("error", 0.0, ["analysis_error"]) and got[3].status == "fail" and "blank" in got[3].reasons
    boxes = {r.page_id: r for r in pages.detect_document(images, "projection_box", longest=100).collect()}
    assert boxes[1].status == "ok" and np.abs(np.array(boxes[1].box) - [60, 40, 270, 200]).max() <= 10 and boxes[2].status == "error"


def test_sets_are_checked_for_size(spark, monkeypatch):
    monkeypatch.setattr(detect, "SET_BYTES", 30)
    sets = spark.createDataFrame([("projection_box", "{}"), ("contour", "{}")], "method string, parameters string")
    with pytest.raises(ValueError, match="bytes of parameter sets"):
        detect.detect(detect.rectangles(spark, 1), sets)


def test_pages_of_one_file_are_drawn_and_analysed_by_many_tasks(spark, tmp_path, monkeypatch):
    # the task that read the few rows drew and analysed all pages, and each angle of a page was reckoned anew
    boxes = spark.range(300).selectExpr("id AS page_id", "array(3 + cast(id % 20 AS int), 2, 40, 30) AS expected")
    boxes.coalesce(1).write.parquet(f"{tmp_path}/boxes")
    images = detect.drawn(spark.read.parquet(f"{tmp_path}/boxes"), 48, 64)
    tasks = [r["n"] for r in images.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == 300 and len(tasks) > 1
    monkeypatch.setattr(detect, "DRAWN_BYTES", 48 * 64 * 10)
    assert detect.drawn(spark.read.parquet(f"{tmp_path}/boxes"), 48, 64).rdd.getNumPartitions() == 30
    first = images.where("page_id = 7").first()
    want = np.random.default_rng(7).integers(8, 14, (48, 64), dtype=np.uint8)
    want[2:30, 10:40] = 215
    assert bytes(first.pixels) == want.tobytes() and list(first.expected) == [10, 2, 40, 30] and (first.height, first.width) == (48, 64)
    assert {r.page_id: r.error for r in pages.analyse(images).collect()} == dict.fromkeys(range(300))


def test_turned_masks_are_the_plain_ones():
    rng = np.random.default_rng(5)
    for h, w in ((1, 1), (7, 50), (120, 90), (700, 500)):  # the last is too large to be kept
        mask = rng.random((h, w)) < 0.3
        for degrees in (-3.0, 0.0, 0.25, 40.0):
            y, x = np.mgrid[:h, :w]
            a, cx, cy = np.deg2rad(degrees), (w - 1) / 2, (h - 1) / 2
            u = np.rint(np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx).astype(int)
            v = np.rint(np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy).astype(int)
            inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
            want = np.zeros_like(mask)
            want[inside] = mask[v[inside], u[inside]]
            got = pages.turned(mask, degrees)
            assert got.dtype == bool and (got == want).all()


def test_documents_are_reduced_and_searched_in_one_pass(spark):
    # images went through a worker to be reduced and one to be searched, and were drawn again for their sizes
    good, low = drawn(), drawn(180, 320, (60, 40, 270, 150))
    rows = [(1, 240, 320, bytearray(good.tobytes())), (1, 180, 320, bytearray(low.tobytes())), (None, 240, 320, bytearray(good.tobytes())), (4, 240, 320, None), (5, None, 320, bytearray(b"x"))]
    images = spark.createDataFrame(rows, "page_id long, height int, width int, pixels binary")
    found = pages.detect_document(images, "projection_box", longest=100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan and "Join" not in plan
    assert found.columns == ["page_id", "method", "parameters", "status", "box", "score", "error"]
    got = sorted(((r.page_id or 0, r.status, r.box) for r in found.collect()), key=str)
    assert [x[:2] for x in got] == [(0, "ok"), (1, "ok"), (1, "ok"), (4, "error"), (5, "error")]
    assert sorted(b[3] <= 160 for k, _, b in got if k == 1) == [False, True]


def test_detectors_on_one_file_of_orders_run_in_many_tasks(spark, sf_dir):
    # F7, F8: one task drew the pages of a file and held all detectors against them
    from gridlore.plans import catalogue

    found = catalogue.q_udf_detector(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    tasks = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == 4 * n and len(tasks) > 1 and max(tasks) < 2 * n
    absent = catalogue._detectors(spark, sf_dir).where("method = 'absent'").groupBy("error").count().collect()
    assert len(absent) == 1 and absent[0]["count"] == n and "KeyError: 'absent'" in absent[0].error
