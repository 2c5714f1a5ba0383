"""Black-box page detectors as functions of (image, parameters), run in Arrow batches with failures as rows.

An image is a row: page_id, height, width, pixels (uint8, row by row; one or three channels). A
detector is a caller's function, which `register` names and which travels with the tasks; it returns a box
[left, top, right, bottom] and a score, or none. Its exceptions become rows with status error. One by
projections is built in.
"""

from __future__ import annotations

import functools
import json
import traceback
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

Detector = Callable[[np.ndarray, dict], "tuple[list[int], float] | None"]
REGISTRY: dict[str, Detector] = {}


def register(name: str, takes: str | None = None):
    """Registers a detector. takes has the names of its parameters; others raise. None leaves all to the detector."""

    def put(f: Detector) -> Detector:
        if takes is None:
            REGISTRY[name] = f
            return f
        known = set(takes.split())

        @functools.wraps(f)
        def checked(image: np.ndarray, p: dict):
            if unknown := sorted(set(p) - known):
                raise ValueError(f"unknown parameters of {name}: {', '.join(unknown)}")
            return f(image, p)

        REGISTRY[name] = checked
        return checked

    return put


def gray(image: np.ndarray) -> np.ndarray:
    return image.astype(float) if image.ndim == 2 else image.astype(float).mean(2)


def border_level(g: np.ndarray, share: float = 0.04) -> float:
    """Median of the four border strips."""
    k = max(1, int(min(g.shape) * share))
    return float(np.median(np.concatenate([g[:k].ravel(), g[-k:].ravel(), g[:, :k].ravel(), g[:, -k:].ravel()])))


def difference_mask(g: np.ndarray, least: float = 18) -> np.ndarray:
    """Pixels that differ from the border by more than its own spread."""
    level = border_level(g)
    k = max(1, int(min(g.shape) * 0.04))
    spread = np.percentile(np.abs(np.concatenate([g[:k].ravel(), g[-k:].ravel(), g[:, :k].ravel(), g[:, -k:].ravel()]) - level), 99)
    return np.abs(g - level) >= max(least, spread + 5)


def longest_run(on: np.ndarray, gap: int) -> tuple[int, int] | None:
    """First longest stretch of set positions with gaps of at most gap; one open at the end goes to the end."""
    at = np.flatnonzero(on)
    if not len(at):
        return None
    cuts = np.flatnonzero(np.diff(at) > gap + 1)
    starts, ends = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])] + 1
    ends = np.where(len(on) - ends <= gap, len(on), ends)
    k = int(np.argmax(ends - starts))
    return int(starts[k]), int(ends[k])


@register("projection_box", "least share")
def projection_box(image: np.ndarray, p: dict):
    mask = difference_mask(gray(image), p.get("least", 18))
    share = p.get("share", 0.25)
    rows, cols = (longest_run(mask.mean(a) >= share, max(1, round(0.004 * mask.shape[1 - a]))) for a in (1, 0))
    if not rows or not cols:
        return None
    return [cols[0], rows[0], cols[1], rows[1]], float(mask[rows[0] : rows[1], cols[0] : cols[1]].mean())


SCHEMA = "page_id long, method string, parameters string, status string, box array<int>, score double, error string"


#: Bytes of parameter sets that go to every task at most.
SET_BYTES = 64 << 20


def pixels(raw: bytes, height: int, width: int) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8)
    return flat.reshape((height, width) if len(flat) == height * width else (height, width, 3))


def detect(images: DataFrame, sets: DataFrame) -> DataFrame:
    """Every (method, parameters) row on every image. An image goes to Python once: the sets (a search's, small by contract, their size is checked) are broadcast, and images are never shuffled."""
    return found(images, sets).drop("height", "width")


def found(images: DataFrame, sets: DataFrame, before: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """As `detect`, with the height and width of the given image. before: what is done to an image first, in the same task."""
    spark = images.sparkSession
    ship(spark)
    own = {n: f for n, f in REGISTRY.items() if not f.__module__.startswith(__package__)}  # registered by a caller: they travel with the task
    size = sets.agg(F.sum(F.coalesce(F.octet_length("method"), F.lit(0)) + F.coalesce(F.octet_length("parameters"), F.lit(0)) + 16)).first()[0] or 0
    if size > SET_BYTES:
        raise ValueError(f"{size} bytes of parameter sets; cut them into searches of {SET_BYTES}")
    shared = spark.sparkContext.broadcast([(r.method, r.parameters) for r in sets.select("method", "parameters").collect()])

    def one(image: np.ndarray, method: str, parameters: str | None) -> tuple:
        status, box, score, error = "no_candidate", None, 0.0, None
        try:
            at = (own.get(method) or REGISTRY[method])(image, json.loads(parameters or "{}"))
            if at:
                status, box, score = "ok", [int(x) for x in at[0]], float(at[1])
        except Exception:  # a failed page is a row
            status, box, score, error = "error", None, 0.0, traceback.format_exc(limit=1)
        return method, parameters, status, box, score, error

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.float64(), pa.string()]
    names = ["page_id", "height", "width", "method", "parameters", "status", "box", "score", "error"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown: dict[str, tuple] = {}  # methods that nobody registered fail alike on all images
        for batch in batches:
            rows: list[tuple] = []
            for k, h, w, raw in zip(*(batch.column(n).to_pylist() for n in ("page_id", "height", "width")), batch.column("pixels")):
                try:
                    image = pixels(raw.as_buffer(), h, w)
                    if before:
                        image = before(image)
                except Exception:
                    said = traceback.format_exc(limit=1)
                    rows += [(k, h, w, *x, "error", None, 0.0, said) for x in shared.value]
                else:
                    for x in shared.value:
                        if x[0] not in own and x[0] not in REGISTRY:
                            if x not in unknown:
                                unknown[x] = one(image, *x)
                            rows.append((k, h, w, *unknown[x]))
                        else:
                            rows.append((k, h, w, *one(image, *x)))
                if len(rows) >= 5000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    rows = images.select(F.col("page_id").cast("long").alias("page_id"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels")
    return rows.mapInArrow(run, SCHEMA.replace("page_id long", "page_id long, height int, width int"))


#: Bytes of pixels that a task draws at most, and the rows that are worth a task.
DRAWN_BYTES, DRAWN_ROWS = 16 << 20, 32


def drawn(boxes: DataFrame, height: int = 240, width: int = 320) -> DataFrame:
    """Images of boxes (page_id, expected: left, top, right, bottom): a bright rectangle on a dark ground with some noise.

    The rows, which are small, are dealt out first: a file of them that is one task to read makes pages for many.
    """

    def draw(batches):
        for whole in batches:
            for b in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                images = np.empty((b.num_rows, height, width), np.uint8)
                for image, k, box in zip(images, b.column("page_id").to_pylist(), b.column("expected").to_pylist()):
                    left, top, right, bottom = box
                    image[:] = np.random.default_rng(abs(k)).integers(8, 14, (height, width), dtype=np.uint8)
                    image[top:bottom, left:right] = 215
                ends = pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * (height * width))
                pixels = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(images)])
                size = [pa.array(np.full(b.num_rows, x, np.int32)) for x in (height, width)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), *size, pixels, b.column("expected")], ["page_id", "height", "width", "pixels", "expected"])

    spark = boxes.sparkSession
    ship(spark)
    step = max(1, (DRAWN_BYTES // 4) // max(1, height * width))
    rows = boxes.select(F.col("page_id").cast("long").alias("page_id"), F.col("expected").cast("array<int>").alias("expected"))
    n = rows.count()
    tasks = max(-(-n * height * width // DRAWN_BYTES), min(spark.sparkContext.defaultParallelism, n // DRAWN_ROWS), 1)
    return rows.repartition(tasks, "page_id").mapInArrow(draw, "page_id long, height int, width int, pixels binary, expected array<int>")


def rectangles(spark, n: int) -> DataFrame:
    """Pages whose place depends on their number."""
    k = F.col("id")
    return drawn(spark.range(n).select(k.alias("page_id"), F.array(20 + k * 7 % 30, 20 + k * 11 % 30, F.lit(275), F.lit(210)).alias("expected")))


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame([(n, (f.__doc__ or "").strip()) for n, f in sorted(REGISTRY.items())], "method string, about string")


def method_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("method").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "ok", 1)).alias("n_ok"), F.count(F.when(F.col("status") == "error", 1)).alias("n_error"))
