"""What a page image shows: ground colour, page and content boxes, skew, tone, quality; a row for each image, failures too.

Images are rows as in `detect`. All in numpy: rotations and reductions take the nearest pixel or block means,
so that figures need not agree with an imaging library's to the last digit.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import ship
from . import detect as D
from . import planning as P


@dataclass(frozen=True)
class Limits:
    """Sizes as shares of the image, tones in grey levels, angles in degrees."""

    longest: int = 1800
    ink: int = 238
    least_content: float = 0.00002
    padding: float = 0.008
    border: float = 0.035
    distance: int = 28
    occupancy: float = 0.18
    smoothing: float = 0.008
    least_page: float = 0.25
    skew: float = 3.0
    skew_step: float = 0.25
    blank: float = 0.004
    low_contrast: float = 22.0
    blurry: float = 8.0
    over: float = 244.0
    under: float = 65.0
    review: float = 0.62
    fail: float = 0.35


def colours(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 3 else np.repeat(image[:, :, None], 3, 2)


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb[:, :, 0] * 0.299 + rgb[:, :, 1] * 0.587 + rgb[:, :, 2] * 0.114).astype(np.uint8)


def border_pixels(rgb: np.ndarray, share: float) -> np.ndarray:
    """The pixels of the four edge strips, each once."""
    h, w = rgb.shape[:2]
    x, y = max(2, round(w * share)), max(2, round(h * share))
    return np.concatenate([p.reshape(-1, 3) for p in (rgb[:y], rgb[h - y :], rgb[y : h - y, :x], rgb[y : h - y, w - x :])])


def ground_colour(rgb: np.ndarray, share: float = 0.035, most: int = 250_000) -> np.ndarray:
    p = border_pixels(rgb, share)
    return np.rint(np.median(p[:: max(1, len(p) // most)] if len(p) > most else p, axis=0)).astype(int)


def ground_mask(rgb: np.ndarray, colour: np.ndarray, least: int = 28) -> np.ndarray:
    """What differs from the ground in any channel by more than the border's own noise."""
    far = lambda p: np.abs(p.astype(int) - colour).max(-1)
    noise = np.sort(far(border_pixels(rgb, 0.035)))
    p99 = noise[min(len(noise) - 1, round(len(noise) * 0.99))] if len(noise) else 0
    return far(rgb) >= max(least, int(p99) + 8)


def smoothed(values: np.ndarray, radius: int) -> np.ndarray:
    """Means over a radius, which the ends cut."""
    sums, at = np.concatenate([[0.0], np.cumsum(values)]), np.arange(len(values))
    lo, hi = np.maximum(0, at - radius), np.minimum(len(values), at + radius + 1)
    return (sums[hi] - sums[lo]) / (hi - lo)


def longest_run(on: np.ndarray) -> tuple[int, int] | None:
    """The longest stretch with holes of up to four thousandths of the length, the first of equal ones; one that is open at the end goes to the end."""
    hole, at = max(1, round(len(on) * 0.004)), np.flatnonzero(on)
    if not len(at):
        return None
    cut = np.flatnonzero(np.diff(at) > hole + 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1
    if len(on) - last[-1] <= hole:
        last[-1] = len(on)
    k = int(np.argmax(last - first))
    return int(first[k]), int(last[k])


def _padded(box: tuple[int, int, int, int], shape: tuple[int, int], share: float) -> list[int]:
    (h, w), (l, t, r, b) = shape, box
    x, y = round(w * share), round(h * share)
    return [max(0, l - x), max(0, t - y), min(w, r + x), min(h, b + y)]


def page_box(rgb: np.ndarray, c: Limits = Limits()) -> list[int] | None:
    """The page by sustained occupancy of rows and columns with what is not ground."""
    h, w = rgb.shape[:2]
    mask = ground_mask(rgb, ground_colour(rgb, c.border), c.distance)
    rows = longest_run(smoothed(mask.mean(1), max(1, round(h * c.smoothing))) >= c.occupancy)
    cols = longest_run(smoothed(mask.mean(0), max(1, round(w * c.smoothing))) >= c.occupancy)
    if rows is None or cols is None or (cols[1] - cols[0]) * (rows[1] - rows[0]) / max(1, w * h) < c.least_page:
        return None
    return _padded((cols[0], rows[0], cols[1], rows[1]), (h, w), c.padding)


def content_box(mask: np.ndarray, c: Limits = Limits()) -> list[int] | None:
    """The box of the set pixels, each widened by two, with padding; none if it is next to nothing."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return None
    h, w = mask.shape
    box = (max(0, int(xs.min()) - 2), max(0, int(ys.min()) - 2), min(w, int(xs.max()) + 3), min(h, int(ys.max()) + 3))
    return None if (box[2] - box[0]) * (box[3] - box[1]) < w * h * c.least_content else _padded(box, (h, w), c.padding)


def reduced(image: np.ndarray, longest: int) -> tuple[np.ndarray, float]:
    """The image at most so long, by means of blocks, and its scale."""
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image, 1.0
    scale = longest / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    ys, xs = (np.arange(n) * m // n for n, m in ((nh, h), (nw, w)))
    sums = np.add.reduceat(np.add.reduceat(image.astype(float), ys, 0), xs, 1)
    size = np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w))[None]
    return np.rint(sums / (size if image.ndim == 2 else size[:, :, None])).astype(np.uint8), scale


def _sources(h: int, w: int, degrees: float) -> np.ndarray:
    """Of each pixel of a turned image the place of its source in the flat one, h * w beyond the edges."""
    y, x = np.arange(h)[:, None], np.arange(w)[None]
    a, cx, cy = np.deg2rad(degrees), (w - 1) / 2, (h - 1) / 2
    u = np.rint(np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx)
    v = np.rint(np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy)
    inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    return np.where(inside, v * w + u, h * w).astype(np.int32 if h * w < 1 << 31 else np.int64)


#: Places of small images stay with a worker, as its pages are often of one size: 1 MB an angle at most.
_kept_sources, KEPT_PIXELS = functools.lru_cache(maxsize=32)(_sources), 1 << 18


def turned(mask: np.ndarray, degrees: float) -> np.ndarray:
    """The mask turned about its middle (counter-clockwise), unset beyond its edges."""
    h, w = mask.shape
    return np.append(mask, np.zeros(1, mask.dtype)).take((_kept_sources if h * w <= KEPT_PIXELS else _sources)(h, w, float(degrees)))


def skew(g: np.ndarray, c: Limits = Limits()) -> tuple[float, float]:
    """The angle at which rows of ink are sharpest, and how much sharper than at the next best."""
    ink = reduced((g < min(c.ink, 215)).astype(np.uint8) * 255, 1000)[0] > 0
    if len(ink) < 3:
        return 0.0, 0.0
    angles = np.arange(-c.skew, c.skew + 1e-9, c.skew_step)
    sharp = np.array([(np.diff(turned(ink, a).sum(1).astype(float)) ** 2).sum() / max(1, ink.shape[1] ** 2) for a in angles])
    order = np.lexsort((-angles, -sharp))
    best, next_ = sharp[order[0]], sharp[order[1]] if len(order) > 1 else 0.0
    sure = 0.0 if best <= 0 else float(np.clip((best - next_) / best * 6, 0, 1))
    return round(float(-angles[order[0]]), 3), round(sure, 3)


def uniformity(g: np.ndarray) -> float:
    """One less the mean spread of the four edge strips."""
    n = max(2, round(min(g.shape) * 0.04))
    return float(np.clip(1 - np.mean([x.std() for x in (g[:n], g[-n:], g[:, :n], g[:, -n:])]) / 55, 0, 1))


def faint_texture(g: np.ndarray) -> float:
    """Share of pixels that differ a little (8 to 44 levels) from their wide surround."""
    small = reduced(g, 800)[0].astype(float)
    k = np.exp(-0.5 * (np.arange(-30, 31) / 10) ** 2)
    k /= k.sum()
    wide = small
    for axis in (0, 1):
        pad = [(30, 30) if axis == a else (0, 0) for a in (0, 1)]
        wide = np.lib.stride_tricks.sliding_window_view(np.pad(wide, pad, "edge"), len(k), axis) @ k
    rest = np.abs(small - np.rint(wide))
    return float(((rest >= 8) & (rest < 45)).mean())


def sharpness(g: np.ndarray) -> float:
    """Variance of the image of edges (eight times a pixel less its neighbours, held to grey levels)."""
    x = g.astype(float)
    if min(x.shape) < 3:
        return 0.0
    around = sum(x[1 + i : x.shape[0] - 1 + i, 1 + j : x.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
    edges = x.copy()  # the outermost pixels stay
    edges[1:-1, 1:-1] = np.clip(8 * x[1:-1, 1:-1] - around, 0, 255)
    return float(edges.var())


def tones(g: np.ndarray) -> dict[str, float]:
    """Brightness, contrast, range of the middle nine tenths, entropy, shares of dark and light pixels, sharpness."""
    hist = np.bincount(g.ravel(), minlength=256)
    total, cum = max(1, hist.sum()), np.cumsum(hist)
    p = hist[hist > 0] / total
    at = lambda q: int(np.searchsorted(cum, total * q))
    return {
        "brightness": float(g.mean()) if g.size else 0.0, "contrast": float(g.std()) if g.size else 0.0, "range": float(at(0.95) - at(0.05)), "entropy": float(-(p * np.log2(p)).sum()),
        "dark": float(hist[:80].sum() / total), "light": float(hist[245:].sum() / total), "sharpness": sharpness(g),
    }


def analysed(image: np.ndarray, c: Limits = Limits()) -> dict:
    """All that is measured of one image; boxes are in its own pixels, [0, 0, 0, 0] for none."""
    rgb = colours(image)
    h, w = rgb.shape[:2]
    work, scale = reduced(rgb, c.longest)
    g = grey(work)
    small = page_box(work, c)
    box = [0, 0, 0, 0] if small is None else [max(0, min(m, round(v / scale))) for v, m in zip(small, (w, h, w, h))]
    inner = g if small is None else g[small[1] : small[3], small[0] : small[2]]
    near = max(3, round(min(w, h) * 0.005))
    touches = box[2] > box[0] and (min(box[0], box[1]) <= near or w - box[2] <= near or h - box[3] <= near)
    angle, sure = skew(g, c)
    return {"scale": scale, "box": box, "content": (box[2] - box[0]) * (box[3] - box[1]) / max(1, w * h), "touches": touches, "skew": angle, "skew_confidence": sure, "uniformity": uniformity(inner), "bleed": faint_texture(inner), **tones(inner)}


_MEASURES = ("scale", "content", "skew", "skew_confidence", "uniformity", "bleed", "brightness", "contrast", "range", "entropy", "dark", "light", "sharpness")


def analyse(images: DataFrame, c: Limits = Limits()) -> DataFrame:
    """A row for each image: size, page box, measures, flags, reasons, score and status (pass, review, fail, error)."""
    ship(images.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    x = analysed(D.pixels(r.pixels, r.height, r.width), c)
                    rows.append((r.page_id, r.width, r.height, x["box"], x["touches"], *(float(x[m]) for m in _MEASURES), None))
                except Exception as e:  # a failed page is a row
                    rows.append((r.page_id, r.width, r.height, [0, 0, 0, 0], False, *(0.0 for _ in _MEASURES), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["page_id", "width", "height", "box", "touches", *_MEASURES, "error"])

    m = images.select("page_id", "height", "width", "pixels").mapInPandas(run, "page_id long, width int, height int, box array<int>, touches boolean, " + ", ".join(f"{x} double" for x in _MEASURES) + ", error string")
    col = F.col
    flags = {
        "blank": col("dark") <= c.blank, "low_contrast": col("contrast") < c.low_contrast, "blurry": col("sharpness") < c.blurry,
        "overexposed": (col("brightness") > c.over) | (col("light") > 0.93), "underexposed": col("brightness") < c.under,
    }
    m = m.withColumns({k: v & col("error").isNull() for k, v in flags.items()})
    said = [F.when(col(k), F.lit(k)) for k in flags] + [F.when(col("touches"), "touches_border"), F.when((col("content") < 0.05) & ~col("blank"), "small_content")]
    m = m.withColumn("reasons", F.when(col("error").isNotNull(), F.array(F.lit("analysis_error"))).otherwise(F.array_compact(F.array(*said))))
    score = F.round(P.quality(col("brightness"), col("contrast"), col("sharpness"), col("content"), col("touches"), col("blank")), 3)
    m = m.withColumn("score", F.when(col("error").isNotNull(), 0.0).otherwise(score))
    return m.withColumn("status", F.when(col("error").isNotNull(), "error").otherwise(P.quality_status(col("score"), col("reasons"), c.fail, c.review)))


def mask_score(mask: np.ndarray, box: list[int] | None) -> float:
    """How well a box holds a mask: half for what it is full of, three tenths for its size, a fifth for what is empty beside it."""
    if box is None or box[2] <= box[0] or box[3] <= box[1]:
        return 0.0
    inside = np.zeros(mask.shape, bool)
    inside[box[1] : box[3], box[0] : box[2]] = True
    if not inside.any():
        return 0.0
    out = mask[~inside]
    size = min(1.0, (box[2] - box[0]) * (box[3] - box[1]) / max(1, mask.size) / 0.55)
    return float(np.clip(0.50 * mask[inside].mean() + 0.30 * size + 0.20 * (1 - (out.mean() if out.size else 0.0)), 0, 1))


def polygon_mask(points: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixels in or on a convex polygon with corners on whole pixels."""
    p = np.rint(np.asarray(points, float))
    y, x = np.mgrid[: shape[0], : shape[1]]
    side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(p, np.roll(p, -1, 0))]
    return np.all([s >= 0 for s in side], 0) | np.all([s <= 0 for s in side], 0)


def polygon_iou(a: np.ndarray, b: np.ndarray, shape: tuple[int, int]) -> float:
    one, two = polygon_mask(a, shape), polygon_mask(b, shape)
    union = (one | two).sum()
    return float((one & two).sum() / union) if union else 0.0


def detect_document(images: DataFrame, method: str, parameters: str = "{}", longest: int = 1800) -> DataFrame:
    """One parameter set on all pages of a collection: found on reduced images, boxes in the pixels of the given ones."""
    sets = images.sparkSession.createDataFrame([(method, parameters)], "method string, parameters string")
    found = D.found(images, sets, lambda image: reduced(image, longest)[0])
    scale = F.greatest(F.lit(1.0), F.greatest("height", "width") / F.lit(float(longest)))
    box = S.clamp_box(F.col("box").cast("array<double>"), scale, F.col("width"), F.col("height"))
    return found.withColumn("box", F.when(F.col("box").isNotNull(), box.cast("array<int>"))).drop("height", "width")
