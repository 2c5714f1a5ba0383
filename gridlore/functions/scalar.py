"""Scalar functions as column expressions: boxes, text, time, canonical JSON, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for the value of an equivalence parameter in a family digest.
SENTINEL = '"*"'


# boxes are arrays [left, top, right, bottom]
def box_area(b: Column, clamp: bool = False) -> Column:
    w, h = b[2] - b[0], b[3] - b[1]
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)) if clamp else w * h


def box_overlap(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def box_iou(a: Column, b: Column, clamp: bool = False) -> Column:
    """Overlap over union, 0 where the union is 0 or a box is null. clamp: inverted boxes have area 0."""
    both = box_overlap(a, b)
    union = box_area(a, clamp) + box_area(b, clamp) - both
    return F.coalesce(F.when(union > 0, both / union), F.lit(0.0))


def edge_errors(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def valid_box(b: Column) -> Column:
    return F.coalesce((F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))) & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))


def clamp_box(b: Column, scale: Column, width: Column, height: Column) -> Column:
    """Rescaled, half-even rounded, and held within an image."""
    most = F.array(width, height, width, height)
    return F.zip_with(b, most, lambda x, m: F.least(F.greatest(F.bround(x * scale).cast("int"), F.lit(0)), m))


def grade_box(iou: Column, worst_edge: Column, least_iou: float, most_edge: float, near_iou: float, near_edge: float) -> Column:
    return F.when(iou.isNull() | worst_edge.isNull(), "fail").when((iou >= least_iou) & (worst_edge <= most_edge), "pass").when((iou >= near_iou) & (worst_edge <= near_edge), "near_pass").otherwise("fail")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def box_of_points(points: Column, width: Column, height: Column) -> Column:
    """The box around points (arrays [x, y]), on whole pixels and held within an image; null without points."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    lo = lambda a: F.greatest(F.lit(0), F.floor(F.array_min(a)).cast("int"))
    hi = lambda a, most: F.least(most, F.ceil(F.array_max(a)).cast("int"))
    return F.when(F.size(points) > 0, F.array(lo(x), lo(y), hi(x, width), hi(y, height)))


def downscale(width: Column, height: Column, most: Column) -> Column:
    """The factor that brings the longer side to `most` at most; images are never enlarged."""
    return F.least(F.lit(1.0), most / F.greatest(width, height))


def first_box(*boxes: Column) -> Column:
    """The first box without null sides."""
    return F.coalesce(*(F.when((F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull()), b) for b in boxes))


def crossing(a: Column, b: Column) -> Column:
    """[x, y] where two lines meet, each [a, b, c] of a x + b y = c; null if they are parallel."""
    det = a[0] * b[1] - b[0] * a[1]
    return F.when(F.abs(det) > 1e-9, F.array((a[2] * b[1] - b[2] * a[1]) / det, (a[0] * b[2] - b[0] * a[2]) / det))


def corners_in_order(points: Column) -> Column:
    """Corners [x, y] in their order about the middle, from the one nearest the origin (least x + y) on."""
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / F.size(points)
    around = F.transform(F.array_sort(F.transform(points, lambda p: F.struct(F.atan2(p[1] - mean(1), p[0] - mean(0)).alias("a"), p.alias("p")))), lambda z: z.p)
    sums = F.transform(around, lambda p: p[0] + p[1])
    at = F.array_position(sums, F.array_min(sums)).cast("int")
    return F.concat(F.slice(around, at, F.size(around)), F.slice(around, 1, at - 1))


# text
def known_text(x: Column, text: Column) -> Column:
    """text where x is a number, else unknown."""
    return F.when(x.try_cast("double").isNull(), "unknown").otherwise(text)


def percent_text(x: Column, digits: int = 1) -> Column:
    return known_text(x, F.format_string(f"%.{digits}f%%", x.try_cast("double") * 100))


def decimal_text(x: Column, digits: int = 4) -> Column:
    return known_text(x, F.format_string(f"%.{digits}f", x.try_cast("double")))


def short_text(x: Column, length: int = 12) -> Column:
    return F.coalesce(F.nullif(F.left(F.trim(x), F.lit(length)), F.lit("")), F.lit("unknown"))


def short_name(alias: Column, profile: Column, id_: Column) -> Column:
    """A parameter set's alias, else its profile, else its id's first twelve characters."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(alias), blank(profile), short_text(id_))


def runner_title(label: Column, name: Column, cpus: Column) -> Column:
    """Label, the name if it says something else, and the processors."""
    label = F.coalesce(F.nullif(label, F.lit("")), F.lit("unknown"))
    name = F.trim(F.coalesce(name, F.lit("")))
    other = F.when((name != "") & (F.lower(name) != F.lower(label)), F.concat(F.lit(" \u2014 "), name)).otherwise("")
    return F.concat(label, other, F.when(F.coalesce(cpus, F.lit(0)) != 0, F.format_string(" (%d vCPU)", cpus)).otherwise(""))


def runner_key(label: Column, name: Column, labels: Column, model: Column, cpus: Column) -> Column:
    """Sixteen digits of the digest of a runner's identity; the order of its labels says nothing."""
    q = lambda c: F.when(c.isNotNull(), F.to_json(F.struct(c.alias("x"))))
    value = lambda c: F.coalesce(F.regexp_extract(q(c), r'^\{"x":(.*)\}$', 1), F.lit("null"))
    m = F.create_map(F.lit("runner_label"), value(label), F.lit("runner_name"), value(name), F.lit("labels"), value(F.array_join(F.array_sort(labels), ",")), F.lit("cpu_model"), value(model), F.lit("logical_cpu_count"), value(cpus))
    return F.left(parameter_digest(m), F.lit(16))


def without_section(text: Column, opening: str, closing: str, marker: str) -> Column:
    """text without the balanced section (opening ... closing, which may nest) that starts with opening and holds the marker right after it; without such a section as it is."""
    start = F.instr(text, opening + marker)
    parts = F.split(F.substring(text, start, F.length(text)), f"(?={_literal(opening)})|(?<={_literal(closing)})")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("rest"))

    def step(acc, part):
        depth = acc.depth + F.when(part.startswith(opening), 1).otherwise(0) - F.when(part.endswith(closing), 1).otherwise(0)
        return F.struct(F.when(acc.done, acc.depth).otherwise(depth).alias("depth"), (acc.done | (depth == 0)).alias("done"), F.when(acc.done, F.concat(acc.rest, part)).otherwise(acc.rest).alias("rest"))

    rest = F.aggregate(parts, zero, step)
    return F.when((start > 0) & rest.done, F.concat(F.substring(text, F.lit(1), start - 1), rest.rest)).otherwise(text)


def _literal(x: str) -> str:
    import re

    return re.escape(x)


def found_id(text: Column, pattern: str) -> Column:
    """The first group of a pattern in a text, null if blank or absent."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def slug(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\w.-]", "_")


def natural_key(x: Column, width: int = 20) -> Column:
    """Sorts digit runs as numbers and other text without case."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"([0-9]+|[^0-9]+)"), 1), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")


def duration(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s, 3s; unknown for null and negative ones."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(s.isNull() | (s < 0), "unknown").when(s >= 3600, F.format_string("%dh %02dm %02ds", h, m, r)).when(s >= 60, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def byte_size(n: Column) -> Column:
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    out = None
    for k, u in reversed(list(enumerate(units))):
        hit = n >= 1024**k if k else F.lit(True)
        text = F.format_string(f"%.1f {u}", n / F.lit(float(1024**k))) if k else F.format_string("%d B", n)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return F.when(n.isNull(), "unknown").otherwise(out)


def whole(x: Column) -> Column:
    """A text as a whole number, null where it is none."""
    return F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x).try_cast("long"))


def finite(x: Column) -> Column:
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


# time
def iso_epoch(x: Column) -> Column:
    """Seconds since 1970 of an ISO text; without a zone it is UTC; 0 where it is none."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(x)) / 1e6, F.lit(0.0))


def utc_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shifted(t: Column, seconds: Column | None = None, micros: Column | None = None) -> Column:
    """A time some seconds later, or if these are null some microseconds."""
    by = F.coalesce(*(x for x in (None if seconds is None else F.floor(seconds * 1_000_000).cast("long"), micros) if x is not None))
    return F.timestamp_micros(F.unix_micros(t) + by)


# canonical JSON and digests; values of the map are JSON scalars as text
def canonical_json(m: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit('"'), F.replace(F.replace(e.key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":'), F.coalesce(e.value, F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def parameter_digest(m: Column) -> Column:
    return F.sha2(canonical_json(m), 256)


def family_digest(m: Column, enrolled: list[str]) -> Column:
    """Of the parameters with those of the equivalence family put to one value."""
    return parameter_digest(F.transform_values(m, lambda k, v: F.when(k.isin(enrolled), SENTINEL).otherwise(v)))


def identity_digest(detector: Column, schema_version: Column, m: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", detector, schema_version, canonical_json(m)), 256)


def merged_json(a: Column, b: Column) -> Column:
    """Maps of maps (name, field to JSON text), the second over the first at both levels."""
    inner = lambda x, y: F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y)
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(inner(x, y)))


def displayed(json: Column) -> Column:
    """A JSON scalar as shown: numbers with a point to six significant digits, texts without quotes."""
    g = F.format_string("%.6g", json.try_cast("double"))
    plain = F.when(g.contains("."), F.regexp_replace(g, r"\.?0+(e|$)", "$1")).otherwise(g)
    return F.when(json.rlike(r"^-?[0-9]+(\.[0-9]+([eE][-+]?[0-9]+)?|[eE][-+]?[0-9]+)$"), plain).when(json.rlike('^".*"$'), F.substring(json, F.lit(2), F.length(json) - 2)).otherwise(json)


def compatibility_key(context: Column) -> Column:
    """Digest of what must agree for two records to compare: a map of JSON texts."""
    return parameter_digest(context)


def defaulted(m: Column) -> Column:
    return F.coalesce(m, F.create_map().cast("map<string,string>"))
