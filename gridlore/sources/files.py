"""Files as tables: documents and the images in them, image headers, page images by number, frozen data, reports, system counters."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ordered as O
from ..session import ship

# Suffixes of page images, first choice first, and the names of processor counters.
SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp")
COUNTERS = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest", "guest_nice")
_DOC = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"
_BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, length, content of the files below a folder; the content is read only where it is used."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select("path", F.substring_index("path", "/", -1).alias("name"), "length", "content")


def word_documents(spark: SparkSession, path: str) -> DataFrame:
    """Word files with their place in natural order of their names."""
    from pyspark.sql import Window

    f = listed(spark, path, "*.docx")
    return f.withColumn("place", F.row_number().over(Window.orderBy(S.natural_key(F.col("name")), "path")))  # a row for each file of a collection


def relations(content: bytes) -> dict[str, str]:
    """Ids of a Word file's relations and the members that they point to."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in root.findall(_REL)}
    return {k: v[1:] if v.startswith("/") else f"word/{v}" for k, v in target.items() if k and v}


def embedded(content: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(id, member, bytes) of the images of a Word file as they come in the text; ids that point to nothing are passed over."""
    known = relations(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        there = set(z.namelist())
        for blip in ElementTree.fromstring(z.read("word/document.xml")).iter(_BLIP):
            member = known.get(blip.get(_DOC))
            if member in there:
                yield blip.get(_DOC), member, z.read(member)


def embedded_images(files: DataFrame) -> DataFrame:
    """path, pos, id, member, bytes for each image of each Word file; an unreadable file is one row with its error."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows = [(path, k, *x, None) for k, x in enumerate(embedded(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "pos", "id", "member", "bytes", "error"]).astype({"pos": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, pos long, id string, member string, bytes binary, error string")


def image_header(data: bytes | None) -> tuple[str | None, int | None, int | None, str | None]:
    """Format, width, height and mode by the first bytes of PNG, JPEG, GIF and BMP; nulls for others."""
    d = data or b""
    if d[:8] == b"\x89PNG\r\n\x1a\n" and len(d) >= 26:
        w, h, _, kind = struct.unpack(">IIBB", d[16:26])
        return "PNG", w, h, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(kind)
    if d[:6] in (b"GIF87a", b"GIF89a") and len(d) >= 10:
        return "GIF", *struct.unpack("<HH", d[6:10]), "P"
    if d[:2] == b"BM" and len(d) >= 30:
        w, h, _, bits = struct.unpack("<iiHH", d[18:30])
        return "BMP", w, abs(h), {8: "P", 24: "RGB", 32: "RGBA"}.get(bits)
    at = 2
    while d[:2] == b"\xff\xd8" and at + 9 < len(d):
        mark, size = d[at + 1], struct.unpack(">H", d[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w, n = struct.unpack(">HHB", d[at + 5 : at + 10])
            return "JPEG", w, h, {1: "L", 3: "RGB", 4: "CMYK"}.get(n)
        at += 2 + size
    return None, None, None, None


def image_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """files with format, width, height and mode of what they hold; Arrow batches, one call a file."""
    ship(files.sparkSession)

    @F.pandas_udf("format string, width int, height int, mode string")
    def header(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_header(None if v is None else bytes(v)) for v in x], columns=["format", "width", "height", "mode"]).astype({"width": "Int32", "height": "Int32"})

    return files.withColumn("_h", header(content)).select(*files.columns, "_h.*")


def page_images(files: DataFrame, prefix: str) -> DataFrame:
    """ordinal and path of page images `<prefix><number><suffix>`: of several the suffix's order decides, then those under raw/."""
    form = rf"^{prefix}(\d+)(\.[a-z]+)$"
    suffix = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.regexp_extract("name", form, 2))
    f = files.select("path", F.regexp_extract("name", form, 1).try_cast("int").alias("ordinal"), suffix.alias("_s"), F.when(F.col("path").rlike("/raw/[^/]+$"), 0).otherwise(1).alias("_d"))
    return f.where("ordinal is not null and _s > 0").groupBy("ordinal").agg(F.min_by("path", F.struct("_s", "_d", "path")).alias("path"))


def labelled_pages(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with a valid approved box and their image; a page whose image is absent is an error. labels: ordinal, approved (array)."""
    j = labels.where(S.valid_box(F.col("approved"))).join(images, "ordinal", "left")
    return j.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("no image of page "), F.col("ordinal").cast("string")))))


def record_path(columns: list[str], images: DataFrame, records: DataFrame) -> DataFrame:
    """records with image_path: the first non-blank of the columns, else the image with the record's ordinal."""
    own = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))
    return records.join(images.select("ordinal", F.col("path").alias("_found")), "ordinal", "left").withColumn("image_path", F.coalesce(own, "_found")).drop("_found")


def configurations(spark: SparkSession, path: str, schema: str, automatic_only: bool = False) -> DataFrame:
    """JSON objects of a folder's files, one a file; automatic is true unless a file says otherwise."""
    c = spark.read.schema(f"automatic boolean, {schema}").option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)
    return c.where(F.coalesce("automatic", F.lit(True))) if automatic_only else c


def manifest_errors(assets: DataFrame, suffix: str = ".docx") -> DataFrame:
    """assets (name, sha256) with what is wrong with them, else null."""
    bad = F.when(~F.coalesce(F.lower("name").endswith(suffix), F.lit(False)), "name").when(~F.coalesce(F.lower("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
    return assets.withColumn("error", bad)


def artifact_problem(content: Column, expected: Column, valid: Column) -> Column:
    return F.when(content.isNull(), "missing").when(expected.isNotNull() & (F.sha2(content, 256) != F.lower(expected)), "digest mismatch").when(~F.coalesce(valid, F.lit(True)), "validator failure")


def freeze_problems(content: Column, digest: Column, id_: Column, frozen_id: Column, ordinals: Column, frozen: Column) -> Column:
    """The first difference between data and its frozen form: digest, identity, membership (order counts); null if there is none."""
    return F.when(F.sha2(content, 256) != digest, "digest").when(~F.trim(id_).eqNullSafe(F.trim(frozen_id)), "identity").when(~F.coalesce(ordinals == frozen, F.lit(False)), "membership")


def performance_rows(summary: DataFrame) -> DataFrame:
    """Detectors of a catalogue with what was measured of them. summary: detectors array<struct<method, name, display_name>>, performance map<string, struct<runs, average_ms>>, statuses map<string, map<string, int>>."""
    r = summary.select(F.explode("detectors").alias("d"), "performance", "statuses").where("trim(coalesce(d.method, '')) <> ''")
    p, s = F.element_at("performance", F.col("d.method")), F.element_at("statuses", F.col("d.method"))
    count = lambda n: F.coalesce(F.element_at(s, F.lit(n)), F.lit(0)).alias(n)
    return r.select("d.method", F.coalesce("d.name", "d.display_name", "d.method").alias("name"), p["runs"].alias("runs"), p["average_ms"].alias("average_ms"), count("ok"), count("no_candidate"), count("error"))


def first_whole(*values: Column) -> Column:
    return F.coalesce(*(S.whole(v.cast("string")) for v in values))


def table_rows(lines: DataFrame, header: list[str]) -> DataFrame:
    """Rows of the Markdown table whose header has these names, in any places. lines: pos, line; one report's lines."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    t = lines.where(F.trim("line").startswith("|")).select("pos", cells.alias("cells"))
    head = t.where(F.size(F.array_intersect("cells", F.array(*map(F.lit, header)))) == len(header)).agg(F.min_by(F.struct("pos", "cells"), "pos").alias("h"))
    body = t.crossJoin(F.broadcast(head)).where("pos > h.pos and h is not null").where(~F.forall("cells", lambda x: x.rlike("^:?-*:?$")))  # one row of heads
    after = lines.where(~F.trim("line").startswith("|")).crossJoin(F.broadcast(head)).where("pos > h.pos").agg(F.min("pos").alias("end"))
    body = body.crossJoin(F.broadcast(after)).where("end is null or pos < end")
    return body.select("pos", *(F.get("cells", F.array_position("h.cells", name).cast("int") - 1).alias(name) for name in header))


def processor_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters of the line of all processors, 0 for those that a system lacks."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(f[0] == "cpu").where(F.size(f) >= 6).select(*(F.coalesce(F.get(f, F.lit(k + 1)).try_cast("long"), F.lit(0)).alias(n) for k, n in enumerate(COUNTERS)))


def load_averages(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(f) >= 3).select(*(f[k].try_cast("double").alias(n) for k, n in enumerate(("one", "five", "fifteen"))))


def environment(spark: SparkSession, revision: str | None = None) -> DataFrame:
    """One row of facts about the machine of the driver and the versions in use."""
    import os
    import platform

    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") if hasattr(os, "sysconf") else None
    row = (platform.processor() or platform.machine(), os.cpu_count(), memory, platform.python_version(), spark.version, platform.system(), revision)
    return spark.createDataFrame([row], "cpu_model string, logical_cpus int, memory_bytes long, python string, spark string, system string, revision string")


def finished_runs(manifests: DataFrame, strategies: tuple[str, ...] = ("exhaustive", "exhaustive-with-zombies", "cartesian")) -> DataFrame:
    """The manifests (path, status, strategy) of complete runs that searched all sets; a folder's newest one counts."""
    m = manifests.where((F.lower("status") == "complete") & F.col("strategy").isin(*strategies)).withColumn("folder", F.regexp_replace("path", "/[^/]+$", ""))
    return O.one_of(m, ["folder"], F.col("path"))
