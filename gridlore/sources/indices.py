"""Readers of nested index documents, evaluation CSV and telemetry, as flat tables with fixed schemas."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

# The columns of the evaluation CSV in their order, with the type of each.
PAGE_EVAL = """run_id string, parameter_set_equivalence_family_id string, parameter_set_equivalence_family_sha256 string, parameter_set_equivalence_family_size int,
parameter_set_id string, parameter_identity_sha256 string, parameter_schema_version string, parameter_grid_sha256 string, parameter_grid_ordinal int, profile string, rank int, search_rank int,
requested_search_member boolean, search_space_member boolean, reference_roles_json array<string>, historic_reference_json map<string,string>, completion_index int, completion_elapsed_seconds double,
search_fraction double, global_ordinal int, label string, layout_type string, status string, iou double, left_error_px double, top_error_px double, right_error_px double, bottom_error_px double,
edge_error_mean_px double, edge_error_maximum_px double, elapsed_ms double, approved_bbox_json array<double>, predicted_bbox_json array<double>, parameters_json map<string,string>, error_type string, error_message string"""
EVAL_COLUMNS = [(x.split()[0], x.split()[1]) for x in PAGE_EVAL.replace("\n", " ").split(", ")]
OBSERVATION = "observation_id string, detector_id string, mode string, strategy string, possible_parameter_sets int, actual_parameter_sets int, compatibility_key string, shards int, active_pipelines int, threads_per_pipeline int, wall_clock_seconds double, observed_at_utc string"


def json_rows(spark: SparkSession, path: str, array: str, row: str) -> DataFrame:
    """Rows of one array of an index document; the root must be an object, rows that aren't objects go; schema_version is legacy if absent."""
    doc = spark.read.schema(f"schema_version string, {array} array<struct<{row_struct(row)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.coalesce("schema_version", F.lit("legacy")).alias("schema_version"), F.explode(array).alias("_r")).where("_r is not null").select("schema_version", "_r.*")


def row_struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in ddl.split(",")))


def entries(text: str, field: str) -> list[tuple[str, str]]:
    """Names and JSON texts of what the object `field` of a document holds, equal names too; none where it is no object. A root that is no object is an error."""
    decode, blank = json.JSONDecoder().raw_decode, json.decoder.WHITESPACE.match
    found: list[tuple[str, str]] = []

    def members(at: int, take) -> int:
        """take(name, place of its value) gives the place after it; out comes the place after the object."""
        at = blank(text, at + 1).end()
        while text[at : at + 1] != "}":
            name, colon = decode(text, at)
            colon = blank(text, colon).end()
            if not isinstance(name, str) or text[colon : colon + 1] != ":":
                raise ValueError(f"no name and colon at {at}")
            at = blank(text, take(name, blank(text, colon + 1).end())).end()
            if text[at : at + 1] == "," and text[(after := blank(text, at + 1).end()) : after + 1] == '"':
                at = after
            elif text[at : at + 1] != "}":
                raise ValueError(f"no comma with a name, and no end of an object at {at}")
        return at + 1

    def entry(name: str, at: int) -> int:
        end = decode(text, at)[1]
        found.append((name.encode("utf-8", "replace").decode(), text[at:end]))
        return end

    def top(name: str, at: int) -> int:
        if name != field:
            return decode(text, at)[1]
        found.clear()  # of equal fields the last holds
        return members(at, entry) if text[at : at + 1] == "{" else decode(text, at)[1]

    start = blank(text, 0).end()
    if start == len(text):
        return found
    if text[start] != "{":
        raise ValueError("the root of an index document must be an object")
    if blank(text, members(start, top)).end() != len(text):
        raise ValueError("an index document goes on after its end")
    return found


def json_map(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """Entries of an object map of an index document as rows; a document that can't be read is an error.

    Spark's JSON reader keeps the names of a document in a table that, by chance of its seed, takes tens of
    thousands of them for an attack and gives the document up: names are read in Python, values by Spark.
    """
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc in b.column(0):
                data = doc.as_py()
                found = entries(data.decode(json.detect_encoding(data)), field)
                for k in range(0, len(found), 2000):
                    key, text = zip(*found[k : k + 2000])
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(text, pa.string())], ["key", "_json"])

    docs = spark.read.text(path, wholetext=True).select(F.col("value").cast("binary").alias("value"))
    return docs.mapInArrow(run, "key string, _json string").select("key", F.from_json("_json", value).alias("_v")).select("key", "_v.*")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, **equal: str) -> DataFrame:
    """Lines as rows; corrupt and blank ones go, or fail the read if strict. equal: columns held to a text."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    for name, value in equal.items():
        df = df.where(F.col(name).cast("string") == value)
    return df


# Numbers and texts that need no JSON reader to be told: no exponent, no minus at 0, no more digits than a double holds; no escape, quote or control.
_NUMBER, _TEXT = r"(?:0|-?[1-9][0-9]{0,14})(?:\.[0-9]{1,10})?", r'"[^"\\\x00-\x1f]*"'


def _json(x, kind: str):
    """JSON as a value of a kind. Plain lists of numbers and texts, which are most, are split, which takes less time than the JSON reader; others are read by it."""
    whole = F.from_json(x, kind)
    if kind == "array<double>":
        return F.when(x.rlike(rf"\A\[{_NUMBER}(?:, ?{_NUMBER})*\]\z"), F.split(F.substring(x, F.lit(2), F.length(x) - 2), ",").cast(kind)).otherwise(whole)
    if kind == "array<string>":
        return F.when(x.rlike(rf"\A\[{_TEXT}(?:, ?{_TEXT})*\]\z"), F.split(F.substring(x, F.lit(3), F.length(x) - 4), '", ?"')).otherwise(whole)
    return whole


def page_evaluations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The evaluation CSV as typed page rows; JSON columns come without their ending, parsed, with `identity`, `edge_errors` (of the sides that have one) and `error`.

    Columns are found by the names in the header; other ones are left out, and one that isn't there is null. Empty cells are null, but iou and
    elapsed_ms 0, roles and references empty. A set is told by its identity digest, or its id where there is none. A number that is none is an error.
    lines: cells may go over several lines, for which a file must be read as a whole.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", lines).csv(path)

    def cell(name: str, kind: str):
        x = F.nullif(F.col(name), F.lit("")) if name in raw.columns else F.lit(None).cast("string")
        if kind == "boolean":
            return x.isin("1", "true", "True")
        return _json(x, kind) if name.endswith("_json") else x.cast(kind)

    rows = raw.select(*(cell(n, k).alias(n.removesuffix("_json")) for n, k in EVAL_COLUMNS))
    no = lambda c: F.coalesce(c, F.lit(False))
    sides = {s: F.col(f"{s}_error_px") for s in ("left", "top", "right", "bottom")}
    errors, there = F.create_map(*(y for s, x in sides.items() for y in (F.lit(s), x))), sum((x.isNotNull().cast("int") for x in sides.values()), F.lit(0))
    return rows.withColumns({
        "identity": F.coalesce("parameter_identity_sha256", "parameter_set_id"), "iou": F.coalesce("iou", F.lit(0.0)), "elapsed_ms": F.coalesce("elapsed_ms", F.lit(0.0)),
        "search_space_member": no(F.coalesce("search_space_member", "requested_search_member")), "requested_search_member": no(F.col("requested_search_member")),
        "reference_roles": F.coalesce("reference_roles", F.expr("cast(array() as array<string>)")), "historic_reference": F.coalesce("historic_reference", F.expr("cast(map() as map<string, string>)")),
        "edge_errors": F.when(there == 4, errors).when(there == 0, F.expr("cast(map() as map<string, double>)")).otherwise(F.map_filter(errors, lambda k, v: v.isNotNull())),
        "error": F.when(F.col("error_type").isNotNull() | F.col("error_message").isNotNull(), F.struct(F.col("error_type").alias("type"), F.col("error_message").alias("message"))),
    }).drop(*(f"{s}_error_px" for s in sides), "error_type", "error_message")


def nested_results(pages: DataFrame) -> DataFrame:
    """One nested row for each identity: what its first page says of the set, where in the search it was found, its pages in order, and sums over them."""
    of_set = ["parameter_set_id", "parameter_set_equivalence_family_id", "parameter_set_equivalence_family_sha256", "parameter_set_equivalence_family_size", "parameter_identity_sha256", "parameter_schema_version", "parameter_grid_sha256", "parameter_grid_ordinal", "profile", "search_rank", "requested_search_member", "search_space_member", "reference_roles", "historic_reference", "parameters"]
    of_page = ["global_ordinal", "label", "layout_type", "status", "iou", "edge_errors", "edge_error_mean_px", "edge_error_maximum_px", "elapsed_ms", "approved_bbox", "predicted_bbox", "error"]
    found = F.when(F.col("completion_index").isNotNull() | F.col("completion_elapsed_seconds").isNotNull(), F.struct("completion_index", F.col("completion_elapsed_seconds").alias("elapsed_seconds"), "search_fraction"))
    ok = F.lower(F.trim("status")).isin("ok", "success")
    # Dealt out first: pages of a set seldom lie together, and a list of them is no smaller than they are, so that lists made before a shuffle are sorted and packed for nothing.
    # An aggregate for each column of the set, so that Spark leaves out the parsing of those that a caller leaves out.
    g = pages.repartition("identity").groupBy("identity").agg(
        *(F.min_by(c, "global_ordinal").alias(c) for c in of_set), F.min_by(found, "global_ordinal").alias("search_observation"), F.array_sort(F.collect_list(F.struct(*of_page)), lambda a, b: F.coalesce(a["global_ordinal"] - b["global_ordinal"], F.lit(0))).alias("pages"),
        F.round(F.avg(F.when(ok, F.col("edge_error_mean_px"))), 3).alias("mean_edge_error_px"), F.round(F.sum("elapsed_ms"), 3).alias("elapsed_ms_total"),
    )
    return g.select("identity", *of_set, "search_observation", "pages", "mean_edge_error_px", "elapsed_ms_total")


# telemetry: a small file for a worker, a task or a claim, each a row
def telemetry(spark: SparkSession, path: str, glob: str = "*.tsv", name: str = r"([^/]+?)(?:\.[^/.]*)?$") -> DataFrame:
    """name (what the pattern's group has of a file's path; without more its name before the ending) and lines (its lines as lists of cells) of each file under a folder. Files without a byte, which Spark doesn't read, are no rows."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    lines = F.filter(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n"), lambda x: x != "")
    return files.select(F.regexp_extract(F.url_decode("_metadata.file_path"), name, 1).alias("name"), F.transform(lines, lambda x: F.split(x, "\t")).alias("lines"))


def _last(kind: str):
    """The last line of a kind as its cells, or null."""
    return F.try_element_at(F.filter("lines", lambda x: x[0] == kind), F.lit(-1))


def _epoch(text):
    """A time stamp; one that isn't a finite number is an error."""
    x = text.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.concat(F.lit("a time stamp that is not finite: "), text)).cast("double")).otherwise(x)


def _whole(what: str, *parts):
    """Raise for a file in which one of parts is missing."""
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(missing, F.raise_error(F.concat(F.lit(f"incomplete {what} telemetry: "), F.col("name"))).cast("double"))


def worker_spans(files: DataFrame) -> DataFrame:
    """Of each worker's file (kind, epoch; the last line of a kind counts) its pipeline, the file's name, and its span. A file without a start or an end is an error."""
    start, end = _epoch(_last("start")[1]), _epoch(_last("end")[1])
    span = F.coalesce(_whole("worker", start, end), F.greatest(F.lit(0.0), end - start))
    return files.select(F.col("name").cast("int").alias("pipeline"), start.alias("started_epoch"), end.alias("final_idle_epoch"), span.alias("span_seconds"))


def task_events(files: DataFrame) -> DataFrame:
    """Of each task's file, whose name is the task: claim (epoch, pipeline, detector, shard, shards, threads), start (epoch alone, or the same and a batch), finish (epoch, status).

    A start with eight cells says where the task ran; else the claim does, and only a claim makes a wait. A file without a start or a finish is an error.
    """
    claim, start, finish = _last("claim"), _last("start"), _last("finish")
    full = F.when(F.size(start) >= 8, start)
    at = F.coalesce(full, claim)
    claimed, started, finished = _epoch(claim[1]), _epoch(start[1]), _epoch(finish[1])
    return files.select(
        F.col("name").cast("int").alias("task_index"), F.get(at, F.lit(2)).cast("int").alias("pipeline"), F.get(at, F.lit(3)).alias("detector"), F.get(at, F.lit(4)).cast("int").alias("shard_index"), F.get(at, F.lit(5)).cast("int").alias("shard_count"),
        F.get(at, F.lit(6)).cast("int").alias("allocated_threads"), F.get(full, F.lit(7)).alias("claim_batch_id"), claimed.alias("claimed_epoch"), started.alias("started_epoch"), finished.alias("finished_epoch"), F.get(finish, F.lit(2)).alias("status"),
        F.coalesce(_whole("task", started, finished), F.greatest(F.lit(0.0), finished - started)).alias("busy_seconds"), F.when(claimed.isNotNull(), F.greatest(F.lit(0.0), started - claimed)).alias("claim_wait_seconds"),
    )


def claim_lists(files: DataFrame) -> DataFrame:
    """Of each claim's file, one line of seven cells (claim_batch, epoch, pipeline, threads, estimated seconds, tasks, batch), the batch with its tasks. Any other form is an error."""
    f = F.col("lines")[0]
    sound = (F.size("lines") == 1) & (F.size(f) == 7) & (f[0] == "claim_batch")
    f = F.when(F.coalesce(sound, F.lit(False)), f).otherwise(F.raise_error(F.concat(F.lit("invalid claim batch telemetry: "), F.col("name"))).cast("array<string>"))
    tasks = F.transform(F.filter(F.split(f[5], ","), lambda x: x != ""), lambda x: x.cast("int"))
    return files.select(f[6].alias("claim_batch_id"), _epoch(f[1]).alias("claimed_epoch"), f[2].cast("int").alias("pipeline"), f[3].cast("int").alias("allocated_threads"), f[4].cast("double").alias("estimated_seconds"), tasks.alias("task_indexes"), F.size(tasks).alias("task_count"))


# lines with their numbers
def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1), value of each line. A large file is read in splits by many tasks: of each split only its number of lines goes on, and the sum over the splits before it is its offset."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = lines.groupBy("file", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "_at", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_add"))
    return lines.join(offsets, ["file", "_at"]).select("file", (F.col("_id") + F.col("_add")).alias("number"), "value")


def failing_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, number, value of the lines that are neither blank nor an object of the schema."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    no_object = ~F.col("value").rlike(r"^\s*\{")
    return numbered_lines(spark, path).where(F.trim("value") != "").where(no_object | parsed["_bad"].isNotNull())


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines as rows, blank ones left out; a line that is no object of the schema is an error that says its number and file."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    lines = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("_v", parsed)
    bad = F.col("_v._bad").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    said = F.raise_error(F.concat(F.lit("line "), F.col("number").cast("string"), F.lit(" of "), F.col("file"), F.lit(" is no record")))
    names = [f.split()[0] for f in schema.split(",")]
    return lines.select("number", F.when(bad, said.cast(f"struct<{row_struct(schema)}>")).otherwise(F.struct(*(F.col(f"_v.{n}") for n in names))).alias("_v")).select("number", "_v.*")


def meminfo(spark: SparkSession, path: str) -> DataFrame:
    """Names and bytes of a memory report in kB."""
    m = spark.read.text(path).select(F.regexp_extract("value", r"^([^:]+):\s+(\d+)", 1).alias("name"), F.regexp_extract("value", r"^([^:]+):\s+(\d+)", 2).try_cast("long").alias("kb"))
    return m.where("kb is not null").select("name", (F.col("kb") * 1024).alias("bytes"))
