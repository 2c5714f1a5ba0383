"""Queries of readers and writers: files are written from the tables to a scratch folder and read again; the SQL says what must come back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources import files as L
from ..sources import indices as I
from ..sources import sinks as W
from . import views as V
from .registry import query


def _scratch(spark) -> str:
    """A new folder in the one that driver and executors share, or a local one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='gridlore-')}/files-{uuid.uuid4().hex}"


def _text(lines: DataFrame, path: str) -> str:
    lines.write.text(path)
    return path


SUPPLIERS = "SELECT 'legacy' AS schema_version, s_suppkey AS id, s_name AS name, s_acctbal AS wall FROM supplier WHERE s_suppkey % 9 <> 0"


def _document(spark, d, field: str, ends: str, entries) -> DataFrame:
    """One JSON object with an array or an object (ends: its brackets) of the suppliers, of which every ninth is null. Suppliers are few."""
    s = V.table(spark, d, "supplier")
    row = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("wall")))
    one = s.select(entries(F.when(F.col("s_suppkey") % 9 == 0, "null").otherwise(row)).alias("e")).agg(F.array_join(F.collect_list("e"), ",").alias("e"))
    return one.select(F.concat(F.lit('{"other": [1], "' + field + '": ' + ends[0]), F.col("e"), F.lit(ends[1] + "}")).alias("value"))


@query(SUPPLIERS)
def q_json_index(spark, d):
    doc = _document(spark, d, "observations", "[]", lambda r: r)
    return I.json_rows(spark, _text(doc, _scratch(spark)), "observations", "id bigint, name string, wall double")


@query("SELECT s_name AS key, s_suppkey AS id, s_acctbal AS wall FROM supplier WHERE s_suppkey % 9 <> 0")
def q_json_map(spark, d):
    name = F.regexp_extract(F.to_json(F.struct(F.col("s_name").alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)  # as JSON text
    doc = _document(spark, d, "runs", "{}", lambda r: F.concat(name, F.lit(":"), r))
    return I.json_map(spark, _text(doc, _scratch(spark)), "runs", "id bigint, wall double").where("id is not null")


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_custkey % 7 > 1 AND c_mktsegment = 'BUILDING'")
def q_json_lines(spark, d):
    k = F.col("c_custkey")
    line = F.when(k % 7 == 0, F.lit('{"id": 3, "segm')).when(k % 7 == 1, F.lit("")).otherwise(F.to_json(F.struct(k.alias("id"), F.col("c_mktsegment").alias("segment"))))
    return I.json_lines(spark, _text(V.table(spark, d, "customer").select(line.alias("value")), _scratch(spark)), "id bigint, segment string", segment="BUILDING")


# the evaluation CSV, all of its columns
def _evaluations(spark, d):
    """Lines as page rows of orders as sets: odd ones have an identity digest, every fifth page failed, every fourth order has no place in a search."""
    b = V.v_box(spark, d)
    k, page, q = F.col("l_orderkey"), F.col("page"), F.col("expected")[2] - F.col("expected")[0]
    sides = {f"{s}_error_px": (F.col("predicted")[n] - F.col("expected")[n]).cast("double") for n, s in enumerate(("left", "top", "right", "bottom"))}
    failed = (k + page) % 5 == 0
    cells = {
        "parameter_set_id": k.cast("string"), "parameter_identity_sha256": F.when(k % 2 == 1, F.sha2(k.cast("string"), 256)), "search_rank": k % 10, "requested_search_member": F.when(k % 3 == 0, "True").when(k % 3 == 1, "1").otherwise("0"), "reference_roles_json": F.when(k % 2 == 0, '["a", "b"]'),
        "completion_index": F.when(k % 4 > 0, k), "completion_elapsed_seconds": F.when(k % 4 > 0, k / 2), "global_ordinal": page, "label": F.concat(F.lit('page "'), page.cast("string"), F.lit('", x')), "layout_type": F.lit("plain"), "status": F.when(failed, "error").otherwise(F.lit(" OK ")),
        "iou": F.when(~failed, F.lit(0.5)), "edge_error_mean_px": F.when(~failed, page.cast("double")), "elapsed_ms": page + 0.25, "approved_bbox_json": F.to_json("expected"), "predicted_bbox_json": F.when(failed, "null").otherwise(F.to_json("predicted")), "parameters_json": F.to_json(F.struct(q.alias("q"))), "error_type": F.when(failed, "ValueError"), "error_message": F.when(failed, "no page, none"),
    } | {n: F.when(~failed, c) for n, c in sides.items()}
    b.select(*(cells.get(n, F.lit(None)).cast("string").alias(n) for n, _ in I.EVAL_COLUMNS)).write.option("header", True).option("escape", '"').csv(path := _scratch(spark))
    return I.page_evaluations(spark, path)


FAILED = "(l_orderkey + page) % 5 = 0"
IDENTITY = "CASE WHEN l_orderkey % 2 = 1 THEN sha256(CAST(l_orderkey AS VARCHAR)) ELSE CAST(l_orderkey AS VARCHAR) END"


@query(f"""WITH {V.BOX} SELECT {IDENTITY} AS identity, page AS global_ordinal, 'page "' || page || '", x' AS label, CAST(l_orderkey % 10 AS INT) AS search_rank, l_orderkey % 3 < 2 AS requested, CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 0 END AS n_roles,
CASE WHEN {FAILED} THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS iou, CASE WHEN {FAILED} THEN 0 ELSE 4 END AS n_edges, CASE WHEN {FAILED} THEN NULL ELSE CAST(dy AS DOUBLE) END AS bottom, n + 2 * q AS b, CASE WHEN {FAILED} THEN NULL ELSE n + dx END AS l, CAST(q AS VARCHAR) AS q, CASE WHEN {FAILED} THEN 'ValueError: no page, none' END AS error FROM box""")
def q_evaluation_csv(spark, d):
    r = _evaluations(spark, d)
    return r.select(
        "identity", "global_ordinal", "label", "search_rank", F.col("requested_search_member").alias("requested"), F.size("reference_roles").alias("n_roles"), "iou", F.size(F.map_keys("edge_errors")).alias("n_edges"), F.col("edge_errors")["bottom"].alias("bottom"),
        F.col("approved_bbox")[3].cast("int").alias("b"), F.col("predicted_bbox")[0].cast("int").alias("l"), F.col("parameters")["q"].alias("q"), F.concat_ws(": ", F.nullif("error.type", F.lit("")), "error.message").alias("_e"),
    ).withColumn("error", F.nullif("_e", F.lit(""))).drop("_e")


@query(f"""WITH {V.BOX} SELECT {IDENTITY} AS identity, CAST(l_orderkey AS VARCHAR) AS parameter_set_id, string_agg(page, ',' ORDER BY page) AS pages, round(avg(page) FILTER (NOT {FAILED}), 3) AS mean_edge_error_px, round(sum(page + 0.25::DOUBLE), 3) AS elapsed_ms_total,
CASE WHEN l_orderkey % 4 > 0 THEN l_orderkey / 2.0::DOUBLE END AS found_after FROM box GROUP BY l_orderkey""")
def q_nested_results(spark, d):
    r = I.nested_results(_evaluations(spark, d))
    return r.select("identity", "parameter_set_id", F.array_join(F.transform("pages", lambda p: p["global_ordinal"].cast("string")), ",").alias("pages"), "mean_edge_error_px", "elapsed_ms_total", F.col("search_observation.elapsed_seconds").alias("found_after"))


# telemetry: a file for each supplier's lines
#: Files that a task writes at most.
FILES = 100


def _telemetry(spark, rows: DataFrame):
    """Files of rows (file, value), read again; a file is a folder's only one here, and the folder has its name.

    A task writes up to FILES of them into a folder of its own and moves them to their place itself; else one task, which the little
    text seems to ask for, writes all, the driver moves them one by one, and the reader lists them by as many tasks.
    """
    rows = cut(rows)
    tasks = max(1, -(-rows.count() // FILES))
    rows.repartition(tasks, "file").withColumn("part", F.spark_partition_id()).write.partitionBy("part", "file").option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path := _scratch(spark))
    return I.telemetry(spark, path, "*.txt", r"file=([^/]+)/")


def _spans(spark, d):
    return V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"), F.count("*").alias("n"))


SPANS = "s AS (SELECT l_suppkey AS k, min(l_orderkey) AS lo, max(l_orderkey) AS hi, count(*) AS n FROM lineitem GROUP BY 1)"


def _tab(*cells) -> str:
    return F.concat_ws("\t", *(c.cast("string") if not isinstance(c, str) else F.lit(c) for c in cells))


@query(f"WITH {SPANS} SELECT CAST(k AS INT) AS pipeline, lo + 0.5::DOUBLE AS started_epoch, CAST(hi AS DOUBLE) AS final_idle_epoch, greatest(0.0::DOUBLE, hi - lo - 0.5::DOUBLE) AS span_seconds FROM s")
def q_worker_spans(spark, d):
    lo, hi = F.col("lo"), F.col("hi")
    text = F.concat_ws("\n", _tab("start", F.lit(1)), _tab("start", lo + 0.5), _tab("end", hi))  # the last start counts
    return I.worker_spans(_telemetry(spark, _spans(spark, d).select(F.col("k").alias("file"), text.alias("value"))))


@query(f"""WITH {SPANS} SELECT CAST(k AS INT) AS task_index, CAST(k % 7 AS INT) AS pipeline, 'd' || k % 5 AS detector, CAST(n AS INT) AS shard_count, CASE WHEN k % 2 = 0 THEN 'b' || k END AS claim_batch_id, CASE WHEN k % 2 = 1 THEN CAST(lo AS DOUBLE) END AS claimed_epoch,
CAST(lo + n % 5 - 1 AS DOUBLE) AS started_epoch, 'ok' AS status, CAST(greatest(0, hi - (lo + n % 5 - 1)) AS DOUBLE) AS busy_seconds, CASE WHEN k % 2 = 1 THEN CAST(greatest(0, n % 5 - 1) AS DOUBLE) END AS claim_wait_seconds FROM s""")
def q_task_events(spark, d):
    """Odd tasks in the old layout, with a claim; even ones in the new one, whose start says all."""
    k, lo, n = F.col("k"), F.col("lo"), F.col("n")
    where = (k % 7, F.concat(F.lit("d"), (k % 5).cast("string")), F.lit(0), n, F.lit(4))
    began = lo + n % 5 - 1
    old, new = F.concat_ws("\n", _tab("claim", lo, *where), _tab("start", began)), _tab("start", began, *where, F.concat(F.lit("b"), k.cast("string")))
    text = F.concat_ws("\n", F.when(k % 2 == 1, old).otherwise(new), _tab("finish", F.col("hi"), "ok"))
    r = I.task_events(_telemetry(spark, _spans(spark, d).select(k.alias("file"), text.alias("value"))))
    return r.select("task_index", "pipeline", "detector", "shard_count", "claim_batch_id", "claimed_epoch", "started_epoch", "status", "busy_seconds", "claim_wait_seconds")


@query("SELECT 'b' || l_suppkey AS claim_batch_id, CAST(min(l_orderkey) AS DOUBLE) AS claimed_epoch, CAST(l_suppkey % 7 AS INT) AS pipeline, 4 AS allocated_threads, count(*) / 2.0::DOUBLE AS estimated_seconds, CAST(count(*) AS INT) AS task_count, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey")
def q_claim_lists(spark, d):
    k = F.col("l_suppkey")
    g = V.table(spark, d, "lineitem").groupBy(k).agg(F.min("l_orderkey").alias("at"), F.count("*").alias("n"), F.array_join(F.collect_list(F.col("l_partkey").cast("string")), ",").alias("tasks"))
    text = _tab("claim_batch", F.col("at"), k % 7, F.lit(4), F.col("n") / 2, F.col("tasks"), F.concat(F.lit("b"), k.cast("string")))
    r = I.claim_lists(_telemetry(spark, g.select(k.alias("file"), text.alias("value"))))
    return r.select("claim_batch_id", "claimed_epoch", "pipeline", "allocated_threads", "estimated_seconds", "task_count", F.aggregate("task_indexes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# lines with numbers: a file for each nation's customers, in order of their keys
def _numbered(spark, d, odd: bool) -> str:
    """With odd, every seventh line is broken, every next one no object, every next one blank."""
    k = F.col("c_custkey")
    line = F.to_json(F.struct(k.alias("id"), F.col("c_mktsegment").alias("segment")))
    if odd:
        line = F.when(k % 7 == 0, F.lit('{"id": 3, "segm')).when(k % 7 == 1, F.lit("[1, 2]")).when(k % 7 == 2, F.lit("  ")).otherwise(line)
    rows = V.table(spark, d, "customer").select("c_nationkey", k, line.alias("value")).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.drop("c_custkey").write.partitionBy("c_nationkey").text(path := _scratch(spark))
    return path


NUMBERED = "n AS (SELECT c_nationkey, c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS number FROM customer)"


@query(f"WITH {NUMBERED} SELECT c_nationkey AS nation, number, CASE c_custkey % 7 WHEN 0 THEN '{{\"id\": 3, \"segm' ELSE '[1, 2]' END AS value FROM n WHERE c_custkey % 7 < 2")
def q_failing_lines(spark, d):
    r = I.failing_lines(spark, _numbered(spark, d, True), "id bigint, segment string")
    return r.select(F.regexp_extract("file", r"c_nationkey=(\d+)", 1).cast("long").alias("nation"), "number", "value")


@query(f"WITH {NUMBERED} SELECT number, c_custkey AS id, c_mktsegment AS segment FROM n")
def q_strict_lines(spark, d):
    return I.strict_lines(spark, _numbered(spark, d, False), "id bigint, segment string")


@query("SELECT p_brand || p_partkey AS name, CAST(p_size AS BIGINT) * 1024 AS bytes FROM part")
def q_memory_report(spark, d):
    lines = V.table(spark, d, "part").select(F.explode(F.array(F.format_string("%s%d:   %8d kB", "p_brand", "p_partkey", "p_size"), F.lit("no number: here"))).alias("value"))
    return I.meminfo(spark, _text(lines, _scratch(spark)))


@query("SELECT s_suppkey AS user, s_nationkey + 0::BIGINT AS nice, CAST(3 AS BIGINT) AS idle, CAST(0 AS BIGINT) AS steal FROM supplier")
def q_processor_counters(spark, d):
    lines = V.table(spark, d, "supplier").select(F.explode(F.array(F.format_string("cpu  %d %d 2 3 4 5", "s_suppkey", "s_nationkey"), F.lit("cpu0 1 1 1 1 1 1"), F.lit("cpu 1 2"))).alias("value"))
    return L.processor_counters(spark, _text(lines, _scratch(spark))).select("user", "nice", "idle", "steal")


@query("SELECT CAST(s_suppkey AS DOUBLE) AS one, s_nationkey + 0.5::DOUBLE AS five, 2.25::DOUBLE AS fifteen FROM supplier")
def q_load_averages(spark, d):
    lines = V.table(spark, d, "supplier").select(F.format_string("%d %d.5 2.25 1/99 7", "s_suppkey", "s_nationkey").alias("value"))
    return L.load_averages(spark, _text(lines, _scratch(spark)))


@query("SELECT CAST(c_custkey AS VARCHAR) AS Runner, CAST(c_nationkey AS VARCHAR) AS Rate FROM customer")
def q_report_table(spark, d):
    c = V.table(spark, d, "customer")
    body = c.select((F.col("c_custkey") + 10).alias("pos"), F.format_string("| %d | x | %d |", "c_nationkey", "c_custkey").alias("line"))
    head = spark.createDataFrame([(0, "# A report"), (1, "| A | B |"), (2, "|---|---|"), (3, "| 1 | 2 |"), (4, ""), (5, "| Rate | Other | Runner |"), (6, "|--:|---|:--|")], "pos bigint, line string")
    return L.table_rows(head.unionByName(body), ["Runner", "Rate"]).select("Runner", "Rate")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'name' WHEN doc_id % 7 = 0 THEN 'digest' END AS error, CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 4 = 1 THEN 'digest mismatch' WHEN doc_id % 4 = 2 THEN 'validator failure' END AS problem FROM documents")
def q_artifact_checks(spark, d):
    k = F.col("doc_id")
    digest = F.sha2("text", 256)
    a = V.table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("f"), F.when(k % 5 == 0, ".pdf").otherwise(".DOCX")).alias("name"), F.when(k % 7 == 0, F.left(digest, F.lit(63))).otherwise(F.upper(digest)).alias("sha256"))
    content = F.when(k % 4 != 0, F.col("text").cast("binary"))
    problem = L.artifact_problem(content, F.when(k % 4 == 1, F.lit("0" * 64)).otherwise(digest), k % 4 != 2)
    return L.manifest_errors(a).select("doc_id", "error", problem.alias("problem"))


@query("SELECT c_custkey % 10 AS id, 'authoritative' AS status, CAST(max(c_custkey) AS BIGINT) AS created FROM customer GROUP BY 1")
def q_published_entries(spark, d):
    path, c = _scratch(spark), V.table(spark, d, "customer")
    run = c.select((F.col("c_custkey") % 10).alias("id"), F.lit("d").alias("detector"), F.lit("g").alias("dataset"), F.lit(True).alias("complete"), F.create_map(F.lit("k"), F.lit("1")).alias("context"), F.col("c_custkey").alias("created"))
    W.publish_entry(spark, path, run.where("created % 2 = 0"), "smoke")
    return W.publish_entry(spark, path, run, "full").select("id", "status", "created")


# tables with a log of commits
LAST = "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1"


@query(LAST)
def q_commit_log(spark, d):
    """Orders by customer from writers that began with one version: two apart from each other, and one that conflicts and comes again."""
    from ..sources.log import Conflict, Log

    o = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    part = lambda status: o.where(F.col("o_orderstatus") == status).drop("o_orderstatus")
    middle = o.agg(F.expr("percentile_approx(o_custkey, 0.5)")).first()[0]
    log = Log(spark, _scratch(spark))
    log.upsert(part("F"), ["o_custkey"], "o_orderkey")
    a, b, c = (log.begin() for _ in range(3))
    for t, rows in ((a, part("O").where(F.col("o_custkey") <= middle)), (b, part("O").where(F.col("o_custkey") > middle)), (c, part("P"))):
        t.upsert(rows, ["o_custkey"], "o_orderkey")
    b.commit()
    for t in (a, c):  # c's keys overlap with b's; a's may, by files that both replaced
        try:
            t.commit()
        except Conflict:
            t.abandon()
            log.upsert(part("P") if t is c else part("O").where(F.col("o_custkey") <= middle), ["o_custkey"], "o_orderkey")
    return log.read()


@query(LAST)
def q_replayed_stream(spark, d):
    """A stream of orders into a keyed table, run again from its checkpoint and from none."""
    from ..sources.log import Log, upsert_stream

    orders = V.table(spark, d, "orders")
    stream = lambda: spark.readStream.schema(orders.schema).parquet(f"{d}/orders*.parquet").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"))
    path, first, lost = _scratch(spark), _scratch(spark), _scratch(spark)
    for checkpoint in (first, first, lost):
        upsert_stream(stream(), path, ["o_custkey"], "o_orderkey", checkpoint).awaitTermination()
    return Log(spark, path).read()


@query("""WITH r AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most, median(v) AS median FROM r WHERE k <= 40 GROUP BY user_id""")
def q_incremental_index(spark, d):
    """The newest forty events of each user, from four batches: a user's first events, then later ones."""
    from ..sources.index import Index

    e = V.table(spark, d, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("v"))
    cuts = [0, *e.agg(F.expr("percentile_approx(event_id, array(0.25, 0.5, 0.75))")).first()[0], 1 << 62]
    index = Index(spark, _scratch(spark), "user_id", "event_id", "ts", "v", 40)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        index.apply(e.where((F.col("event_id") >= a) & (F.col("event_id") < b)), n)
    return index.read()


@query("""WITH f AS (SELECT doc_id, CASE WHEN lang = 'de' THEN left(text, 100) ELSE text END AS content, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS w FROM documents WHERE text IS NOT NULL)
SELECT sha256(content) AS digest, CAST(any_value(strlen(content)) AS BIGINT) AS size, count(*) AS n_names, min(doc_id) AS name, CAST(max(w) AS BIGINT) AS latest FROM f GROUP BY 1""")
def q_content_store(spark, d):
    """Documents by digest; the German ones then become shorter, and what they were is collected unless others are the same."""
    from ..sources.store import Store

    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("name"), "text", "lang")
    store = Store(spark, _scratch(spark))
    store.put(docs.select("name", F.col("text").alias("content"), F.lit(1).alias("at")))
    store.put(docs.where("lang = 'de'").select("name", F.left("text", F.lit(100)).alias("content"), F.lit(2).alias("at")))
    store.sweep()
    return store.index().withColumn("size", F.col("size").cast("long"))
