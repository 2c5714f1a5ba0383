"""Stand-ins on the star-schema tables for the engine's fact tables, as DataFrames and as SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables_of(sql: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(sql) if name}


def shared(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view written in the SQL that Spark and DuckDB have in common; tables stand in braces."""
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in tables_of(sql)})


def cte(name: str, sql: str) -> str:
    """The same view for DuckDB, as a part of WITH."""
    return f"{name} AS ({sql.format(**{t: t for t in tables_of(sql)})})"


DIMS = ["size_class", "p_type", "l_linestatus"]


def v_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page evaluations: set, page, detector, status, IoU in hundredths, edge error, time, three parameters."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey", "l_returnflag", "l_discount", "l_tax", "l_quantity", "l_linestatus")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", "p_type")
    failed = F.col("l_returnflag") == "R"
    return li.join(p, "l_partkey").select(
        F.col("l_suppkey").alias("set_id"), F.col("l_linenumber").alias("page"), F.col("p_brand").alias("detector"), F.when(failed, "no_candidate").otherwise("ok").alias("status"),
        F.when(failed, F.when(F.col("l_linenumber") == 7, 3).otherwise(0)).otherwise(100 - 5 * F.round(F.col("l_discount") * 100).cast("int")).alias("iou"), F.round(F.col("l_tax") * 100).cast("int").alias("edge"), F.col("l_quantity").alias("ms"),
        F.floor(F.col("p_size") / 10).cast("int").alias("size_class"), "p_type", "l_linestatus",
    )


EVAL = """v_eval AS (SELECT l_suppkey AS set_id, l_linenumber AS page, p_brand AS detector, CASE WHEN l_returnflag = 'R' THEN 'no_candidate' ELSE 'ok' END AS status,
  CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber = 7 THEN 3 ELSE 0 END ELSE 100 - 5 * CAST(round(l_discount * 100) AS INT) END AS iou, CAST(round(l_tax * 100) AS INT) AS edge, l_quantity AS ms,
  CAST(floor(p_size / 10) AS INT) AS size_class, p_type, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey)"""

MOMENTS = """CAST(count(*) AS BIGINT) AS n_pages, CAST(count(*) FILTER (status IN ('ok', 'success')) AS BIGINT) AS n_ok, CAST(count(*) FILTER (status NOT IN ('ok', 'success')) AS BIGINT) AS n_failed,
  CAST(sum(iou) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100) AS mean_iou, CAST(sum(iou) FILTER (status IN ('ok', 'success')) AS DOUBLE) / nullif(count(*) FILTER (status IN ('ok', 'success')) * 100.0::DOUBLE, 0) AS ok_mean_iou, min(iou) / 100.0::DOUBLE AS min_iou,
  sqrt(greatest(CAST(count(*) AS DOUBLE) * CAST(sum(iou * iou) AS DOUBLE) - CAST(sum(iou) AS DOUBLE) * CAST(sum(iou) AS DOUBLE), 0)) / (CAST(count(*) AS DOUBLE) * 100) AS std_iou,
  CAST(sum(edge) FILTER (status IN ('ok', 'success')) AS DOUBLE) / nullif(CAST(count(*) FILTER (status IN ('ok', 'success')) AS DOUBLE), 0) AS mean_edge"""
METRICS = EVAL + f", m AS (SELECT set_id, {MOMENTS} FROM v_eval GROUP BY set_id)"
ORDER = "mean_iou DESC, min_iou DESC, n_failed ASC, mean_edge ASC NULLS LAST, set_id ASC"


#: Parameters of a set, and the sets with them and their metrics.
SET_DIMS = ["nation", "step", "rich"]


def v_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets with their metrics and parameters: nation, step (four values), rich."""
    from ..operators import metrics as M

    s = table(spark, sf_dir, "supplier")
    p = s.select(F.col("s_suppkey").alias("set_id"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 4).alias("step"), F.when(F.col("s_acctbal") > 5000, "yes").otherwise("no").alias("rich"))
    return M.set_metrics(v_eval(spark, sf_dir), ["set_id"]).join(p, "set_id")


SETS = METRICS + ", v_sets AS (SELECT m.*, s_nationkey AS nation, s_suppkey % 4 AS step, CASE WHEN s_acctbal > 5000 THEN 'yes' ELSE 'no' END AS rich FROM m JOIN supplier ON set_id = s_suppkey)"


def v_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of runs: id, time, runner, detector, wall time, pipelines."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("runner"), F.col("event_type").alias("detector"), F.col("value").alias("wall"), F.from_json("props", "k int").k.alias("pipelines"))


OBS = "v_obs AS (SELECT event_id, ts, user_id AS runner, event_type AS detector, value AS wall, CAST(json_extract(props, '$.k') AS INT) AS pipelines FROM events)"


def v_cal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "authoritative").when(F.col("o_orderstatus") == "O", "provisional").otherwise("partial")
    return o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(F.col("c_nationkey").alias("grp"), status.alias("status"), F.col("o_totalprice").alias("quality"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"), F.col("o_orderkey").alias("build"))


CAL = "v_cal AS (SELECT c_nationkey AS grp, CASE o_orderstatus WHEN 'F' THEN 'authoritative' WHEN 'O' THEN 'provisional' ELSE 'partial' END AS status, o_totalprice AS quality, CAST(epoch(o_orderdate) AS BIGINT) AS created, o_orderkey AS build FROM orders JOIN customer ON o_custkey = c_custkey)"


def v_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")
    dx, dy = F.round(F.col("l_tax") * 100).cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    return li.select("l_orderkey", F.col("l_linenumber").alias("page"), F.array(n, n, n + q, n + 2 * q).alias("expected"), F.array(n + dx, n + dy, n + q + dx, n + 2 * q + dy).alias("predicted"))


BOX = """b0 AS (SELECT l_orderkey, l_linenumber AS page, CAST(l_linenumber AS INT) AS n, CAST(l_quantity AS INT) AS q, CAST(round(l_tax * 100) AS INT) AS dx, CAST(round(l_discount * 100) AS INT) AS dy FROM lineitem),
  v_box AS (SELECT *, greatest(least(n + q, n + q + dx) - greatest(n, n + dx), 0) * greatest(least(n + 2 * q, n + 2 * q + dy) - greatest(n, n + dy), 0) AS inter, q * 2 * q AS area FROM b0),
  box AS (SELECT *, CASE WHEN 2 * area - inter > 0 THEN CAST(inter AS DOUBLE) / (2 * area - inter) ELSE 0.0 END AS iou, greatest(dx, dy) AS worst FROM v_box)"""


def v_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"))
    o = table(spark, sf_dir, "orders").join(last, "o_orderkey")
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return o.select("o_orderkey", F.col("o_orderpriority").alias("lane"), sec("o_orderdate").alias("start"), F.greatest(sec("o_orderdate"), sec("ship")).alias("end"))


TASK = "v_task AS (SELECT o_orderkey, o_orderpriority AS lane, CAST(epoch(o_orderdate) AS BIGINT) AS \"start\", greatest(CAST(epoch(o_orderdate) AS BIGINT), CAST(epoch(max(l_shipdate)) AS BIGINT)) AS \"end\" FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate)"


def v_prof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles: position and value in thousandths."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", F.floor(F.col("v").cast("double") * 1000).cast("long").alias("v"))


PROF = "v_prof AS (SELECT vec_id, pos - 1 AS pos, CAST(floor(CAST(embedding[pos] AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings, range(1, 65) t(pos))"


#: Observations of runs: what ran where in which shape, over which workload, and how long.
RUNS = """SELECT event_id AS id, event_type AS detector, 'run' || CAST(user_id % 13 AS STRING) AS run, CASE WHEN event_id % 5 = 0 THEN 'live' ELSE 'execution-optimizer' END AS source,
  CASE WHEN event_id % 11 = 0 THEN 'smoke' ELSE 'full' END AS mode, CASE event_id % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'random' ELSE 'exhaustive' END AS strategy,
  CASE WHEN event_id % 17 = 3 THEN NULL ELSE 100 END AS possible, CASE WHEN event_id % 17 = 3 THEN NULL WHEN event_id % 9 = 0 THEN 90 ELSE 100 END AS actual,
  CASE WHEN event_id % 23 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS wall, CAST(1 + user_id % 4 AS INT) AS pipelines, CAST(1 + event_id % 3 AS INT) AS threads, 'r' || CAST(user_id % 7 AS STRING) AS runner,
  CAST(4 * (1 + user_id % 7 % 3) AS INT) AS cpus, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'c' || CAST(event_id % 2 AS STRING) END AS config, 'g' || CAST(event_id % 4 AS STRING) AS dataset,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE 1800 END AS dimension, ts AS seen FROM {events}"""

#: Entries of an index of records: a detector's calibrations, their data, variants, status, builds and stored results.
ENTRIES = """SELECT o_orderkey AS id, 'd' || CAST(c_nationkey AS STRING) AS detector, 'g' || CAST(o_orderkey % 3 AS STRING) AS dataset, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x_current' WHEN 2 THEN 'x_old' ELSE ' ' END AS variant,
  CASE o_orderstatus WHEN 'F' THEN 'authoritative' WHEN 'O' THEN 'provisional' ELSE 'partial' END AS status, o_totalprice AS quality, o_orderdate AS created, CAST(o_orderkey % 120 AS STRING) AS build,
  CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'records/' || CAST(o_orderkey % 2000 AS STRING) END AS record FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
