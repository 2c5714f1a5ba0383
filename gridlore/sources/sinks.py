"""Writers: fact rows, keyed tables with retention, append-only logs, byte-bounded texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from .log import Log


def write_facts(pages: DataFrame, path: str) -> None:
    """Partitioned by detector and run; fails if the place is taken."""
    pages.write.mode("errorifexists").partitionBy(*[c for c in ("detector", "run_id") if c in pages.columns]).parquet(path)


def write_csv(pages: DataFrame, path: str) -> None:
    """The CSV form: maps and arrays as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in pages.dtypes]
    pages.select(*flat).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: list[str], order: str, keep: int | None = None, by: list[str] | None = None) -> DataFrame:
    """A new version of a keyed table (sources/log.py): new rows win by key, at most `keep` newest rows a group stay. Gives the newest version; writers need no lock."""
    log = Log(spark, path)
    log.upsert(new, key, order, keep, by, arrival=True)
    return log.read()


def computed_once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at a path, made and written by the first who asks; the others read it. An unfinished one is made again."""
    fs = spark._jvm.org.apache.hadoop.fs
    there = fs.Path(path, "_SUCCESS")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def within_bytes(blocks: DataFrame, pos: str, text: str, budget: int, by: list[str] | None = None, separator: int = 1) -> DataFrame:
    """The leading blocks of each group that fit a budget of bytes, with a separator between one and the next."""
    if not by:
        return O.numbered(blocks, pos, [F.col(pos).asc()], {"_size": F.octet_length(text) + separator}).where(F.col("_size") <= budget + separator).drop("_size")
    size = F.sum(F.octet_length(text) + separator).over(Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_size", size).where(F.col("_size") <= budget + separator).drop("_size")


def write_json(row: DataFrame, path: str) -> None:
    """The one row of a small table as a JSON object with indented members, in one file."""
    row.limit(1).select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_review(pages: DataFrame, path: str, queue_path: str, statuses: tuple[str, ...] = ("review", "fail", "error")) -> None:
    """All analysed pages, and those that someone must look at, as CSV; each file begins with a byte order mark, which spreadsheets need."""
    for rows, place in ((pages, path), (pages.where(F.col("quality_status").isin(*statuses)), queue_path)):
        cols = [F.col(c).alias(("\ufeff" if k == 0 else "") + c) for k, c in enumerate(rows.columns)]
        rows.select(*cols).write.mode("errorifexists").option("header", True).csv(place)


def write_rankings(ranked: DataFrame, path: str, top: int | None = None) -> None:
    """Ranked sets as CSV, best first; top: only that many."""
    r = ranked if top is None else ranked.where(F.col("rank") <= top)
    r.orderBy("rank").write.mode("errorifexists").option("header", True).csv(path)


def publish_entry(spark: SparkSession, path: str, run: DataFrame, mode: str) -> DataFrame:
    """The index of records with a run's row put in: status, compatibility key and record path follow from the run. run: id, detector, dataset, complete, context (map), created; one row."""
    from ..functions import scalar as S
    from ..operators import planning as P

    key = S.compatibility_key(F.col("context"))
    record = F.concat_ws("/", F.lit("records"), "detector", F.left(key, F.lit(12)), "id")
    row = run.select("id", "detector", "dataset", P.publication_status(F.lit(mode), F.col("complete")).alias("status"), key.alias("compatibility"), record.alias("record"), "created")
    return upsert_table(spark, path, row, ["compatibility", "id"], "created")


def retained(obs: DataFrame, by: list[str], seen: str, keep: int, exempt: str = "execution-optimizer") -> DataFrame:
    """The newest `keep` rows of each group; rows of the exempt source never age. Without groups the rows that age are cut to `keep` in each part before the last cut."""
    aging = obs.where(~F.col("source").eqNullSafe(exempt))
    kept = O.newest(aging, by, [F.col(seen).desc()], keep) if by else aging.orderBy(F.col(seen).desc()).limit(keep)
    return obs.where(F.col("source") == exempt).unionByName(kept)


def store_by_digest(files: DataFrame, index: DataFrame | None, path: str) -> DataFrame:
    """Files (content) written once for each digest, under it, beside those of index (digest); gives all digests with their sizes."""
    new = files.select(F.sha2("content", 256).alias("digest"), "content").dropDuplicates(["digest"])
    if index is not None:
        new = new.join(index.select("digest"), "digest", "left_anti")
    new.withColumn("prefix", F.left("digest", F.lit(2))).write.mode("append").partitionBy("prefix").parquet(path)
    return files.sparkSession.read.parquet(path).select("digest", F.octet_length("content").alias("size"))


def stage_record(stage: str, started: float | None, started_text: str, status: str, ended: float, ended_text: str) -> dict:
    """What a finished stage leaves: an unknown start counts as its end, time never runs backwards."""
    elapsed = max(0.0, ended - (ended if started is None else started))
    return {"stage": stage, "status": (status or "unknown").strip().lower(), "started_at_utc": started_text or "unknown", "completed_at_utc": ended_text, "elapsed_seconds": round(elapsed, 3)}
