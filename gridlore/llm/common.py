"""Session and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship

#: Bytes of text that the array kernels take at a time; their working memory is about 60 times that.
BLOCK_BYTES = 1_000_000
#: Rows of an Arrow batch between Spark and Python.
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. Where the session names none, a local one in local mode, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridlore-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unique() -> str:
    return uuid.uuid4().hex


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    own = df.select("*")  # a plan of its own, which no other action reads
    out = own.checkpoint(eager=True)
    _free(own)
    return out


def taken(df: DataFrame) -> list:
    """The few rows of df on the driver."""
    own = df.select("*")
    out = own.collect()
    _free(own)
    return out


def counted(df: DataFrame) -> int:
    return taken(df.agg(F.count("*")))[0][0]


def _free(df: DataFrame) -> None:
    """Remove the shuffle files of df's action, which has ended; else they stay until the driver happens to collect its garbage."""
    plan, cleaner = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext._jsc.sc().cleaner()
    if plan.nodeName() == "AdaptiveSparkPlan" and cleaner.isDefined():
        for shuffle in list(plan.context().shuffleIds().keySet().toArray()):
            cleaner.get().doCleanupShuffle(shuffle, False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, null text as empty; rows without a doc_id are kept."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give 0's text."""
    return F.crc32(F.coalesce(doc_id, F.lit(0)).cast("string").cast("binary")) % n


def crc_mod_np(doc_ids: Iterable, n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(str(0 if i is None else int(i)).encode()) % n for i in doc_ids), np.int64)


def text_blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64)
    ends, start, n = np.cumsum(sizes), 0, len(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_blocks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, column: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """fn over slices of whole rows, Arrow in and out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, column, most):
                out = fn(block)
                if out is not None and out.num_rows:
                    yield out

    return arrow(df, run, schema)


def arrow(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def small_batches(spark: SparkSession, most: int = BATCH_ROWS) -> None:
    """Hold Arrow batches, which are as long as their texts, to a few thousand rows; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a].item() for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)
