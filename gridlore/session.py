"""What a session needs so that this package's Python functions run on its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application; they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gridlore-"), "gridlore-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where none is named, a local one in local mode, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridlore-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written as a table of the shared folder and read again. A lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def dealt(df: DataFrame, key: str, buckets: int, spread: bool = True) -> DataFrame:
    """df as `cut` gives it, dealt out by a hash of key to so many buckets: joins and groups by key of tables that are dealt alike move no rows.

    spread: bring the rows of a bucket to one task first; without it they should lie so already, else a bucket has many files.
    """
    spark = df.sparkSession
    name = f"dealt_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    (df.repartition(buckets, key) if spread else df).write.bucketBy(buckets, key).option("path", path).saveAsTable(name, format="parquet")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files outside of the warehouse stay, and so does the table that was read
    out._cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables that `cut` or `dealt` wrote and nothing reads any more."""
    for df in frames:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
