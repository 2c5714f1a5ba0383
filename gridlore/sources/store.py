"""Contents stored once by their digest, names that point at them, and the collection of what no name points at.

Two tables with a log of commits (sources/log.py): contents by digest and names. A content is written if its digest isn't there; two writers
of one digest conflict and the second finds it. Names are put after their contents, so that a name never points at nothing; what a
writer who died in between has stored is collected later, as is what names pointed at before. Equal contents of a batch meet in the
tasks that have them before anything is shuffled, and a digest is looked for in those files only whose range has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Conflict, Log


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.contents, self.names = Log(spark, f"{path}/contents"), Log(spark, f"{path}/names")

    def put(self, files: DataFrame, tries: int = 20) -> None:
        """files: name, content, at (a whole number that grows). Of a name the last content counts; null contents are none, a null name keeps its content from no collection."""
        f = files.where("content is not null").select("name", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.col("content").cast("binary").alias("content"), F.col("at").cast("long").alias("at"))
        new = f.groupBy("digest").agg(F.min("content").alias("content"), F.max("at").alias("at"))
        for _ in range(tries):
            t = self.contents.begin()
            known = self.contents.read_keys(new, "digest")
            t.insert(new if known is None else new.join(known.select("digest"), "digest", "left_anti"), "digest")
            try:
                t.commit()
                break
            except Conflict:
                t.abandon()
        else:
            raise Conflict(f"{tries} commits to {self.contents.path} met others")
        self.names.upsert(f.where("name is not null").select("name", "digest", "at"), ["name"], "at")

    def index(self) -> DataFrame:
        """digest, size, n_names, least name, latest (of its names) of each content."""
        refs = self.names.read().groupBy("digest").agg(F.count("*").alias("n_names"), F.min("name").alias("name"), F.max("at").alias("latest"))
        sizes = self.contents.read().select("digest", F.octet_length("content").alias("size"))
        return sizes.join(refs, "digest", "left").select("digest", "size", F.coalesce("n_names", F.lit(0)).alias("n_names"), "name", "latest")

    def sweep(self, before: int | None = None) -> int:
        """Delete contents that no name points at and, so that those of a writer at work stay, that were stored before a time; gives how many."""
        t = self.contents.begin()
        dead = self.contents.read(t.version).select("digest", "at").join(self.names.read().select("digest"), "digest", "left_anti")
        dead = dead if before is None else dead.where(F.col("at") < before)
        n = dead.count()
        if n:
            t.replace(dead, self.contents.read(t.version).limit(0), "digest")
            t.commit()
        return n
