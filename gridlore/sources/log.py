"""Keyed tables with a log of commits: snapshots by version, writers that need no lock, batches that count once.

A table is a folder of data files and `_log`, with one entry for each version: the files that make up the version with the range of the first key column
(whole numbers, floats or texts) of each, what the commit took away and added, and the ledger of batches. A commit is an entry under the next number, put there by a rename
that fails if the number is taken. So a writer who dies leaves files that no entry names and nobody reads, never a lock; `vacuum` takes
them away. A writer who finds its number taken looks at what the commits between have written: if the key ranges are apart from those
that it read, it goes on to the next number, else its commit is a conflict and is done again from the newest version.
(HDFS checks and renames in one step. A local disk does it in two, which is for tests.)
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ordered as O


class Conflict(Exception):
    """Another writer has changed what a commit was made from."""


@dataclass
class File:
    """A data file, by its path within the table, with the least and the greatest value of the first key column."""

    name: str
    low: object
    high: object

    def meets(self, low: object, high: object) -> bool:
        return low is None or self.low is None or (self.low <= high and low <= self.high)


class Log:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self.store = self.fs.Path(self.path).getFileSystem(conf)
        self.files = self.fs.FileContext.getFileContext(self.store.makeQualified(self.fs.Path(self.path)).toUri(), conf)

    def _at(self, *names: str):
        return self.store.makeQualified(self.fs.Path("/".join((self.path, *names))))

    # versions
    def version(self) -> int:
        """The newest version, or -1."""
        log = self._at("_log")
        numbers = [int(s.getPath().getName()[:-5]) for s in self.store.listStatus(log) if s.getPath().getName()[:1].isdigit()] if self.store.exists(log) else []
        return max(numbers, default=-1)

    def entry(self, version: int) -> dict:
        """files, added and removed files, schema and ledger of a version."""
        if version < 0:
            return {"files": [], "added": [], "removed": [], "schema": None, "ledger": {}}
        stream = self.store.open(self._at("_log", f"{version:020d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        e = json.loads(text)
        return e | {k: [File(**f) for f in e[k]] for k in ("files", "added", "removed")}

    def put(self, version: int, entry: dict) -> bool:
        """Make an entry the version, unless there is one."""
        temp, stream = self._at("_log", f".{uuid.uuid4().hex}"), None
        self.store.mkdirs(self._at("_log"))
        stream = self.store.create(temp)
        stream.write(bytearray(json.dumps(entry | {k: [vars(f) for f in entry[k]] for k in ("files", "added", "removed")}).encode()))
        stream.close()
        try:
            none = self.spark._sc._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            self.files.rename(temp, self._at("_log", f"{version:020d}.json"), none)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self.store.delete(temp, False)
            return False

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, the newest by default; None where there is none yet."""
        e = self.entry(self.version() if version is None else version)
        return self._read(e["files"], e["schema"]) if e["schema"] else None

    def _read(self, files: list[File], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{f.name}" for f in files)) if files else self.spark.createDataFrame([], kind)

    def touched(self, files: list[File], keys: DataFrame, key: str) -> list[File]:
        """The files whose range has one of the keys: keys meet the files' ranges, which are broadcast, and names come back."""
        known = [f for f in files if f.low is not None]
        if not known:
            return files
        ranges = self.spark.createDataFrame([(f.name, f.low, f.high) for f in known], f"_name string, _low {dict(keys.dtypes)[key]}, _high {dict(keys.dtypes)[key]}")
        names = {r[0] for r in keys.select(key).distinct().join(F.broadcast(ranges), F.col(key).between(F.col("_low"), F.col("_high"))).select("_name").distinct().collect()}
        return [f for f in files if f.low is None or f.name in names]

    def read_keys(self, keys: DataFrame, key: str) -> DataFrame | None:
        """The rows of some keys, from the files that may have them."""
        e = self.entry(self.version())
        return self._read(self.touched(e["files"], keys, key), e["schema"]).join(keys.select(key).distinct(), key, "left_semi") if e["schema"] else None

    # commits
    def begin(self) -> Transaction:
        return Transaction(self)

    def upsert(self, new: DataFrame, key: list[str], order: str, keep: int | None = None, by: list[str] | None = None, arrival: bool = False, batch: tuple[str, int] | None = None, tries: int = 20) -> int:
        """Put rows in, the last in order wins by key (with arrival, any new row wins over old ones); of each group `by` the `keep` newest stay. The version that has them. A batch (name, number) that the ledger has is put in already."""
        for _ in range(tries):
            t = self.begin()
            if batch and t.base["ledger"].get(batch[0], -1) >= batch[1]:
                return t.version
            t.upsert(new, key, order, keep, by, arrival)
            try:
                return t.commit(batch)
            except Conflict:
                t.abandon()
        raise Conflict(f"{tries} commits to {self.path} met others")

    def vacuum(self, versions: int = 3, older_s: float = 86400.0) -> int:
        """Delete folders of data that none of the newest versions reads and that have been there for a time, and log entries before those; gives the number of folders."""
        newest = self.version()
        keep = {f.name.split("/")[0] for v in range(max(0, newest - versions + 1), newest + 1) for f in self.entry(v)["files"]}
        old, n = (time.time() - older_s) * 1000, 0
        for s in self.store.listStatus(self._at()):
            name = s.getPath().getName()
            if name.startswith("data-") and name not in keep and s.getModificationTime() <= old:
                n += bool(self.store.delete(s.getPath(), True))
        return n


class Transaction:
    """A change that was made from one version; nothing of it is seen before commit."""

    def __init__(self, log: Log):
        self.log, self.version = log, log.version()
        self.base = log.entry(self.version)
        self.low = self.high = None
        self.added: list[File] = []
        self.removed: list[File] = []
        self.schema, self.folders, self.whole = self.base["schema"], [], False

    def upsert(self, new: DataFrame, key: list[str], order: str, keep: int | None = None, by: list[str] | None = None, arrival: bool = False) -> None:
        """Write rows and those of the files whose keys they may replace; with `keep`, all rows."""
        self.low, self.high = new.agg(F.min(key[0]), F.max(key[0])).first()
        self.whole = keep is not None or new.where(F.col(key[0]).isNull()).limit(1).count() > 0
        self.removed = [f for f in self.base["files"] if self.whole or self.low is not None and f.meets(self.low, self.high)]
        old = self.log._read(self.removed, self.schema) if self.removed else new.limit(0)
        out = O.upsert(old, new, key, order) if arrival else O.one_of(old.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)), allowMissingColumns=True), key, F.struct(order, "_b")).drop("_b")
        if keep is not None:
            out = O.newest(out, by or [], [F.col(order).desc()], keep)
        self.schema = json.dumps(json.loads(out.schema.json()))
        self._write(out, key[0])

    def replace(self, keys: DataFrame, rows: DataFrame, key: str) -> None:
        """Put rows in for all rows of some keys (a column `key`, no nulls), which they alone may have. Files that hold none of the keys aren't read."""
        self.low, self.high = keys.agg(F.min(key), F.max(key)).first()
        self.removed = self.log.touched(self.base["files"], keys, key)
        if self.schema is None:
            self.schema = rows.schema.json()
        rest = self.log._read(self.removed, self.schema).join(keys.select(key).distinct(), key, "left_anti") if self.removed else None
        rows = rows.select(*self.log._read([], self.schema).columns)
        self._write(rows if rest is None else rest.select(*rows.columns).unionByName(rows), key)

    def insert(self, rows: DataFrame, key: str) -> None:
        """Add rows whose keys (a column `key`, no nulls) the version doesn't have; it's a conflict if someone else writes in their range."""
        self.schema = self.schema or rows.schema.json()
        self.low, self.high = rows.agg(F.min(key), F.max(key)).first()
        self._write(rows.select(*self.log._read([], self.schema).columns), key)

    def _write(self, out: DataFrame, key: str) -> None:
        folder = f"data-{uuid.uuid4().hex}"
        out.repartitionByRange(key).write.parquet(f"{self.log.path}/{folder}")
        self.folders.append(folder)
        ranges = self.log._read([File(folder, None, None)], self.schema).groupBy("_metadata.file_name").agg(F.min(key), F.max(key), F.count(F.when(F.col(key).isNull(), 1)))
        self.added = [File(f"{folder}/{name}", None if nulls else low, None if nulls else high) for name, low, high, nulls in ranges.collect()]  # a row a file

    def commit(self, batch: tuple[str, int] | None = None) -> int:
        """The version that the change became."""
        at, base = self.version, self.base
        while True:
            gone = {f.name for f in self.removed}
            ledger = base["ledger"] | ({batch[0]: batch[1]} if batch else {})
            entry = {"files": [f for f in base["files"] if f.name not in gone] + self.added, "added": self.added, "removed": self.removed, "schema": self.schema, "ledger": ledger, "at": time.time()}
            if self.log.put(at + 1, entry):
                return at + 1
            at, base = at + 1, self.log.entry(at + 1)
            others = base["added"] + base["removed"]
            if self.whole or any(self.low is not None and f.meets(self.low, self.high) or any(f.meets(g.low, g.high) for g in self.removed) for f in others) or batch and base["ledger"].get(batch[0], -1) >= batch[1]:
                raise Conflict(f"version {at} of {self.log.path} has changed keys that this change was made from")

    def abandon(self) -> None:
        for folder in self.folders:
            self.log.store.delete(self.log._at(folder), True)


def upsert_stream(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str, wait: Callable[[int], None] | None = None) -> StreamingQuery:
    """Keep a keyed table by a stream, each micro-batch once: a batch that is run again, as its writer died between the commit and
    the checkpoint, is in the ledger under the stream's id, which the checkpoint holds. With a lost checkpoint the stream has a new id and
    all its rows come again; last wins by key, so that the table stays what it was. wait: called before each commit with the batch's number (for tests)."""
    log = Log(stream.sparkSession, path)

    def put(rows: DataFrame, number: int) -> None:
        at = log.fs.Path(checkpoint, "metadata")
        reader = at.getFileSystem(stream.sparkSession._jsc.hadoopConfiguration()).open(at)
        try:
            name = json.loads(bytes(reader.readAllBytes()).decode())["id"]
        finally:
            reader.close()
        if wait:
            wait(number)
        log.upsert(O.one_of(rows, key, F.col(order)), key, order, batch=(name, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
