"""An index of observations kept up to date batch by batch: what has not changed is neither read nor computed again.

Three keyed tables (sources/log.py) in one folder: the rows that are kept (the newest of each group), how many of them have each value, and a
summary of each group. A batch reads the rows of its own groups only. What it brings and what it pushes out become differences of counts (plus
and minus), and the summaries of its groups follow from their counts: sums, ends and the exact median. Rows are committed last, and
every commit has the batch's number in its ledger; so a batch that is run again after a crash finds what it found before, and skips what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..session import cut, drop
from .log import Log


class Index:
    """by: the group, a whole number or a text; row: what names a row of a group; order: newest is greatest (ties go to the greater row); value: a whole number; keep: rows of a group that stay."""

    def __init__(self, spark: SparkSession, path: str, by: str, row: str, order: str, value: str, keep: int):
        self.by, self.row, self.order, self.value, self.keep = by, row, order, value, keep
        self.rows, self.counts, self.summaries = (Log(spark, f"{path}/{name}") for name in ("rows", "counts", "summaries"))

    def apply(self, batch: DataFrame, number: int, name: str = "index") -> None:
        """Take in a batch. Its rows replace rows of the same name; rows without a group or a value are passed over; a number that the ledger has is no batch again."""
        by, ledger = self.by, (name, number)
        if self.rows.entry(self.rows.version())["ledger"].get(name, -1) >= number:
            return
        columns = [by, self.row, self.order, self.value]
        batch = cut(batch.select(*columns).where(f"{by} is not null and {self.value} is not null"))
        groups = cut(batch.select(by).distinct())
        old = self.rows.read_keys(groups, by)
        old = batch.limit(0) if old is None else old.select(*columns)
        both = O.one_of(old.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1))), [by, self.row], F.struct("_b", self.order)).drop("_b")
        kept = cut(O.newest(both, [by], [F.col(self.order).desc(), F.col(self.row).desc()], self.keep))

        change = kept.withColumn("_d", F.lit(1)).unionByName(old.withColumn("_d", F.lit(-1))).groupBy(by, self.value).agg(F.sum("_d").alias("n")).where("n <> 0")
        counts = self.counts.read_keys(groups, by)
        counts = change if counts is None else counts.unionByName(change)
        counts = cut(counts.groupBy(by, self.value).agg(F.sum("n").alias("n")).where("n > 0"))
        # a crash between two commits leaves counts of this batch already, which the ledger tells
        self._put(self.counts, groups, counts, ledger)
        self._put(self.summaries, groups, self.summary(self.counts.read_keys(groups, by)), ledger)
        self._put(self.rows, groups, kept, ledger)
        drop(batch, groups, kept, counts)

    def _put(self, log: Log, groups: DataFrame, rows: DataFrame, ledger: tuple[str, int]) -> None:
        t = log.begin()
        if t.base["ledger"].get(ledger[0], -1) < ledger[1] and not groups.isEmpty():
            t.replace(groups, rows, self.by)
            t.commit(ledger)

    def summary(self, counts: DataFrame) -> DataFrame:
        """by, n, total, least, most, median of groups, from how many rows have each value."""
        by, v = self.by, F.col(self.value)
        w = Window.partitionBy(by).orderBy(v)
        upto, n = F.sum("n").over(w), F.sum("n").over(Window.partitionBy(by))
        places = counts.withColumns({"_upto": upto, "_n": n})
        at = lambda k: F.min(F.when(F.col("_upto") >= k, v))
        return places.groupBy(by).agg(
            F.max("_n").alias("n"), F.sum(v * F.col("n")).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"),
            ((at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2).alias("median"),
        )

    def read(self) -> DataFrame | None:
        return self.summaries.read()
