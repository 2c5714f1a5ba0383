"""Folds over each group's rows in order, streamed: a task holds a fold's state and one Arrow batch, never a group."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ship


def ordered_fold(df: DataFrame, by: list[str], order: list, value: str, start: Callable[[], object], step: Callable[[object, object], tuple], out: list[StructField]) -> DataFrame:
    """df with what step(state, value) gives for each row of a group in order; start() makes a group's state, which step changes in place."""
    ship(df.sparkSession)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartition(n, *by).sortWithinPartitions(*by, *order)
    names, new = df.columns, [f.name for f in out]
    schema = StructType([*df.schema.fields, *out])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for b in batches:
            at = {n: b.column(b.schema.get_field_index(n)) for n in names}
            rows = []
            for key, x in zip(zip(*(at[c].to_pylist() for c in by)), at[value].to_pylist()):
                if state is None or key != group:
                    group, state = key, start()
                rows.append(step(state, x))
            cols = list(zip(*rows)) or [()] * len(new)
            yield pa.RecordBatch.from_arrays([*(at[n] for n in names), *(pa.array(c, pa.int64()) for c in cols)], [*names, *new])

    return dealt.mapInArrow(run, schema)


def _fields(*names: str) -> list[StructField]:
    from pyspark.sql.types import LongType

    return [StructField(n, LongType()) for n in names]


def lanes(tasks: DataFrame, by: list[str], order: list, estimate: str, n: int) -> DataFrame:
    """Each task's lane and start if tasks go, in order, to the least loaded lane (the lowest of equals)."""

    def put(heap, x):
        load, lane = heap[0]
        heapq.heapreplace(heap, (load + int(x), lane))
        return lane, load

    return ordered_fold(tasks, by, order, estimate, lambda: [(0, k) for k in range(n)], put, _fields("lane", "start"))


def makespan(durations: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Longest-first list scheduling: the number of tasks and when the last lane ends."""
    d = durations.select(*by, F.col(value).cast("long").alias(value))
    placed = lanes(d, by, [F.col(value).desc()], value, n)
    return placed.groupBy(*by).agg(F.count("*").alias("n_tasks"), F.max(F.col("start") + F.col(value)).alias("makespan"))


def claim_batches(tasks: DataFrame, by: list[str], order: list, estimate: str, target: int) -> DataFrame:
    """Batches in order, each closed once its estimates reach the target."""

    def put(state, x):
        if state[1] >= target:
            state[0], state[1] = state[0] + 1, 0
        state[1] += int(x)
        return (state[0],)

    return ordered_fold(tasks, by, order, estimate, lambda: [0, 0], put, _fields("batch"))


def throttled(rows: DataFrame, by: list[str], order: list, time: str, every: int, header: int) -> DataFrame:
    """Which rows a reporter emits: those `every` or more after the last emitted one; and before which the header is repeated (each `header` emitted rows)."""

    def put(state, t):
        if state and t - state[0] < every:
            return 0, 0
        n = state[1] if state else 0
        state[:] = [t, n + 1]
        return 1, int(n % header == 0)

    return ordered_fold(rows, by, order, time, list, put, _fields("emitted", "with_header"))
