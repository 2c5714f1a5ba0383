"""Distributed running sums: rows in ranges of an order, local sums in tasks, and one carry a range.

Rows are sorted into ranges; a task takes running sums of its own range in Arrow batches and the result
is checkpointed. Of each range the driver gets one row (its first and last key and its last sums), adds
these up from range to range, and gives each its carry by a broadcast of as many rows. So neither the
rows in all nor those of one key need to meet in a task, as long as `order` tells them apart; rows equal
in all of `order` stay in one. A lost executor costs the tasks of one range after the checkpoint, and the
sort before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common as C


def running(df: DataFrame, order: list[str], sums: dict[str, str], key: str | None = None, xor: bool = False) -> DataFrame:
    """df with the columns of sums: running sums (exclusive ors if `xor`) of long columns, over rows in order and starting anew for each value of `key`, the first of order and a long."""
    fields = [*df.schema.fields, *(StructField(name, LongType()) for name in sums), StructField("_range", LongType())]
    names, op = [f.name for f in fields], np.bitwise_xor if xor else np.add

    def run(batches):
        place, last, held = TaskContext.get().partitionId(), None, np.zeros(len(sums), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.asarray(batch.column(batch.schema.get_field_index(key))) if key else np.zeros(n, np.int64)
            starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
            which, goes_on = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n))), last is not None and keys[0] == last
            out = []
            for k, column in enumerate(sums.values()):
                x = np.asarray(batch.column(batch.schema.get_field_index(column))).astype(np.int64)
                acc = op.accumulate(x)
                before = np.append(0, acc[starts[1:] - 1])
                acc = acc ^ before[which] if xor else acc - before[which]
                if goes_on:
                    acc[which == 0] = op(acc[which == 0], held[k])
                held[k] = acc[-1]
                out.append(pa.array(acc, pa.int64()))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(n, place), pa.int64())], names=names)

    local = C.cut(C.arrow(df.repartitionByRange(*order).sortWithinPartitions(*order), run, StructType(fields)))
    keyed = local.withColumn("_key", F.col(key) if key else F.lit(0).cast("long"))
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    ends = C.taken(keyed.groupBy("_range").agg(F.min("_key").alias("a"), F.max_by(F.struct(F.col("_key"), *sums), F.struct(at, *sums)).alias("z")))
    carries, last, held = [], None, [0] * len(sums)
    for r in sorted(ends, key=lambda r: r["_range"]):
        carry = held if last is not None and r["a"] == last else [0] * len(sums)
        if any(carry):
            carries.append((r["_range"], r["a"], *carry))
        held = [(x ^ c if xor else x + c) if r["z"]["_key"] == r["a"] else x for x, c in zip((r["z"][name] for name in sums), carry)]
        last = r["z"]["_key"]
    if not carries:
        return local.drop("_range")
    table = df.sparkSession.createDataFrame(carries, ", ".join(["_range long", "_key long", *(f"_c{k} long" for k in range(len(sums)))]))
    with_carry = keyed.join(F.broadcast(table), ["_range", "_key"], "left")
    none = F.lit(0).cast("long")
    fix = {name: F.col(name).bitwiseXOR(F.coalesce(F.col(f"_c{k}"), none)) if xor else F.col(name) + F.coalesce(F.col(f"_c{k}"), none) for k, name in enumerate(sums)}
    return with_carry.select(*df.columns, *(c.alias(name) for name, c in fix.items()))
