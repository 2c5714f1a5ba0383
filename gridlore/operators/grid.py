"""Parameter grids: products of domains by mixed-radix ordinals, subsets, and search sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def domains_of(**columns: DataFrame) -> dict[str, list]:
    """The distinct values of a column of each table (no nulls), in order. A grid's domains are its parameters' lists, which the driver holds."""
    return {name: [r[0] for r in df.distinct().where(F.col(df.columns[0]).isNotNull()).orderBy(df.columns[0]).collect()] for name, df in columns.items()}


def size(domains: dict[str, list]) -> int:
    return math.prod(map(len, domains.values()))


def decode(ordinal: Column, domains: dict[str, list]) -> list[Column]:
    """Columns of the parameters of an ordinal; the rightmost runs fastest."""
    out, stride = [], size(domains)
    for name, values in domains.items():
        stride //= len(values)
        out.append(F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.floor(ordinal / stride), F.lit(len(values))) + 1).cast("int")).alias(name))
    return out


def encode(domains: dict[str, list]) -> Column:
    out, stride = F.lit(0).cast("long"), size(domains)
    for name, values in domains.items():
        stride //= len(values)
        out = out + (F.array_position(F.array(*map(F.lit, values)), F.col(name)) - 1) * stride
    return out


def product(spark: SparkSession, domains: dict[str, list]) -> DataFrame:
    """All sets: a range and arithmetic, no join."""
    return spark.range(size(domains)).select(F.col("id").alias("ordinal"), *decode(F.col("id"), domains))


def pinned(grid: DataFrame, pins: dict[str, object], kept: list[str]) -> DataFrame:
    for name, value in pins.items():
        grid = grid.where(F.col(name) == F.lit(value))
    return grid.groupBy(*kept).agg(F.min("ordinal").alias("ordinal"))


def powers_of_two(low: int, high: int) -> list[int]:
    return sorted({low, high, *(1 << k for k in range(high.bit_length()) if low <= 1 << k <= high)})


def divisors(budget: int, low: int, high: int) -> list[int]:
    return [k for k in range(low, min(high, budget) + 1) if budget % k == 0]
