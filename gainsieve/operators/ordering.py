"""Exact positions in a sorted order, without sorting a class in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from gainsieve.session import materialise


def row_ranks(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``by``, ``order`` and the 1-based rank of each row within its ``by`` group.

    Only these narrow columns are sorted, and by range: a group that holds most rows
    spans many partitions. The rank is the place within the partition plus the rows of
    the same group in earlier partitions, which an offset table with a row for each group
    and partition tells. The sorted keys are written out first, since range
    boundaries come from a sample and may differ if computed again.
    """
    keys = df.select(*by, *order).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = materialise(
        keys.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    )
    blocks = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part")
    shift = F.sum("_n").over(earlier) - F.col("_n") - F.col("_first") + 1
    offsets = blocks.select(*by, "_part", shift.alias("_shift"))
    return _null_safe(placed, offsets, [*by, "_part"]).select(
        *by, *order, (F.col("_at") + F.col("_shift")).alias("rank")
    )


def running_before(df: DataFrame, order: Sequence[str], amount: str, start: str) -> DataFrame:
    """Adds ``start``: the sum of ``amount`` over all rows earlier in ``order``, sorted by range as in ``row_ranks``."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    inside = Window.partitionBy("_part").orderBy("_at")
    # One row per partition.
    parts = placed.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    earlier = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_shift"))
    within = placed.withColumn("_within", F.sum(amount).over(inside) - F.col(amount))
    return within.join(earlier, "_part").withColumn(start, F.col("_shift") + F.col("_within")).drop("_part", "_at", "_within", "_shift")


def _null_safe(rows: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``extra`` where all keys agree, nulls included."""
    named = extra.withColumnsRenamed({k: f"_{k}_" for k in keys})
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(named[f"_{k}_"]) for k in keys])
    return rows.join(named, same)


def is_up_to(order: Sequence[str], bound: Sequence[Any]) -> Column:
    """Lexicographic ``order <= bound``, null first; plain comparisons, so that scans can skip on them."""

    def below(name: str, value: Any) -> Column:
        return F.lit(False) if value is None else F.col(name).isNull() | (F.col(name) < F.lit(value))

    last = below(order[-1], bound[-1]) | F.col(order[-1]).eqNullSafe(F.lit(bound[-1]))
    for name, value in zip(reversed(order[:-1]), reversed(bound[:-1])):
        last = below(name, value) | (F.col(name).eqNullSafe(F.lit(value)) & last)
    return last


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)
