"""Balanced samples, row caps and the seeded shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from gainsieve.operators.ordering import any_of, is_up_to, row_ranks


def first_per_class(
    df: DataFrame,
    n: int,
    order: Sequence[str],
    label: str = "label",
    classes: Sequence[Any] = (0, 1),
    split: Sequence[str] = (),
) -> DataFrame:
    """The first ``n`` rows of each class in ``order``, which must identify a row.

    A null in a key sorts first. Repeated keys at the end of the ``n`` rows are an error.
    The key of the ``n``-th row of each class is found on the key columns alone; the
    rows are then taken by comparing keys, so they are not shuffled and the comparison
    reaches the scan. ``split`` names leading order columns that many rows share (file
    and block): rows past the split where a class is full are cut off beforehand.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return df.where(F.lit(False))
    # Fixed size: two bounds per requested class.
    wanted = df.where(F.col(label).isin(list(classes)))
    if split:
        wanted = wanted.where(_within(_split_bounds(wanted, n, split, label), label, split, classes))
    last = row_ranks(wanted, [label], order).where(F.col("rank").isin(n, n + 1)).collect()
    bounds = {row[label]: [row[c] for c in order] for row in last if row["rank"] == n}
    if any(row["rank"] > n and [row[c] for c in order] == bounds[row[label]] for row in last):
        raise ValueError(f"{order} does not identify a row: the last key is repeated")
    return wanted.where(_within(bounds, label, order, classes))


def first_rows(df: DataFrame, n: int, order: Sequence[str], split: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ``order``."""
    tagged = df.withColumn("_all", F.lit(0))
    return first_per_class(tagged, n, order, "_all", (0,), split).drop("_all")


def _split_bounds(df: DataFrame, n: int, split: Sequence[str], label: str) -> dict[Any, list[Any]]:
    """Per class, the split in which the ``n``-th row lies; a table of splits, not of rows."""
    counts = df.groupBy(label, *split).agg(F.count("*").alias("_n"))
    reached = F.sum("_n").over(Window.partitionBy(label).orderBy(*split))
    full = counts.withColumn("_reached", reached).where(F.col("_reached") >= n)
    first = full.groupBy(label).agg(F.min(F.struct(*split)).alias("_split")).collect()
    return {row[label]: list(row["_split"]) for row in first}


def _within(
    bounds: dict[Any, list[Any]], label: str, order: Sequence[str], classes: Sequence[Any]
) -> Column:
    """Up to the bound of the row's class; a class without one is taken whole."""
    return any_of(
        [
            (F.col(label) == F.lit(c)) & is_up_to(order, bounds[c]) if c in bounds else F.col(label) == F.lit(c)
            for c in classes
        ]
    )


def shuffle_key(seed: int, *keys: str) -> Column:
    """A hash of the seed and the row key: the same order for any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_shuffle(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return df.orderBy(shuffle_key(seed, *keys), *keys)


def class_shortfall(sample: DataFrame, n: int, label: str = "label", classes: Sequence[Any] = (0, 1)) -> dict[Any, int]:
    """How many rows each class lacks; empty when every class is full."""
    found = {
        row[label]: row["n"]
        for row in sample.where(F.col(label).isin(list(classes))).groupBy(label).agg(F.count("*").alias("n")).collect()
    }
    return {c: n - found.get(c, 0) for c in classes if found.get(c, 0) < n}
