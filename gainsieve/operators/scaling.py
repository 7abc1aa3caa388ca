"""Min-max scaling of vectors."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gainsieve.functions.vectors import nonzero_count


def column_bounds(df: DataFrame, vector: str = "features") -> DataFrame:
    """Minimum and maximum per position; NaN and null elements do not count."""
    cells = df.select(F.posexplode(vector).alias("pos", "x")).where("x IS NOT NULL AND NOT isnan(x)")
    return cells.groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def low_and_span(df: DataFrame, width: int, vector: str = "features") -> tuple[list[float | None], list[float]]:
    """The bounds by position, on the driver: two lists as long as one data row is wide.

    A position without any number has no low; a constant one gets span 1.
    """
    low: list[float | None] = [None] * width
    span = [1.0] * width
    for pos, least, most in column_bounds(df, vector).where(F.col("pos") < width).collect():
        low[pos] = least
        span[pos] = most - least if most > least else 1.0
    return low, span


def first_vector(df: DataFrame, order: Sequence[str], vector: str = "features") -> DataFrame:
    """One row about the first record in ``order``: its width and its non-zero elements."""
    facts = F.struct(F.size(vector).alias("width"), nonzero_count(F.col(vector)).alias("nonzero"))
    return df.agg(F.min_by(facts, F.struct(*order)).alias("first")).select("first.*")


def min_max_scale(
    df: DataFrame, width: int, vector: str = "features", skip: bool = False
) -> DataFrame:
    """Every position scaled to [0, 1]; a constant one becomes 0. ``skip`` leaves them alone."""
    if skip:
        return df
    low, span = (F.from_json(F.lit(json.dumps(x)), "array<double>") for x in low_and_span(df, width, vector))
    shifted = F.zip_with(F.col(vector), low, lambda x, least: x - least)
    return df.withColumn(vector, F.zip_with(shifted, span, lambda x, size: x / size))


def scale_guarded(
    df: DataFrame, order: Sequence[str], vector: str = "features", width: int | None = None
) -> DataFrame:
    """Scaling that is skipped when the first record is all zero, as a broken input shows."""
    first = first_vector(df, order, vector).collect()[0]
    if first["width"] is None:
        return df
    return min_max_scale(df, width or first["width"], vector, skip=first["nonzero"] == 0)
