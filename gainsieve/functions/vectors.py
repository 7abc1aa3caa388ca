"""Expressions over ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def fix_width(vector: Column, width: int | Column) -> Column:
    """Pad with 0.0 on the right, or cut, to ``width`` elements."""
    width = F.lit(width) if isinstance(width, int) else width
    missing = F.greatest(width - F.size(vector), F.lit(0))
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), missing)), F.lit(1), width)


def gather(vector: Column, positions: Sequence[int]) -> Column:
    """The elements at ``positions``, in that order."""
    return F.array(*[F.get(vector, F.lit(int(p))) for p in positions])


def vector_width(df: DataFrame, vector: str = "features") -> int:
    """The widest vector of the table; 0 if it has none."""
    return df.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]


def nonzero_count(vector: Column) -> Column:
    return F.size(F.filter(vector, lambda x: x != 0))


def feature_name(position: Column) -> Column:
    return F.format_string("feature_%04d", position)


def feature_names(width: int) -> list[str]:
    return [f"feature_{i:04d}" for i in range(width)]
