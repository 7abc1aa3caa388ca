"""What several operators share: white space, tables, replaced columns, salted ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: ASCII white space; everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but for ``names``, which the caller replaces (in any letter case)."""
    gone = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in gone]


def words_of(text: Column) -> Column:
    """Words of ``text`` as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def fenced(value: Column) -> Column:
    """``value`` in a form that keeps later filters above the projection it stands in.

    A filter that is pushed below takes the expressions of its columns with it, and an array
    that a lambda looks into would then be worked out again for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def running_starts(groups: DataFrame, within: Sequence[str], order: Sequence[str], amount: str, start: str) -> DataFrame:
    """Adds ``start``: the sum of ``amount`` over earlier groups of the same ``within``.

    ``groups`` has a row per group of rows, not per row, so a window does not grow with the rows.
    """
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn(start, F.coalesce(F.sum(amount).over(before), F.lit(0)))


def fold_of(key: str, folds: int) -> Column:
    """The fold of a row: CRC-32 of its key as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
