"""Class distribution and data-set profile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from gainsieve.functions.entropy import entropy_from_sums, entropy_of, n_log_n

# Above this many classes the counts stay distributed and are not brought to the driver.
MAX_LISTED_CLASSES = 1000


@dataclass(frozen=True)
class ClassProfile:
    """Row total and label entropy; ``counts`` is None when there are too many classes to list."""

    total: int
    entropy: float
    counts: dict[Any, int] | None

    @property
    def classes(self) -> list[Any]:
        if self.counts is None:
            raise ValueError(f"the label has more than {MAX_LISTED_CLASSES} classes")
        return sorted(self.counts)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class; rows without a label are left out."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("cls")).agg(F.count("*").alias("n"))


def class_totals(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: labelled rows and number of classes."""
    return class_distribution(df, label).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("n_classes")
    )


def label_entropy(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: labelled rows and the entropy of the label."""
    sums = class_distribution(df, label).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(n_log_n(F.col("n"))), F.lit(0.0)).alias("s"),
    )
    return sums.select("total_rows", entropy_from_sums(F.col("total_rows"), F.col("s")).alias("entropy"))


def class_profile(df: DataFrame, label: str = "label", most: int = MAX_LISTED_CLASSES) -> ClassProfile:
    """Run the label scan (one narrow column) and bring back at most ``most`` classes.

    Raises ``ValueError`` when no row has a label.
    """
    rows = class_distribution(df, label).limit(most + 1).collect()
    if not rows:
        raise ValueError("no row with a valid label")
    if len(rows) > most:
        total, entropy = label_entropy(df, label).collect()[0]
        return ClassProfile(total, entropy, None)
    counts = {row["cls"]: row["n"] for row in rows}
    return ClassProfile(sum(counts.values()), entropy_of(counts.values()), counts)


def class_index(label: Column, classes: Sequence[Any]) -> Column:
    """Place of the label in ``classes``, null for any other label."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.nullif(place.cast("int") - 1, F.lit(-1))


def dataset_profile(
    df: DataFrame,
    label: str = "label",
    vector: str = "features",
    classes: Sequence[int] = (0, 1),
    wanted_per_class: int = 2500,
) -> DataFrame:
    """One row: rows, widest vector, and count and shortfall of each class."""
    per_class = [F.count_if(F.col(label) == F.lit(c)) for c in classes]
    return df.agg(
        F.count("*").alias("total_rows"),
        F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("n_features"),
        *[n.alias(f"class_{c}") for c, n in zip(classes, per_class)],
        *[F.greatest(F.lit(wanted_per_class) - n, F.lit(0)).alias(f"short_{c}") for c, n in zip(classes, per_class)],
    )
