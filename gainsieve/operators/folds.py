"""Fold assignment for cross-validation, and the hold-out split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from gainsieve.operators.ordering import row_ranks, running_before
from gainsieve.operators.profile import MAX_LISTED_CLASSES, class_index
from gainsieve.operators.sampling import shuffle_key
from gainsieve.session import materialise


@dataclass(frozen=True)
class FoldedTable:
    """``row_key, features, label_index, fold``; only the folds in ``tested`` are predicted."""

    df: DataFrame
    classes: list[Any]
    rows: int
    folds: int
    tested: list[int]

    def training(self, fold: int) -> DataFrame:
        return self.df.where(F.col("fold") != fold)

    def testing(self, fold: int) -> DataFrame:
        return self.df.where(F.col("fold") == fold)


def class_facts(df: DataFrame, label: str, order: Sequence[str]) -> dict[Any, int]:
    """Rows per class, in the order in which the classes first appear."""
    rows = (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
        .limit(MAX_LISTED_CLASSES + 1)
        .collect()
    )
    if len(rows) > MAX_LISTED_CLASSES:
        raise ValueError(f"the label has more than {MAX_LISTED_CLASSES} classes")
    return {row[label]: row["n"] for row in sorted(rows, key=lambda r: tuple(r["first"]))}


def class_starts(df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """``label, n, start``: rows of each class, and rows of the classes that first appear before it."""
    found = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    return running_before(found, ["_first", label], "n", "start").drop("_first")


def stratified_folds(df: DataFrame, label: str, order: Sequence[str], folds: int = 5) -> DataFrame:
    """Add ``fold``: each class is cut into ``folds`` runs of consecutive rows in ``order``.

    With all rows sorted by class, in the order in which classes first appear, every
    ``folds``-th row counts toward the same fold, so fold sizes differ by one row at most.

    Only the last key of each run is looked up, on the key columns; the fold is then a
    comparison with the few keys of the row's class. Classes are rows of a table, however
    many there are, and never a list.
    """
    classes = materialise(class_starts(df, label, order))
    if (classes.agg(F.max("n")).first()[0] or 0) < folds:
        raise ValueError(f"no class has {folds} rows")
    # Rows with a place below x that count toward fold f: (x - f + folds - 1) div folds.
    dealt = "((start + n - f + {k}) div {m}) - ((start - f + {k}) div {m})".format(k=folds - 1, m=folds)
    sizes = F.expr(f"transform(sequence(0, {max(folds - 2, 0)}), f -> {dealt})") if folds > 1 else F.array().cast("array<bigint>")
    upto = F.transform("_sizes", lambda _, i: F.aggregate(F.slice("_sizes", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    ends = classes.withColumn("_sizes", sizes).select(label, F.posexplode(upto).alias("_run", "rank"))
    ranks = row_ranks(df.where(F.col(label).isNotNull()), [label], order)
    # A run that ends at rank 0 is empty and passed by every row.
    keys = ends.join(ranks, [label, "rank"], "left").groupBy(label).agg(F.collect_list(F.struct(F.struct(*order).alias("end"), (F.col("rank") == 0).alias("empty"))).alias("_ends"))
    passed = F.filter("_ends", lambda e: e["empty"] | (F.struct(*order) > e["end"]))
    return df.join(keys, label).withColumn("fold", F.size(passed)).drop("_ends")


def held_out(keys: Sequence[str], seed: int = 42, tenths: int = 3) -> Column:
    """1 for the test rows of a seeded split by row key, 0 for the training rows."""
    bucket = F.conv(F.substring(shuffle_key(seed, *keys), 1, 8), 16, 10).cast("bigint") % 10
    return (bucket >= 10 - tenths).cast("int")


def folded_table(
    df: DataFrame, key: str, vector: str = "features", label: str = "label", folds: int = 5, hold_out: bool = False
) -> FoldedTable:
    """Assign folds, or the hold-out split if no class has as many rows as there are folds."""
    counts = class_facts(df, label, [key])
    if not counts:
        raise ValueError("no row with a valid label")
    rows, classes = sum(counts.values()), sorted(counts)
    folds = min(folds, rows)
    if hold_out or max(counts.values()) < folds:
        placed = df.where(F.col(label).isNotNull()).withColumn("fold", held_out([key]))
        folds, tested = 2, [1]
    else:
        placed = stratified_folds(df, label, [key], folds)
        tested = list(range(folds))
    narrow = placed.select(
        F.col(key).alias("row_key"),
        F.col(vector).alias("features"),
        class_index(F.col(label), classes).alias("label_index"),
        "fold",
    )
    return FoldedTable(narrow, classes, rows, folds, tested)
