"""Data preparation: JSON lines to a balanced, scaled feature table."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gainsieve.functions.vectors import fix_width
from gainsieve.operators.sampling import class_shortfall, first_rows, seeded_shuffle
from gainsieve.operators.scaling import first_vector, min_max_scale
from gainsieve.session import materialise
from gainsieve.sources.jsonl import POSITION, file_batches, parse_records, read_lines, write_lines
from gainsieve.sources.tables import widen, write_table

log = logging.getLogger(__name__)

# Sample size and seed.
SAMPLES_PER_CLASS = 2500
SEED = 42


# Bytes of the first batch of files; later ones are twice as large each.
FIRST_BYTES = 1 << 30


def first_lines(spark: SparkSession, source: str, n: int, classes: Sequence[int] = (0, 1), first_bytes: int = FIRST_BYTES) -> DataFrame:
    """``value, label`` and position of the first ``n`` valid lines of each class, stored.

    Files are read in order, a batch at a time, until all classes are full, and every line once: a split
    keeps its first ``n`` lines of each class, and the first of those of all splits are written.
    """
    lacking = dict.fromkeys(classes, n)
    parts = []
    for files in file_batches(spark, source, first_bytes) if n else ():
        wanted = [c for c in classes if lacking[c]]
        parsed = parse_records(read_lines(spark, files)).select("value", "label", *POSITION).where(F.col("label").isin(wanted))
        rank = F.row_number().over(Window.partitionBy("label").orderBy(*POSITION))
        kept = parsed.withColumn("_rank", rank).where(F.col("_rank") <= max(lacking.values()))
        parts.append(materialise(kept.where(F.coalesce(F.create_map(*(F.lit(x) for c in wanted for x in (c, lacking[c])))[F.col("label")], F.lit(0)) >= F.col("_rank")).drop("_rank")))
        for row in parts[-1].groupBy("label").count().collect():
            lacking[row["label"]] -= row["count"]
        if not any(lacking.values()):
            break
    if not parts:
        return parse_records(read_lines(spark, source)).select("value", "label", *POSITION).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def balanced_lines(
    spark: SparkSession, source: str, n: int = SAMPLES_PER_CLASS, seed: int = SEED, first_bytes: int = FIRST_BYTES
) -> DataFrame:
    """The first ``n`` valid lines of class 0 and of class 1, shuffled."""
    if n < 0:
        raise ValueError("n must not be negative")
    sample = first_lines(spark, source, n, first_bytes=first_bytes)
    for cls, lacking in class_shortfall(sample, n).items():
        log.warning("class %s lacks %s of %s rows", cls, lacking, n)
    return seeded_shuffle(sample, POSITION, seed)


def feature_table(
    records: DataFrame, order: Sequence[str] = POSITION, most: int | None = None, split: Sequence[str] = ()
) -> tuple[DataFrame, int]:
    """Equally wide, scaled vectors with their label, and the width.

    The first record sets the width; if it is all zero the vectors are not scaled.
    Without any record the table is empty and the width 0.
    """
    kept = records if most is None else first_rows(records, most, order, split)
    first = first_vector(kept, order).collect()[0]
    width = first["width"] or 0
    if first["nonzero"] == 0:
        log.warning("all features of the first record are zero; scaling is skipped")
    fixed = kept.select(*order, fix_width(F.col("features"), width).alias("features"), "label")
    return min_max_scale(fixed, width, skip=not first["nonzero"]), width


def prepare(
    spark: SparkSession, source: str, sample_path: str, table_path: str, n: int = SAMPLES_PER_CLASS, seed: int = SEED
) -> DataFrame:
    """Write the balanced sample as JSON lines and its feature table as CSV; returns the table."""
    write_lines(balanced_lines(spark, source, n, seed), sample_path)
    records = parse_records(read_lines(spark, sample_path)).drop("value")
    vectors, width = feature_table(materialise(records), most=2 * n)
    table = widen(vectors.orderBy(*POSITION), width)
    write_table(table, table_path)
    return table
