"""JSON-lines source and sink."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsieve.functions.records import extracted
from gainsieve.functions.text import is_filled

# Input order of a line: file, split, place within the split.
POSITION = ("source_file", "source_block", "source_row")

# The part of the position that is shared by all lines of one split.
SPLIT = POSITION[:2]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines with their position."""
    return (
        spark.read.text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias(POSITION[0]),
            F.col("_metadata.file_block_start").alias(POSITION[1]),
            F.monotonically_increasing_id().alias(POSITION[2]),
        )
        .where(is_filled(F.col("value")))
    )


def file_batches(spark: SparkSession, path: str | list[str], first_bytes: int) -> Iterator[list[str]]:
    """The files below ``path`` in order of their names, in batches of twice the bytes each time.

    Only the listing is read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    batch: list[str] = []
    held, most = 0, first_bytes
    for row in sorted(listed.where("length > 0").collect()):
        batch.append(row["path"])
        held += row["length"]
        if held >= most:
            yield batch
            batch, held, most = [], 0, 2 * most
    if batch:
        yield batch


def parse_records(
    lines: DataFrame, column: str = "value", numeric_strings: bool = False, valid_only: bool = True
) -> DataFrame:
    """Add ``label`` and ``features``; lines without both are dropped, or malformed ones only."""
    return lines.select("*", F.inline(extracted(F.col(column), numeric_strings, valid_only)))


def record_counts(lines: DataFrame, column: str = "value", numeric_strings: bool = False) -> DataFrame:
    """One row: lines, valid records among them, and rejected lines."""
    kept = F.size(extracted(F.col(column), numeric_strings))
    counted = lines.select(kept.alias("n")).agg(F.count("*").alias("n_lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_valid"))
    return counted.withColumn("n_rejected", F.col("n_lines") - F.col("n_valid"))


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """The original lines, byte for byte."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
