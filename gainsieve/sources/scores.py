"""Feature scores as tab-separated part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsieve.functions.text import text_to_double

SCORE_SEPARATOR = "\t"
# Writer and reader agree on these, so any name comes back as it was.
FORMAT = {
    "sep": SCORE_SEPARATOR,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "",
}


def write_scores(scores: DataFrame, path: str) -> None:
    """``feature<TAB>score`` without a header, replacing what was there."""
    (
        scores.select("feature", "score")
        .write.mode("overwrite")
        .options(**FORMAT)
        .csv(path)
    )


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Every part file below ``path``; lines that are not a name and a number are left out."""
    rows = (
        spark.read.options(**FORMAT, pathGlobFilter="part-*", multiLine="true")
        .schema("feature string, value string, more string")
        .csv(path)
    )
    return (
        rows.where("more IS NULL AND value IS NOT NULL")
        .select(F.coalesce("feature", F.lit("")).alias("feature"), text_to_double(F.col("value")).alias("score"))
        .where("score IS NOT NULL")
    )
