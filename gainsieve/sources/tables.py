"""Headered CSV tables, target resolution, wide feature tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window, functions as F, types as T

from gainsieve.functions.text import numeric_target, stripped, text_to_double
from gainsieve.functions.vectors import feature_names
from gainsieve.sources.quoted import read_records

# Header names that mark the target column, whatever their case.
TARGET_NAMES = ("label", "class", "avclass", "target")

# A quote inside a quoted cell is doubled.
QUOTE = '"'

# A character that no text file holds, so that a line stays one field.
NO_SEPARATOR = "\x01"
WHOLE_LINE = "_whole_line"


def reject_duplicates(names: Iterable[str]) -> None:
    repeated = sorted(n for n, times in Counter(names).items() if times > 1)
    if repeated:
        raise ValueError(f"column names occur more than once: {repeated}")


def resolve_target(columns: Sequence[str], names: Sequence[str] = TARGET_NAMES) -> str:
    """The first column with a known name, else the last one."""
    if not columns:
        raise ValueError("the table has no columns")
    return next((c for c in columns if c.strip().lower() in names), columns[-1])


def feature_columns(columns: Sequence[str], target: str) -> list[str]:
    return [c for c in columns if c != target]


def _header(spark: SparkSession, path: str, sep: str) -> tuple[str, list[str]]:
    """The first line of the first file, as it stands and as names."""
    line = _line_reader(spark).csv(path).limit(1).collect()
    if not line:
        raise ValueError(f"no header in {path}")
    text = line[0][0]
    cells = spark.range(1).select(split_cells(F.lit(text), sep)).collect()[0][0]
    names = [cell.strip() for cell in cells]
    reject_duplicates(names)
    return text, names


def _line_reader(spark: SparkSession) -> DataFrameReader:
    """Whole lines through the CSV source, which knows the header of each file."""
    return spark.read.option("sep", NO_SEPARATOR).option("quote", "")


def split_cells(line: Column, sep: str = ",") -> Column:
    """The cells of a line; quoted ones may hold the separator, and quotes doubled.

    A quote that is not closed is an error: the cell goes on in the next line.
    """
    exact = re.escape(sep)
    pieces = F.regexp_extract_all(
        F.concat(F.lit(sep), line), F.lit(f'{exact}\\s*("([^"]|"")*+"[^{exact}]*|[^{exact}]*)'), F.lit(1)
    )
    unquoted = F.transform(
        pieces,
        lambda piece: F.when(
            piece.startswith(QUOTE),
            F.when(
                piece.rlike('^"([^"]|"")*+"'),
                F.replace(F.regexp_extract(piece, '^"(([^"]|"")*+)"', 1), F.lit(QUOTE * 2), F.lit(QUOTE)),
            ).otherwise(F.raise_error(F.concat(F.lit("a quoted cell is not closed on its line: "), F.left(line, F.lit(200))))),
        ).otherwise(piece),
    )
    return F.when(line.contains(QUOTE), unquoted).otherwise(F.split(line, exact))


@dataclass(frozen=True)
class CellTable:
    """Rows as one array of text cells: the form for tables of thousands of columns."""

    df: DataFrame
    columns: list[str]


def _records_as_cells(spark: SparkSession, path: str, sep: str) -> CellTable:
    """Records that may span lines; the first of each file is its header."""
    records = read_records(spark, path)
    first = Window.partitionBy("file").orderBy("block", "seq")
    heads = records.where("block = 0").withColumn("_nr", F.row_number().over(first)).where("_nr = 1").select("file", "seq", "record")
    texts = [r["record"] for r in heads.select("record").distinct().limit(2).collect()]
    if len(texts) != 1:
        raise ValueError(f"no header in {path}" if not texts else f"the files of {path} have different headers: {texts}")
    names = [cell.strip() for cell in spark.range(1).select(split_cells(F.lit(texts[0]), sep)).collect()[0][0]]
    reject_duplicates(names)
    # The header is the first record of the split at 0, of which no other has its number.
    rows = records.where((F.col("block") != 0) | (F.col("seq") != 0))
    cells = F.slice(split_cells(F.col("record"), sep), 1, len(names))
    return CellTable(rows.select(cells.alias("cells")), names)


def read_cells(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> CellTable:
    """A CSV file, folder or glob with one header per file.

    Every file must have the same header line, else the read fails. Cells past the
    header are dropped, missing ones at the end of a line are left out. Rows are lines, so
    large files are read in splits; a quoted cell that spans lines fails the read. With
    ``multi_line`` it does not: files are then read twice, still in splits, and every quote must
    stand in a quoted cell.
    """
    if multi_line:
        return _records_as_cells(spark, path, sep)
    text, names = _header(spark, path, sep)
    lines = (
        _line_reader(spark)
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", WHOLE_LINE)
        .schema(T.StructType([T.StructField(text, T.StringType()), T.StructField(WHOLE_LINE, T.StringType())]))
        .csv(path)
        # A line that holds the separator byte itself comes as a whole in the other column.
        .select(F.coalesce(F.col(WHOLE_LINE), F.col(f"`{text}`")).alias("line"))
    )
    cells = F.slice(split_cells(F.col("line"), sep), 1, len(names))
    return CellTable(lines.where(F.col("line").isNotNull()).select(cells.alias("cells")), names)


def read_table(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """The same as one text column per name, cells trimmed and empty ones null.

    With ``multi_line`` quoted cells may span lines, as in ``read_cells``.
    """
    table = read_cells(spark, path, sep, multi_line)
    cells = [stripped(F.get("cells", F.lit(i))) for i in range(len(table.columns))]
    return table.df.select(*[F.when(c != "", c).alias(name) for c, name in zip(cells, table.columns)])


def cells_to_vectors(table: CellTable, target: str | None = None) -> DataFrame:
    """``features, label``: the cells as numbers, null where they are none, and the numeric target."""
    place = table.columns.index(target or resolve_target(table.columns))
    others = F.concat(F.slice("cells", 1, place), F.slice("cells", place + 2, len(table.columns)))
    return table.df.select(
        F.transform(others, text_to_double).alias("features"),
        numeric_target(F.get("cells", F.lit(place))).alias("label"),
    )


def widen(
    df: DataFrame, width: int, vector: str = "features", label: str = "label", keep: Sequence[str] = ()
) -> DataFrame:
    """One column per vector element, then the label; for use right before a sink."""
    elements = [F.get(F.col(vector), F.lit(i)).alias(name) for i, name in enumerate(feature_names(width))]
    return df.select(*keep, *elements, F.col(label).alias("label"))


def narrow(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """The columns of a wide numeric table as one vector."""
    return df.select(
        F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("features"),
        F.col(f"`{target}`").alias("label"),
    )


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", QUOTE).csv(path)


def written_bytes(spark: SparkSession, path: str) -> int:
    """Size of the data files under ``path``, from file metadata alone."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length")
    )
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).collect()[0][0]


def preview(df: DataFrame, features: int = 10, rows: int = 3, label: str = "label") -> DataFrame:
    """The first columns and the label of a few rows."""
    shown = feature_columns(df.columns, label)[:features]
    return df.select(*[f"`{c}`" for c in shown], label).limit(rows)
