"""CSV records whose quoted cells span lines, read in splits.

Whether a line begins inside a quoted cell depends on the quotes before it. A first reading
counts the quotes of every split; their running parity, over a table with a row for each split,
tells every split whether it begins inside a cell. The second reading then joins the lines of
each record, and what is left at both ends of a split is put together with its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

QUOTE = '"'
#: Parts of a record: whole, its end at the start of a split, its start at the end of one, a split inside it.
WHOLE, ENDS, STARTS, INSIDE = range(4)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _split_starts(lines: DataFrame) -> DataFrame:
    """``file, block, inside``: whether each split begins inside a quoted cell."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    splits = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class _Split:
    """The parts of the records of one split, a line at a time."""

    def __init__(self, inside: bool):
        self.kind, self.inside, self.held = (ENDS if inside else WHOLE), inside, []

    def add(self, line: str) -> tuple[int, str] | None:
        """A part that ends with this line; an empty line between records is none."""
        odd = line.count(QUOTE) % 2 == 1
        if not self.inside and not odd:
            return (WHOLE, line) if line.strip() else None
        self.held.append(line)
        self.inside ^= odd
        if self.inside:
            return None
        part = self.kind, "\n".join(self.held)
        self.kind, self.held = WHOLE, []
        return part

    def rest(self) -> tuple[int, str] | None:
        if not self.held:
            return None
        return (INSIDE if self.kind == ENDS else STARTS), "\n".join(self.held)


def _parts(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``file, block, seq, kind, record``: the parts of all splits, in order of ``seq`` within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, split, out, seq = None, None, [], 0

        def sent() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "seq", "kind", "record"])

        for batch in batches:
            value, file, block, inside = batch.columns
            file, block = file.dictionary_encode(), block.to_numpy(zero_copy_only=False)
            codes = file.indices.to_numpy(zero_copy_only=False)
            # Where a new file or split begins within the batch.
            new = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (block[1:] != block[:-1]))) if len(codes) else []
            for a, b in zip(new, [*new[1:], len(codes)], strict=True):
                place = file.dictionary[int(codes[a])].as_py(), int(block[a])
                if place != at:
                    if split is not None and (part := split.rest()):
                        out.append((*at, seq, *part))
                    at, split, seq = place, _Split(inside[int(a)].as_py()), 0
                for line in value.slice(int(a), int(b - a)).to_pylist():
                    if part := split.add(line):
                        out.append((*at, seq, *part))
                        seq += 1
            if out:
                yield sent()
                out = []
        if split is not None and (part := split.rest()):
            out.append((*at, seq, *part))
            yield sent()

    # A row for each split, of 128 MB or so.
    known = lines.join(F.broadcast(starts), ["file", "block"]).select("value", "file", "block", "inside")
    return known.mapInArrow(run, "file string, block long, seq long, kind int, record string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, seq, record``: the records of all files below ``path``, the header of each among them.

    A quote inside a quoted cell is doubled, and a cell that holds a quote is quoted, as ``write_table`` writes them.
    Empty lines between records are left out. A file that ends inside a quoted cell is an error.
    """
    lines = _lines(spark, path)
    parts = _parts(lines, _split_starts(lines))
    # Two parts at most for each split.
    ends = parts.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = ends.withColumn("number", F.sum((F.col("kind") == STARTS).cast("int")).over(order))
    whole = F.array_sort(F.collect_list(F.struct("block", "seq", "kind", "record")))
    joined = numbered.groupBy("file", "number").agg(whole.alias("p"))
    closed = F.when(F.element_at("p", -1)["kind"] == ENDS, F.array_join(F.transform("p", lambda x: x["record"]), "\n"))
    record = F.coalesce(closed, F.raise_error(F.concat(F.lit("a quoted cell is not closed at the end of "), F.col("file"))).cast("string"))
    spanning = joined.select("file", F.get("p", F.lit(0))["block"].alias("block"), F.get("p", F.lit(0))["seq"].alias("seq"), record.alias("record"))
    every = parts.where(F.col("kind") == WHOLE).select("file", "block", "seq", "record").unionByName(spanning)
    return every.withColumn("record", F.regexp_replace("record", "\r$", ""))
