"""Best-fit packing of tokenised documents by a plan over the histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens. The driver sees one count per
length, so at most ``capacity`` rows, and packs counts instead of documents: lengths from
the longest down, each into the open bins with the least sufficient room, whole groups of
equal bins at once. Pieces then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gainsieve.llm.common import running_starts
from gainsieve.llm.pieces import rank_encoding
from gainsieve.session import materialise

#: The ranks of ``byte_bpe_50k.json``: the same vocabulary, ids and split pattern.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Where its added tokens are; a text that holds their strings is split at them.
ADDED = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
SEPARATOR_ID = 0
#: A larger plan is joined by shuffling; both ways give one result.
MOST_BROADCAST_SLOTS = 200_000
PIECE = "piece int, start long, length long, ids_crc32 long"


def token_pieces(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, ranks: str = RANKS, with_ids: bool = False, added: str | None = ADDED) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` (and ``ids``) for the pieces of every document.

    A document is its ids and a closing 0, so a null or empty text is one token. Only longer
    documents are cut; their first piece takes the remainder, the others are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(ranks, added)
        for batch in batches:
            rows, out = [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoding.encode_to_numpy(t or "", allowed_special="all"), SEPARATOR_ID).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append(row)
                    out.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype(np.int32)] if with_ids else [])))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *columns], names=["k", "piece", "start", "length", "crc", "ids"][: 1 + len(kinds)])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    schema = f"k {rows.schema['k'].dataType.simpleString()}, {PIECE}" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(length, first_rank, last_rank, per_bin, first_bin, offset)`` for counts of lengths.

    Rank r of a length, within ``first_rank..last_rank``, goes to bin
    ``first_bin + (r - first_rank) // per_bin`` at ``offset`` plus its place there times the
    length. The work depends on the number of lengths, not on the counts: a group of equal
    bins is split at most once for each length.
    """
    slots, bins = [], 0
    rooms: list[int] = []  # sorted rooms left, with the groups of equal bins of each
    groups: dict[int, list[tuple[int, int]]] = {}  # room: [(first_bin, number of bins)]

    def open_group(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, number = capacity, bins, -(-left // (capacity // length))
                bins += number
            fits = room // length
            full = min(number, left // fits)
            if full:
                slots.append((length, rank, rank + full * fits - 1, fits, first, capacity - room))
                open_group(room - fits * length, first, full)
                rank, left = rank + full * fits, left - full * fits
            rest = left if full < number else 0
            if rest:
                slots.append((length, rank, rank + rest - 1, rest, first + full, capacity - room))
                open_group(room - rest * length, first + full, 1)
                rank, left, full = rank + rest, 0, full + 1
            open_group(room, first + full, number - full)
    return slots


def _ranked(pieces: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` within ``length`` from 0.

    A length may be that of a third of all rows, so its rows are ranked in salted groups, each
    starting behind the groups before it.
    """
    salts = max(8, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    starts = running_starts(sizes, ["length"], ["_salt"], "_n", "_before").select("length", "_salt", "_before")
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece", "ids_crc32"))
    return salted.withColumn("_inside", inside).join(starts, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_inside") - 1)


def pack(pieces: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (as ``token_pieces`` makes them, stored) with ``sequence_id`` and ``offset``.

    ``pieces`` is read twice, so it must be a table that reads the same each time. The plan has
    a few rows for each length and is joined as a broadcast while it is small; an empty table packs to none.
    """
    spark: SparkSession = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = best_fit_plan(counts, capacity)
    plan = spark.createDataFrame(slots, "length long, lo long, hi long, per_bin long, first_bin long, at long")
    if len(slots) <= MOST_BROADCAST_SLOTS:
        plan = F.broadcast(plan)
    slot = F.col("rank") - F.col("lo")
    placed = _ranked(pieces, key).join(plan, "length").where("rank BETWEEN lo AND hi")
    return placed.select(
        *pieces.columns,
        (F.col("first_bin") + F.expr("(rank - lo) DIV per_bin")).alias("sequence_id"),
        (F.col("at") + F.pmod(slot, F.col("per_bin")) * F.col("length")).alias("offset"),
    )


def pack_documents(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, ranks: str = RANKS, added: str | None = ADDED) -> DataFrame:
    """Pieces of all documents with their places: ``key``, the columns of a piece, ``sequence_id, offset``.

    A null or empty text is one token. Keys may be null or have any name that is not one of those columns;
    repeated rows are packed as often as they occur. An empty table packs to none.
    """
    own = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    packed = pack(materialise(token_pieces(own, "_key", "_text", capacity, ranks, added=added)), "_key", capacity)
    if key in packed.columns:
        raise ValueError(f"the key has the name of a column of the result: {key}")
    return packed.withColumnRenamed("_key", key)
