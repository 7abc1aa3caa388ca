"""Byte-level BPE encoding and decoding as tree reductions.

A text is halved until its parts are short; parts are encoded by themselves and joined
upwards. Joining two neighbours encodes a window around their border again. The window
grows to the nearest place on either side where a non-blank is followed by a blank: no
piece of the split pattern holds a blank behind a non-blank, so a piece ends there whatever
surrounds it, and merges never leave a piece. What lies outside the window keeps its
tokens. Decoding concatenates the bytes of halves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from gainsieve.llm.pieces import rank_encoding, token_bytes, token_lengths

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SURE_END = regex.compile(r"\S(?=\s)")
LEAF_CHARS = 4096


def _last_sure_end(text: str, start: int, end: int) -> int:
    """The last sure piece end in ``text[start:end]`` with its blank before ``end``, or ``start``."""
    width = 64
    while True:
        low = max(start, end - width)
        found = list(SURE_END.finditer(text, low, end))
        if found:
            return found[-1].end()
        if low == start:
            return start
        width *= 2


def _first_sure_end(text: str, start: int, end: int) -> int:
    found = SURE_END.search(text, start, end)
    return found.end() if found else end


def encode(text: str, ranks: str = RANKS, leaf: int = LEAF_CHARS) -> np.ndarray:
    """Ids of ``text``, equal to the whole-text encoding by the same ranks."""
    encoding, lengths = rank_encoding(ranks), token_lengths(ranks)

    def part(start: int, end: int) -> np.ndarray:
        if end - start <= leaf:
            return encoding.encode_to_numpy(text[start:end], disallowed_special=())
        middle = (start + end) // 2
        return joined(part(start, middle), part(middle, end), start, middle, end)

    def joined(left: np.ndarray, right: np.ndarray, start: int, middle: int, end: int) -> np.ndarray:
        a, b = _last_sure_end(text, start, middle), _first_sure_end(text, middle, end)
        before, behind = len(text[a:middle].encode()), len(text[middle:b].encode())
        # tokens of the left half that reach into its last `before` bytes, and likewise on the right
        n_left = len(left) - int(np.searchsorted(np.cumsum(lengths[left[::-1]]), before)) - 1 if before else len(left)
        n_right = int(np.searchsorted(np.cumsum(lengths[right]), behind)) + 1 if behind else 0
        window = encoding.encode_to_numpy(text[a:b], disallowed_special=())
        return np.concatenate([left[:n_left], window, right[n_right:]])

    return part(0, len(text))


def decode(ids: np.ndarray, ranks: str = RANKS, leaf: int = LEAF_CHARS) -> bytes:
    """The bytes of ``ids``: those of the first half and those of the second, concatenated."""
    if len(ids) <= leaf:
        return b"".join(map(token_bytes(ranks).__getitem__, ids.tolist()))
    middle = len(ids) // 2
    return decode(ids[:middle], ranks, leaf) + decode(ids[middle:], ranks, leaf)


def encode_table(df: DataFrame, key: str, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``key, ids array<int>`` for every row; a null or empty text has no ids. Repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(t or "", ranks).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def round_trip(df: DataFrame, key: str, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """Digests of the ids and of the decoded bytes: ``key, n_tokens, ids_sha256, decoded_sha256``.

    A null or empty text has no ids. Keys may be null, repeated rows each come back, other columns play no
    part, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = [str(i) for i in range(len(token_bytes(ranks)))]
        for batch in batches:
            counts, digests, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                ids = encode(t or "", ranks)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode(ids, ranks)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["k", "n", "i", "d"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    out = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, n long, i string, d string")
    return out.toDF(key, "n_tokens", "ids_sha256", "decoded_sha256")
