"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the threshold, 100 bytes, and by most-significant-digit
passes that stop early: a group of one suffix is not looked at again, and groups that are
left after the last pass are exactly the repeated windows.

The first digit is the least 32-byte string of the window, with its place in it: it depends
on the window alone, so equal windows agree on it, and it stays the same for a run of
windows, which is sorted as one suffix. The second digit is the whole run. Runs that differ
although their first digits agree are sorted window by window in the last pass. Where a task
finds a first digit with many different runs, as a footer of every page makes, it sends only two of
them to be compared; that makes every run of that digit go to the last pass, where the others of the
task go at once. So no group holds more than a few runs of a digit from each task.

Digits are compared as hashes, of 128 bits together for runs and 96 for windows, from independent
tables; results are exact but for a collision of all of these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from gainsieve.llm.packed import bucket_of, pack, runs_of, unpack
from gainsieve.llm.words import least_over, mixed
from gainsieve.session import materialise

_U64 = np.uint64
WINDOW = 100
DIGIT = 32
#: Different runs of one first digit that a task sends to be compared, at most.
MOST_RUNS = 8
#: Bytes hashed at once, text bytes and windows for each bucket, runs a task sends at once.
CHUNK, BUCKET_BYTES, BUCKET_WINDOWS, HELD_RUNS = 1 << 18, 1 << 24, 1 << 19, 1 << 18
NO_KEY = -(1 << 63)
_PLACE = (1 << 20) - 1
SPANS = "doc long, row long, lo long, n long"


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of an odd base and of its inverse, for hashes of substrings."""
    values = mixed(np.arange(1, 257, dtype=_U64) * _U64(2 * seed + 0x9E3779B97F4A7C15))
    base = (int(mixed(np.array([seed], _U64))[0]) & ~7) | 5
    size = CHUNK + WINDOW + 1
    powers = np.full(size, base, _U64)
    inverse = np.full(size, pow(base, -1, 1 << 64), _U64)
    powers[0] = inverse[0] = 1
    return values, np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


_FIRST, _SECOND = _tables(1), _tables(2)


class _Substrings:
    """Hashes of substrings of ``data``, at most a chunk and a window long."""

    def __init__(self, data: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]):
        values, powers, self.inverse = tables
        self.sums = np.zeros(len(data) + 1, _U64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def window_runs(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW, digit: int = DIGIT) -> tuple[np.ndarray, ...]:
    """``digit hash, run hash, start, number of windows`` of the runs of windows in texts laid end to end.

    ``bounds`` are the borders of the texts; no window crosses one.
    """
    empty = np.empty(0, _U64)
    if len(data) < window:
        return empty, empty, np.empty(0, np.int64), np.empty(0, np.int64)
    found = _Substrings(data, _FIRST)
    digits = found.hashes(slice(0, len(data) - digit + 1), slice(digit, len(data) + 1))
    ranked = (digits & _U64(~_PLACE & (1 << 64) - 1)) | np.arange(len(digits), dtype=_U64)
    place = (least_over(ranked, window - digit + 1) & _U64(_PLACE)).astype(np.int64)
    valid = np.zeros(len(place) + 1, np.int8)
    lows, highs = bounds[:-1], bounds[1:] - window + 1
    whole = highs > lows
    valid[lows[whole]] += 1
    valid[highs[whole]] -= 1
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    changes = np.append(True, (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]))
    starts = np.flatnonzero(changes)
    lengths = np.diff(np.append(starts, len(place)))
    kept = valid[starts]
    starts, lengths = starts[kept], lengths[kept]
    at = place[starts]
    first = mixed(digits[at] + _U64(0x9E3779B97F4A7C15))
    runs = _Substrings(data, _SECOND).hashes(starts, starts + lengths + window - 1)
    return first, mixed(runs + (at - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93) + lengths.astype(_U64)), starts, lengths


def _window_hashes(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash of the windows of ``data`` at sorted ``starts``."""
    first, second = np.empty(len(starts), _U64), np.empty(len(starts), _U64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        end = int(np.searchsorted(starts, low + CHUNK + 1 - window))
        part = data[low : int(starts[end - 1]) + window]
        own = starts[at:end] - low
        first[at:end] = _Substrings(part, _FIRST).hashes(own, own + window)
        second[at:end] = _Substrings(part, _SECOND).hashes(own, own + window) >> _U64(32)
        at = end
    return first, second


def _spans(docs: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts of documents as runs ``doc, row, lo, n``."""
    if not len(docs):
        return docs, rows, starts, starts
    order = np.lexsort((starts, rows, docs))
    docs, rows, starts = docs[order], rows[order], starts[order]
    firsts = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)))
    return docs[firsts], rows[firsts], starts[firsts], np.diff(np.append(firsts, len(docs)))


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows sorted by ``columns`` begin a new value."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _later(new: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows behind the first of their value, but for those at the same place, which rows with one key have."""
    at = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (docs != docs[at]) | (starts != starts[at])


def _sent(buckets: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in buckets], pa.int32()), pa.array([d for _, d in buckets], pa.binary())], names=["bucket", "data"])


def _known(docs: np.ndarray, rows: np.ndarray, lo: np.ndarray, n: np.ndarray, buckets: int, found: bool = True) -> list[tuple[int, bytes]]:
    """Spans that need no comparing of runs, dealt to buckets below 0 by their documents: odd ones if found, even ones if open."""
    at = (mixed(docs.astype(_U64) ^ rows.astype(_U64)) % _U64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, docs, rows, lo, n = at[order], docs[order], rows[order], lo[order], n[order]
    return [(-1 - 2 * b - (not found), pack(docs[r], rows[r], lo[r], n[r])) for b, r in runs_of(at)]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``first..last`` of texts laid end to end with their borders; a text longer than a chunk comes in overlapping parts."""
    text = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _runs_of_rows(docs: DataFrame, bits: int, window: int, digit: int) -> DataFrame:
    """First pass: the runs of windows of ``doc, row, t`` by bucket of their first digit.

    Of equal runs in a task only those at the first place are sent to be compared; the others are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> pa.RecordBatch:
            k, f, doc, no, lo, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((no, lo, doc, f, k))
            k, f, doc, no, lo, n = k[order], f[order], doc[order], no[order], lo[order], n[order]
            later = _later(_firsts(k, f), doc, lo)
            out = _known(doc[later], no[later], lo[later], n[later], 1 << bits)
            new = ~later & _firsts(k, f, doc, lo, no)
            k, f, doc, no, lo, n = k[new], f[new], doc[new], no[new], lo[new], n[new]
            kind = np.cumsum(_firsts(k, f))
            digit_of = np.cumsum(_firsts(k)) - 1
            first_kind = kind[_firsts(k)][digit_of] if len(k) else kind
            kinds = (kind - first_kind + 1)[np.append(np.flatnonzero(_firsts(k))[1:], len(k)) - 1][digit_of] if len(k) else kind
            free = (kinds > MOST_RUNS) & (kind - first_kind >= 2)
            out += _known(doc[free], no[free], lo[free], n[free], 1 << bits, found=False)
            k, f, doc, no, lo, n = k[~free], f[~free], doc[~free], no[~free], lo[~free], n[~free]
            return _sent(out + [(b, pack(k[r], f[r], doc[r], no[r], lo[r], n[r])) for b, r in runs_of(bucket_of(k, bits, 64))])

        for batch in batches:
            keys, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, last, data, bounds in _texts(batch, 2):
                for at in range(0, max(1, len(data) - window + 1), CHUNK):
                    part = data[at : at + CHUNK + window - 1] if last == first + 1 else data
                    k, f, starts, n = window_runs(part, bounds if last > first + 1 else np.array([0, len(part)]), window, digit)
                    row = np.searchsorted(bounds, starts, "right") - 1 if last > first + 1 else np.zeros(len(starts), np.int64)
                    held.append((k, f, keys[first + row], numbers[first + row], starts + at - bounds[row], n))
                    if last > first + 1:
                        break
            if sum(len(h[0]) for h in held) >= HELD_RUNS:
                yield send()
                held = []
        if sum(len(h[0]) for h in held):
            yield send()

    return docs.mapInArrow(run, "bucket int, data binary")


def _compare_runs(sent: DataFrame) -> DataFrame:
    """Second pass: ``doc, row, lo, n, found``; found spans repeat earlier text, the others must be compared by window."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            doc, no, lo, n = (np.concatenate(c).astype(np.int64) for c in zip(*(unpack(b, 4) for b in group["data"].to_pylist()), strict=True))
            found = np.full(len(doc), key[0].as_py() % 2 == 1)
        else:
            k, f, doc, no, lo, n = (np.concatenate(c) for c in zip(*(unpack(b, 6) for b in group["data"].to_pylist()), strict=True))
            doc, no, lo, n = doc.astype(np.int64), no.astype(np.int64), lo.astype(np.int64), n.astype(np.int64)
            order = np.lexsort((no, lo, doc, f, k))
            k, f, doc, no, lo, n = k[order], f[order], doc[order], no[order], lo[order], n[order]
            new = _firsts(k, f)
            group_of = np.cumsum(_firsts(k)) - 1
            several = np.bincount(group_of, weights=new)[group_of] > 1 if len(k) else new
            later = _later(new, doc, lo)
            kept = later | several & _firsts(k, f, doc, lo, no)
            doc, no, lo, n, found = doc[kept], no[kept], lo[kept], n[kept], later[kept]
        return pa.table({"doc": doc, "row": no, "lo": lo, "n": n, "found": found})

    return sent.groupBy("bucket").applyInArrow(run, SPANS + ", found boolean")


def _windows_of_rows(docs: DataFrame, open_runs: DataFrame, bits: int, window: int) -> DataFrame:
    """Last pass, first half: hashes of the windows of ``open_runs`` by bucket; again equal windows of a task are sent once."""
    wanted = open_runs.groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    rows = docs.join(wanted, ["doc", "row"]).select("doc", "row", "z", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> pa.RecordBatch:
            a, b, doc, no, s = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((no, s, doc, b, a))
            a, b, doc, no, s = a[order], b[order], doc[order], no[order], s[order]
            later = _later(_firsts(a, b), doc, s)
            out = _known(*_spans(doc[later], no[later], s[later]), 1 << bits)
            new = ~later & _firsts(a, b, doc, s, no)
            a, b, doc, no, s = a[new], b[new], doc[new], no[new], s[new]
            return _sent(out + [(k, pack(a[r], b[r], doc[r], no[r], s[r])) for k, r in runs_of(bucket_of(a, bits, 64))])

        for batch in batches:
            for doc, no, z, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                lo, n = runs.values.field("lo").to_numpy(), runs.values.field("n").to_numpy()
                order = np.argsort(lo)
                lo, n = lo[order], n[order]
                starts = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
                data = np.frombuffer(zstandard.decompress(z.as_py()), np.uint8)
                held.append((*_window_hashes(data, starts, window), np.full(len(starts), doc, np.int64), np.full(len(starts), no, np.int64), starts))
                if sum(len(h[0]) for h in held) >= 4 * HELD_RUNS:
                    yield send()
                    held = []
        if held:
            yield send()

    return rows.mapInArrow(run, "bucket int, data binary")


def _compare_windows(sent: DataFrame) -> DataFrame:
    """Last pass, second half: windows that have an earlier equal one, as spans."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            doc, no, lo, n = (np.concatenate(c).astype(np.int64) for c in zip(*(unpack(b, 4) for b in group["data"].to_pylist()), strict=True))
        else:
            a, b, doc, no, s = (np.concatenate(c) for c in zip(*(unpack(b, 5) for b in group["data"].to_pylist()), strict=True))
            doc, no, s = doc.astype(np.int64), no.astype(np.int64), s.astype(np.int64)
            order = np.lexsort((s, doc, b, a))
            doc, no, s = doc[order], no[order], s[order]
            later = _later(_firsts(a[order], b[order]), doc, s)
            doc, no, lo, n = _spans(doc[later], no[later], s[later])
        return pa.table({"doc": doc, "row": no, "lo": lo, "n": n})

    return sent.groupBy("bucket").applyInArrow(run, SPANS)


def _bits(amount: int, each: int) -> int:
    return max(0, (max(1, -(-amount // each)) - 1).bit_length())


def repeated_spans(docs: DataFrame, compressed: DataFrame, window: int = WINDOW, digit: int = DIGIT) -> DataFrame:
    """``doc, row, lo, n``: windows ``lo .. lo + n - 1`` of a document that also start earlier.

    ``docs`` has ``doc long, row long, t binary``, ``compressed`` the same texts as ``z``. ``row``
    tells texts under one ``doc`` apart; it takes no part in what is earlier.
    """
    size = docs.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    runs = materialise(_compare_runs(_runs_of_rows(docs, _bits(size, BUCKET_BYTES), window, digit)))
    open_runs = runs.where("NOT found").select("doc", "row", "lo", "n")
    many = open_runs.agg(F.sum("n")).first()[0] or 0
    windows = _compare_windows(_windows_of_rows(compressed, open_runs, _bits(many, BUCKET_WINDOWS), window))
    return runs.where("found").select("doc", "row", "lo", "n").unionByName(windows)


def _kept(data: np.ndarray, lo: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Whether each byte stays, given the spans of windows that go."""
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, np.minimum(lo + n + window - 1, len(data)), -1)
    return np.cumsum(change[:-1]) == 0


def _compressed(docs: DataFrame) -> DataFrame:
    """``docs`` with the text ``t`` as ``z``; all other columns stay."""
    fields = [f for f in docs.schema.fields if f.name != "t"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = pa.array([compress(t) for t in batch.column("t").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), packed], names=[*names, "z"])

    return docs.mapInArrow(run, StructType([*fields, StructField("z", BinaryType())]))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, which differs between texts under one ``doc`` and is equal for repeated rows.

    It is the text's hash, so it needs no stored copy of the texts. Where no key but null has
    two texts, it is 0 for all other keys and takes no room.
    """
    hashed = F.xxhash64("t")
    texts = docs.where(F.col("doc") != NO_KEY).select("doc", hashed.alias("h")).groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    several = bool(texts.where("a <> b").limit(1).count())
    return docs.withColumn("row", hashed if several else F.when(F.col("doc") == NO_KEY, hashed).otherwise(F.lit(0)).cast("long"))


def remove_repeats(df: DataFrame, key: str, text: str = "text", window: int = WINDOW, digit: int = DIGIT, as_text: bool = False, carry: Sequence[Column] = ()) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept`` for every row, and the columns of ``carry`` as ``carried``, a struct.

    ``kept`` are the bytes left (binary, or with ``as_text`` the whole characters among them
    as text) when every byte goes that lies in a ``window``-byte
    string which also starts earlier: in a row of a smaller key, or in the same row before.
    Strings are judged on the input. ``n_spans`` counts maximal runs of removed bytes.

    ``key`` is a long and should be unique. Rows with one key are judged each by its own text;
    a string in one of them is earlier than in another only if its start is smaller, so repeated
    rows all stay. A null key counts as the smallest. Null and empty texts have 0 bytes,
    texts shorter than a window stay. An empty table gives none.
    """
    carried = [F.struct(*carry).alias("carried")] if carry else []
    docs = _numbered(df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"), *carried))
    compressed = _compressed(docs.select("doc", "row", "t", *["carried"] * bool(carry)))
    spans = repeated_spans(docs.select("doc", "row", "t"), compressed.select("doc", "row", "z"), window, digit)
    spans = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    both = compressed.join(spans, ["doc", "row"], "left").drop("row")
    fields = [f for f in both.schema.fields if f.name in ("doc", "carried")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for z, found in zip(batch.column("z"), batch.column("spans"), strict=True):
                data = np.frombuffer(zstandard.decompress(z.as_py()), np.uint8)
                if not found.is_valid:
                    out.append((len(data), 0, 0, data.tobytes()))
                    continue
                kept = _kept(data, found.values.field("lo").to_numpy(), found.values.field("n").to_numpy(), window)
                starts = int((~kept[1:] & kept[:-1]).sum()) + int(not kept[0])
                out.append((len(data), int((~kept).sum()), starts, data[kept].tobytes()))
            if as_text:
                out = [(*o[:3], o[3].decode("utf-8", "ignore")) for o in out]
            columns = [pa.array([o[i] for o in out], pa.int64() if i < 3 else pa.string() if as_text else pa.binary()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    counts = [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    left = both.mapInArrow(run, StructType([*fields, *counts, StructField("kept", StringType() if as_text else BinaryType())]))
    return left.select(F.when(F.col("doc") != NO_KEY, F.col("doc")).alias(key), "n_bytes", "n_removed", "n_spans", "kept", *names[1:])
