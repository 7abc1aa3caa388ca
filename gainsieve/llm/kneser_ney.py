"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by workers.

Numbering goes up the orders. The words are hashes of 56 bits; from two words on, an n-gram is the pair of
the numbers of the two n-grams in it that are one word shorter, so it takes the bits of two numbers and no more.
Every task counts its n-grams and deals the packed counts to buckets of a key, which is that pair with its
bits spread; a bucket adds them up and writes its keys as a sorted array. Where an n-gram stands in the arrays
is its number. Going down the orders, a bucket passes on what its n-grams say of the shorter ones by their
numbers: of the one without the first word, that one more word stands before it; of the one without the last,
how often and by how many words it is followed. No bucket depends on how frequent a word or n-gram
is, since each task sends one count of it. Scoring maps the arrays of the shared folder and looks up keys.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gainsieve.llm.packed import bucket_of, pack, runs_of, summed, unpack
from gainsieve.llm.words import mixed, word_hashes
from gainsieve.session import scratch_path

_U64 = np.uint64
#: Words are hashes of 56 bits; the start and the end of a text are words of their own.
WORD_SHIFT, WORD_BITS = _U64(8), 56
START, END = _U64(1), _U64(2)
#: Text bytes for each bucket, and tokens that a task counts before it sends their n-grams.
BUCKET_BYTES, HELD_PAIRS = 1 << 23, 2_000_000
#: Bits of a key; pairs of more bits have a hash of so many as their key.
KEY_BITS = 64
#: Bits of a count in an array; the highest stands for a count kept apart.
COUNT_BITS = 4
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def text_tokens(hashes: np.ndarray) -> np.ndarray:
    """Token hashes of a text: its words, then the end."""
    return np.append(hashes >> WORD_SHIFT, END)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(u * _U64(0x9E3779B97F4A7C15) + w * _U64(0xD6E8FEB86659FD93) + _U64(0x2545F4914F6CDD1D))


def _ones(bits: int) -> np.uint64:
    return _U64((1 << bits) - 1)


def spread(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of integers of so many bits that spreads every bit."""
    shift = _U64((bits + 1) // 2)
    for odd in _ODD:
        x = ((x ^ (x >> shift)) * _U64(odd)) & _ones(bits)
    return x ^ (x >> shift)


def gathered(x: np.ndarray, bits: int) -> np.ndarray:
    """What ``spread`` makes ``x`` of."""
    shift = _U64((bits + 1) // 2)
    for odd in reversed(_ODD):
        x = ((x ^ (x >> shift)) * _U64(pow(odd, -1, 1 << 64))) & _ones(bits)
    return x ^ (x >> shift)


@dataclass
class Level:
    """The n-grams of one length: how their keys are made, and how they are numbered."""

    words: int
    #: Numbers of n-grams one word shorter are below it.
    bound: int = 0
    #: Whether the array has counts.
    counted: bool = True
    #: N-grams of a bucket, at most; known when all are counted.
    most: int = 1
    width: int = WORD_BITS
    #: Whether the key tells the pair.
    exact: bool = True

    def __post_init__(self) -> None:
        if self.words > 1:
            self.width = max(1, (self.bound**2 - 1).bit_length())
            if self.width > KEY_BITS:
                self.width, self.exact = 64, False

    def keys(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return spread(u * _U64(self.bound) + v, self.width) if self.exact else pair_hash(u, v)

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(gathered(keys, self.width), _U64(self.bound))


# ---- packed n-grams -------------------------------------------------------------------


def _firsts(columns: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)

def _pack_grams(tokens: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """N-grams sorted by all words but the last, which are kept once for each run."""
    if len(tokens) == 1:
        return pack(*tokens, *values)
    order = np.lexsort(tokens[-2::-1])
    tokens, values = [t[order] for t in tokens], [v[order] for v in values]
    firsts = _firsts(tokens[:-1])
    head, rows = pack(*(t[firsts] for t in tokens[:-1]), np.diff(np.append(firsts, len(order)))), pack(tokens[-1], *values)
    return len(head).to_bytes(8, "little") + head + rows


def _unpack_grams(blob: bytes, words: int, values: int) -> list[np.ndarray]:
    """Columns of words, then of values."""
    if words == 1:
        return unpack(blob, 1 + values)
    size = int.from_bytes(blob[:8], "little")
    *heads, runs = unpack(blob[8 : 8 + size], words)
    return [*(np.repeat(h, runs.astype(np.int64)) for h in heads), *unpack(blob[8 + size :], 1 + values)]


def _pack_sorted(numbers: np.ndarray, *values: np.ndarray) -> bytes:
    """Rising numbers by what each adds to the one before."""
    return pack(np.diff(numbers.astype(_U64), prepend=_U64(0)), *values)


def _unpack_sorted(blob: bytes, values: int) -> list[np.ndarray]:
    steps, *rest = unpack(blob, 1 + values)
    return [np.cumsum(steps, dtype=_U64), *rest]


# ---- sorted arrays in files ------------------------------------------------------------


def _write(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays one behind the other; the file appears at once, so a repeated task does no harm."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as out:
        out.write(np.array([len(a) for a in arrays], "<u8").tobytes())
        for a in arrays:
            out.write(a.tobytes())
    os.replace(part, path)


@lru_cache(maxsize=256)
def _mapped(path: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    if not os.path.exists(path):
        return [np.empty(0, k) for k in kinds]
    whole = np.asarray(np.memmap(path, np.uint8, "r"))  # slices of a plain array are cheaper
    lengths = whole[: 8 * len(kinds)].view("<u8")
    arrays, at = [], 8 * len(kinds)
    for kind, n in zip(kinds, lengths.tolist(), strict=True):
        width = np.dtype(kind).itemsize * n
        arrays.append(whole[at : at + width].view(kind))
        at += width
    return arrays


def _slot_bits(rows: int, bits: int) -> int:
    """Leading bits of keys of ``bits`` bits by which an array of so many is opened: 2 to 4 keys have the same."""
    return min(bits, max(rows.bit_length() - 2, bits - WORD_BITS, 0))


def _packed_bits(x: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of integers without gaps, and eight bytes so that the last can be read as others are."""
    parts = [np.zeros(0, np.uint8)]
    for i in range(0, len(x), 1 << 16):  # a whole number of bytes each
        parts.append(np.packbits(np.unpackbits(x[i : i + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)[:, :bits].ravel(), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


class Grams:
    """The sorted keys of a bucket, without the bits that the bucket and the place in the array tell, and their counts."""

    KINDS = ("<u8", "<u4", "u1", "<u4", "<u8", "<u8", "<u8")

    def __init__(self, path: str, bits: int, counted: bool):
        rows, self.starts, data, self.large_at, self.large, *self.pair = _mapped(path, self.KINDS)
        self.rows = int(rows[0]) if len(rows) else 0
        self.rest = bits - _slot_bits(self.rows, bits)
        self.step = self.rest + COUNT_BITS * counted
        self.data = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,)) if len(data) else np.zeros(0, "<u8")
        self.low = _ones(bits)

    @staticmethod
    def write(path: str, keys: np.ndarray, bits: int, counts: np.ndarray | None, pair: list[np.ndarray]) -> None:
        slots = _slot_bits(len(keys), bits)
        rest = bits - slots
        keys = keys & _ones(bits)
        starts = np.searchsorted(keys >> _U64(rest), np.arange((1 << slots) + 1, dtype=_U64))
        entries, step, large = keys & _ones(rest), rest, np.zeros(0, np.int64)
        if counts is not None:
            top = (1 << COUNT_BITS) - 1
            large = np.flatnonzero(counts >= top)
            entries |= np.minimum(counts, top).astype(_U64) << _U64(rest)
            step += COUNT_BITS
        apart = counts[large] if counts is not None else large
        _write(path, [np.array([len(keys)], "<u8"), starts.astype("<u4"), _packed_bits(entries, step), large.astype("<u4"), apart.astype("<u8"), *(p.astype("<u8") for p in pair or [large, large])])

    def _bits(self, at: np.ndarray, skip: int, bits: int) -> np.ndarray:
        at = at * self.step + skip
        return (self.data[at >> 3] >> (at & 7).astype(_U64)) & _ones(bits)

    def keys(self) -> np.ndarray:
        """All keys, without the bits that the bucket tells."""
        slot = np.repeat(np.arange(len(self.starts) - 1, dtype=_U64), np.diff(self.starts))
        return (slot << _U64(self.rest)) | self._bits(np.arange(self.rows), 0, self.rest)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys are, and whether they are there."""
        keys = keys & self.low
        at, hit = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if not self.rows:
            return at, hit
        slot = (keys >> _U64(self.rest)).astype(np.int64)
        at[:], end, wanted = self.starts[slot], self.starts[slot + 1].astype(np.int64), keys & _ones(self.rest)
        left = np.flatnonzero(at < end)
        while len(left):
            there = self._bits(at[left], 0, self.rest)
            hit[left[there == wanted[left]]] = True
            left = left[there < wanted[left]]
            at[left] += 1
            left = left[at[left] < end[left]]
        return at, hit

    def counts(self, at: np.ndarray) -> np.ndarray:
        found = self._bits(at, self.rest, COUNT_BITS).astype(np.int64)
        large = np.flatnonzero(found == (1 << COUNT_BITS) - 1)
        found[large] = self.large[np.searchsorted(self.large_at, at[large])]
        return found


#: What is known of an n-gram shorter than the longest: different words before it, by how many words seen 1, 2, 3+
#: times it is followed, and how often it is followed (counted as its followers are) beyond the 1, 2 or 3 of these.
KNOWN = 5
_PART, _RARE = 12, 255


class Facts:
    """What is known of the n-grams of a bucket, a byte each for what is true of many."""

    KINDS = ("u1", *["<u8"] * KNOWN, "<u4", *["<u8"] * KNOWN)

    def __init__(self, path: str):
        arrays = _mapped(path, self.KINDS)
        self.codes, self.rare_at = arrays[0], arrays[1 + KNOWN]
        self.common, self.rare = arrays[1 : 1 + KNOWN], arrays[2 + KNOWN :]

    @staticmethod
    def write(path: str, values: list[np.ndarray]) -> None:
        small = np.logical_and.reduce([v < 1 << _PART for v in values])
        joined = sum((v.astype(_U64) << _U64(_PART * i) for i, v in enumerate(values)), np.zeros(len(small), _U64))
        kinds, places, times = np.unique(joined[small], return_inverse=True, return_counts=True)
        often = np.argsort(-times, kind="stable")[:_RARE]
        code = np.full(len(kinds), _RARE, np.uint8)
        code[often] = np.arange(len(often))
        codes = np.full(len(small), _RARE, np.uint8)
        codes[small] = code[places]
        common = [np.append((kinds[often] >> _U64(_PART * i)) & _ones(_PART), np.zeros(_RARE + 1 - len(often), _U64)) for i in range(KNOWN)]
        rare = np.flatnonzero(codes == _RARE)
        _write(path, [codes, *(c.astype("<u8") for c in common), rare.astype("<u4"), *(v[rare].astype("<u8") for v in values)])

    def at(self, places: np.ndarray) -> list[np.ndarray]:
        codes = self.codes[places]
        rare = np.flatnonzero(codes == _RARE)
        where = np.searchsorted(self.rare_at, places[rare])
        out = []
        for common, apart in zip(self.common, self.rare, strict=True):
            out.append(common[codes].astype(np.int64))
            out[-1][rare] = apart[where]
        return out


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all scores need."""

    folder: str
    bits: int
    order: int = 2
    tokens: int = 0
    vocabulary: int = 0
    contexts: int = 0
    #: Of n-grams of 1, 2, ... words.
    discounts: list[tuple[float, float, float]] = field(default_factory=list)
    word_rest: float = 1.0
    levels: list[Level] = field(default_factory=list)

    def grams(self, level: Level, bucket: int) -> Grams:
        return Grams(self._path("grams", level, bucket), level.width - min(self.bits, level.width), level.counted)

    def _path(self, kind: str, level: Level, bucket: int) -> str:
        return f"{self.folder}/{kind}-{level.words}-{bucket}"

    def bucket(self, level: Level, keys: np.ndarray) -> np.ndarray:
        return bucket_of(keys, min(self.bits, level.width), level.width)

    def write_grams(self, level: Level, bucket: int, keys: np.ndarray, counts: np.ndarray, pair: list[np.ndarray]) -> None:
        Grams.write(self._path("grams", level, bucket), keys, level.width - min(self.bits, level.width), counts if level.counted else None, pair)

    def write_facts(self, level: Level, bucket: int, values: list[np.ndarray]) -> None:
        Facts.write(self._path("facts", level, bucket), values)

    def find(self, level: Level, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The numbers of n-grams by their keys, whether they are known, and their counts if these are kept."""
        number, known = np.zeros(len(keys), _U64), np.zeros(len(keys), bool)
        count = np.zeros(len(keys), np.int64) if level.counted else None
        for b, rows in _grouped(self.bucket(level, keys[wanted]), np.flatnonzero(wanted)):
            grams = self.grams(level, b)
            at, hit = grams.find(keys[rows])
            at, rows = at[hit], rows[hit]
            number[rows], known[rows] = (b * level.most + at).astype(_U64), True
            if level.counted:
                count[rows] = grams.counts(at)
        return number, known, count

    def facts(self, level: Level, number: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
        """What is known of n-grams by their numbers; of unknown ones, zeros."""
        out = [np.zeros(len(number), np.int64) for _ in range(KNOWN)]
        bucket, place = np.divmod(number[known].astype(np.int64), level.most)
        for b, at, rows in _grouped(bucket, place, np.flatnonzero(known)):
            for o, v in zip(out, Facts(self._path("facts", level, b)).at(at), strict=True):
                o[rows] = v
        return out

    def numbered(self, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the n-grams of ``words`` words that begin at every word, and whether they are known."""
        number, known, _ = self.find(self.levels[0], hashes, np.ones(len(hashes), bool))
        for level in self.levels[1:words]:
            number, known, _ = self.find(level, level.keys(number[:-1], number[1:]), known[:-1] & known[1:])
        return number, known

    def score(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, float]]:
        """``n_tokens, n_known, base_score, score`` of texts given as token hashes."""
        before = self.order - 1
        lengths = [len(t) for t in texts]
        whole = np.concatenate([part for t in texts for part in (np.full(before, START), t)])
        # Where the tokens are in the texts with what stands before them.
        at = np.arange(sum(lengths)) + before * np.repeat(np.arange(1, len(texts) + 1), lengths)

        number, known, count = self.find(self.levels[0], whole, np.ones(len(whole), bool))
        count = count[at]
        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))
        contexts, *followers = self.facts(self.levels[0], number, known)
        d = np.array((0.0, *self.discounts[0]))
        n = contexts[at]
        p = np.maximum(n - d[np.minimum(n, 3)], 0) / max(self.contexts, 1) + self.word_rest / (self.vocabulary + 1)
        for level in self.levels[1:]:
            number, known, found = self.find(level, level.keys(number[:-1], number[1:]), known[:-1] & known[1:])
            *some, beyond = (f[at - level.words + 1] for f in followers)
            total = beyond + some[0] + 2 * some[1] + 3 * some[2]
            if level.words < self.order:
                found, *followers = self.facts(level, number, known)
            n = found[at - level.words + 1]
            d = np.array((0.0, *self.discounts[level.words - 1]))
            rest = sum(x * f for x, f in zip(self.discounts[level.words - 1], some, strict=True)) / np.maximum(total, 1)
            p = np.where(total > 0, np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total, 1) + rest * p, p)
        logs = np.log10(p)
        first = 0
        for length in lengths:
            part = slice(first, first + length)
            yield length, int((count[part] > 0).sum()), float(base[part].sum()), float(logs[part].sum())
            first += length


def _grouped(buckets: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Every bucket with its rows of the columns."""
    order = np.argsort(buckets.astype(np.uint16) if len(buckets) and buckets.max() < 1 << 16 else buckets, kind="stable")
    for b, rows in runs_of(buckets[order]):
        yield b, *(c[order[rows]] for c in columns)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many entries are seen 1, 2, 3 and 4 times; a half where these are too few to tell."""
    if min(n[:4]) <= 0:
        return (0.5, 0.5, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    found = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return tuple(min(max(d, 0.01), float(i)) for i, d in enumerate(found, 1))


# ---- counting --------------------------------------------------------------------------


def _tokens(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for _, hashes in word_hashes(batch.column(column)):
            yield text_tokens(hashes)


def _shared(path: str) -> str:
    """``path`` as workers open it."""
    if "://" not in path.replace("file://", "", 1) and (path.startswith(("file:", "/"))):
        return "/" + path.removeprefix("file:").lstrip("/")
    raise ValueError(f"{path}: arrays can only be memory-mapped in a folder that is mounted on all workers; set spark.checkpoint.dir to one")


def train(df: DataFrame, text: str = "text", order: int = 2) -> Model:
    """The model of all texts of ``df``, of n-grams of up to ``order`` words, 2 at least.

    A null or empty text is the end alone; repeated rows count again.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    bits = max(0, (max(1, -(-size // BUCKET_BYTES)) - 1).bit_length())
    folder = _shared(scratch_path(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    model = Model(folder, bits, order)

    for words in range(1, order):
        level = Level(words, _bound(model), counted=words == 1)
        model.levels.append(level)
        found = rows.mapInArrow(_counter(model, level), "bucket int, data binary").groupBy("bucket").applyInArrow(_writer(model, level), "most long, tokens long, vocabulary long")
        most, tokens, vocabulary = found.agg(F.max("most"), F.sum("tokens"), F.sum("vocabulary")).first()
        level.most = most or 1
        if words == 1:
            model.tokens, model.vocabulary = tokens or 0, vocabulary or 0

    model.levels.append(Level(order, _bound(model)))
    passed = "bucket int, before binary, after binary, seen array<long>"
    grams = rows.mapInArrow(_counter(model, model.levels[-1]), "bucket int, data binary")
    for level in reversed(model.levels):
        grams = grams.groupBy("bucket").applyInArrow(_passer(model, level), passed if level.words > 1 else "seen array<long>")
    totals = [int(t or 0) for t in grams.agg(*(F.sum(F.col("seen")[i]) for i in range(2 + 4 * order))).first()]
    seen = [totals[4 * i : 4 + 4 * i] for i in range(order)]  # of the longest first
    model.discounts = [discounts(s) for s in reversed(seen)]
    model.contexts, m3 = totals[4 * order :]
    if model.contexts:
        model.word_rest = sum(d * m for d, m in zip(model.discounts[0], (*seen[-1][:2], m3), strict=True)) / model.contexts
    return model


def _bound(model: Model) -> int:
    return model.levels[-1].most << model.bits if model.levels else 0


def _counter(model: Model, level: Level) -> Callable:
    """Counts the n-grams of a task's texts and deals them to buckets."""

    def send(texts: list[np.ndarray]) -> pa.RecordBatch:
        if level.words == 1:
            # The start is a word that is counted never.
            key, values = summed(np.append(START, np.concatenate(texts)), [np.append(0, np.ones(sum(map(len, texts)), np.int64))])
        else:
            whole = np.concatenate([part for t in texts for part in (np.full(model.order - 1, START), t)])
            number, known = model.numbered(whole, level.words - 1)
            within = known[:-1] & known[1:]
            if level.words == 2:
                within &= whole[:-1] != END  # a text ends there
            pair = [number[:-1][within], number[1:][within]]
            key, values = _times(level.keys(*pair), [] if level.exact else pair, level.counted)
        packed = [(b, _pack_rows(level, key[r], [v[r] for v in values])) for b, r in runs_of(model.bucket(level, key))]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int32()), pa.array([d for _, d in packed], pa.binary())], names=["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = [], 0
        for tokens in _tokens(batches):
            texts.append(tokens)
            held += len(tokens)
            if held >= HELD_PAIRS:
                yield send(texts)
                texts, held = [], 0
        if texts:
            yield send(texts)

    return run


def _times(keys: np.ndarray, pair: list[np.ndarray], counted: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted different keys, the pair of each if given, and how often each occurs if ``counted``."""
    order = np.argsort(keys) if pair else None
    keys = keys[order] if pair else np.sort(keys)
    firsts = _firsts([keys])
    times = [np.diff(np.append(firsts, len(keys)))] if counted else []
    return keys[firsts], [*(p[order[firsts]] for p in pair), *times]


def _pack_rows(level: Level, keys: np.ndarray, values: list[np.ndarray]) -> bytes:
    return _pack_sorted(keys, *values) if level.exact else _pack_grams(values[:2], values[2:])


def _added(level: Level, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted different keys of a bucket, their counts, and the pairs where keys do not tell them."""
    if level.exact:
        columns = [np.concatenate(c) for c in zip(*(_unpack_sorted(b, int(level.counted)) for b in blobs), strict=True)]
        key, values = summed(columns[0], columns[1:])
        return key, values[0].astype(np.int64) if values else np.zeros(len(key), np.int64), []
    u, v, *counts = (np.concatenate(c) for c in zip(*(_unpack_grams(b, 2, int(level.counted)) for b in blobs), strict=True))
    keys = level.keys(u, v)
    order = np.argsort(keys)
    firsts = _firsts([keys[order]])
    sums = np.add.reduceat(counts[0][order], firsts).astype(np.int64) if counts else np.zeros(len(firsts), np.int64)
    return keys[order[firsts]], sums, [u[order[firsts]], v[order[firsts]]]


def _writer(model: Model, level: Level) -> Callable:
    """Writes the n-grams of a bucket; where they stand is their number."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keys, counts, pair = _added(level, group["data"].to_pylist())
        model.write_grams(level, key[0].as_py(), keys, counts, pair)
        return pa.table({"most": [len(keys)], "tokens": [int(counts.sum())], "vocabulary": [int((counts > 0).sum())]})

    return run


def _passer(model: Model, level: Level) -> Callable:
    """Writes what is known of the n-grams of a bucket and passes on what they say of shorter ones.

    The longest come as counts and are added up and written first.
    """

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if level.words == model.order:
            keys, n, pair = _added(level, group["data"].to_pylist())
            model.write_grams(level, bucket, keys, n, pair)
            seen = []
        else:
            grams = model.grams(level, bucket)
            values = [np.zeros(grams.rows, np.int64) for _ in range(KNOWN)]
            for name, own in (("before", values[:1]), ("after", values[1:])):
                for blob in group[name].to_pylist():
                    if blob is not None:
                        places, *facts = _unpack_sorted(blob, len(own))
                        for o, f in zip(own, facts, strict=True):
                            o[places.astype(np.int64)] += f.astype(np.int64)
            model.write_facts(level, bucket, values)
            n = values[0]
            if level.words > 1:
                keys, pair = (_U64(bucket) << _U64(level.width - min(model.bits, level.width))) | grams.keys(), grams.pair
            seen = np.sum([s for s in group["seen"].to_pylist() if s is not None], axis=0).astype(np.int64).tolist()
        seen += [int((n == i).sum()) for i in range(1, 5)]
        if level.words == 1:
            return pa.table({"seen": pa.array([[*seen, int(n.sum()), int((n >= 3).sum())]], pa.list_(pa.int64()))})
        first, last = level.pairs(keys) if level.exact else pair
        some = n > 0  # others are known as contexts only
        first, last, n = first[some], last[some], n[some]
        one = np.ones(len(n), np.int64)
        dealt: dict[int, list[bytes | None]] = {}
        most = _U64(model.levels[level.words - 2].most)
        for i, (number, facts) in enumerate(((last, [one]), (first, [n == 1, n == 2, n >= 3, n - np.minimum(n, 3)]))):
            number, facts = summed(number, [f.astype(np.int64) for f in facts])
            for b, r in runs_of((number // most).astype(np.int64)):
                dealt.setdefault(b, [None, None])[i] = _pack_sorted(number[r] % most, *(f[r] for f in facts))
        dealt = dealt or {0: [None, None]}  # what was seen is passed on all the same
        told = [seen, *[[0] * len(seen)] * (len(dealt) - 1)]
        return pa.table({"bucket": pa.array(list(dealt), pa.int32()), "before": pa.array([d[0] for d in dealt.values()], pa.binary()), "after": pa.array([d[1] for d in dealt.values()], pa.binary()), "seen": pa.array(told, pa.list_(pa.int64()))})

    return run


def score(df: DataFrame, model: Model, key: str, text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, base_score, score`` for every row.

    Tokens are the words and one end. ``base_score`` is add-one unigram, ``score`` Kneser-Ney,
    both sums of log10 probabilities. A null or empty text is the end alone; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, out = [], 0, []
            for _, hashes in word_hashes(batch.column(1)):
                texts.append(text_tokens(hashes))
                held += len(texts[-1])
                if held >= HELD_PAIRS // 2:
                    out += model.score(texts)
                    texts, held = [], 0
            if texts:
                out += model.score(texts)
            columns = [pa.array([o[i] for o in out], pa.int64() if i < 2 else pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["k", "n", "known", "base", "score"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    out = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, n long, known long, base double, score double")
    return out.toDF(key, "n_tokens", "n_known", "base_score", "score")


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)
