"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least two periods long, that no
neighbouring word extends. Periods below twice the least length are found by comparing the words
with themselves at every such lag. For a longer period q, the scale S with S <= q < 2S takes
grams of S/2 words and windows of S/2 grams. The first window of a run fits into one period, so
the window a period later holds the same words and its least gram lies at distance q: pairs of
equal minimizers at distance S to 2S seed the lags to look at, and each seed is extended both ways.

Grams of a small period, up to S/4, are no minimizers, as a stretch of them would make
pairs without end. A first window that has no other grams lies in a run R of that period, found at
a smaller scale, and three things can follow. If R ends within the first period, the run a
period later ends alike, so equal last grams of such runs are seeds as well. If R ends later, but
inside the run, the next run of R's period begins before R ends; lags that carry the one
into the other are every such period, and those that leave room for two periods are seeds.
Else the stretch would have R's period, not q.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gainsieve.llm.words import least_over, mixed

_U64 = np.uint64
LEAST = 12
#: Words looked at together, of as many texts as that takes.
WORDS = 1 << 16
_BASE = 0x5851F42D4C957F2D
_NONE = _U64(0xFFFFFFFFFFFFFFFF)


class _Stretches:
    """Hashes of stretches of ``x``, by prefix polynomials."""

    def __init__(self, x: np.ndarray):
        self.x = x
        powers, self.inverse = np.full(len(x) + 1, _BASE, _U64), np.full(len(x) + 1, pow(_BASE, -1, 1 << 64), _U64)
        powers[0] = self.inverse[0] = 1
        powers, self.inverse = np.multiply.accumulate(powers), np.multiply.accumulate(self.inverse)
        self.sums = np.zeros(len(x) + 1, _U64)
        np.cumsum(mixed(x.astype(_U64) + _U64(0x9E3779B97F4A7C15)) * powers[:-1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def alike(self, starts: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.hashes(starts, starts + size) == self.hashes(starts + lag, starts + lag + size)

    def extended(self, at: np.ndarray, lag: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Around every place, the stretch ``lo..hi`` of places that equal the one a lag later; ``most`` bounds its length."""
        lo, hi = at.copy(), at.copy()
        step = 1 << max(most, 1).bit_length()
        while step:
            fits = np.flatnonzero(hi + step + lag <= len(self.x))
            hi[fits] += step * self.alike(hi[fits], lag[fits], step)
            fits = np.flatnonzero(lo >= step)
            lo[fits] -= step * self.alike(lo[fits] - step, lag[fits], step)
            step >>= 1
        return lo, hi


def _equal_stretches(x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of places whose word equals the one ``lag`` later."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], x[:-lag] == x[lag:], [False]])))
    return edges[::2], edges[1::2]


def _prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


def _has_smaller_period(x: np.ndarray, hashed: _Stretches, lo: int, end: int, period: int) -> bool:
    """Whether the stretch has a period that divides ``period``; any smaller one would, as it is two periods long."""
    for p in _prime_factors(period):
        d = period // p
        if hashed.alike(np.array([lo]), d, end - lo - d)[0] and (x[lo : end - d] == x[lo + d : end]).all():
            return True
    return False


def _seeds(hashed: _Stretches, runs: list[tuple[int, int, int]], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags, from ``scale`` to twice that, among which every run of such a period has one."""
    n, gram = len(hashed.x), scale // 2
    starts = np.arange(n - gram + 1)
    grams = mixed(hashed.hashes(starts, starts + gram))
    short = [(lo, end, d) for lo, end, d in runs if d <= gram // 2 and end - lo >= gram]
    change = np.zeros(len(grams) + 1, np.int64)
    if short:
        np.add.at(change, [lo for lo, _, _ in short], 1)
        np.add.at(change, [end - gram + 1 for _, end, _ in short], -1)
    places = _U64((1 << n.bit_length()) - 1)
    ranked = np.where(np.cumsum(change[:-1]) > 0, _NONE, (grams & ~places) | starts.astype(_U64))
    least = np.unique(least_over(ranked, scale // 2)) if len(ranked) >= scale // 2 else np.empty(0, _U64)
    at = np.unique((least[least != _NONE] & places).astype(np.int64))
    ends = np.array([end - gram for _, end, _ in short], np.int64)
    values = np.concatenate([grams[at], mixed(grams[ends] + _U64(1))])
    at = np.concatenate([at, ends])
    order = np.lexsort((at, values))
    at, values = at[order], values[order]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    # Equal anchors keep a quarter of a scale apart, so a few steps reach all within two scales.
    for step in range(1, len(at)):
        lag = at[step:] - at[:-step]
        near = (values[step:] == values[:-step]) & (lag < 2 * scale)
        if not near.any():
            break
        far = near & (lag >= scale)
        found.append((at[:-step][far], lag[far]))
    for d in sorted({d for _, _, d in short}):
        same = sorted(r for r in short if r[2] == d)
        for (lo, end, _), (next_lo, next_end, _) in zip(same, same[1:], strict=False):
            most = min(end - lo, next_end - next_lo, (next_end - lo) // 2, 2 * scale - 1)
            if next_lo <= end and most >= scale:
                shifts = lo + np.arange(d)
                for s in np.flatnonzero(hashed.hashes(shifts, shifts + d) == hashed.hashes(np.array([next_lo]), np.array([next_lo + d])))[:1]:
                    phase = (next_lo - lo - int(s)) % d
                    lags = np.arange(scale + (phase - scale) % d, most + 1, d)
                    found.append((np.maximum(lo, next_lo - lags), lags))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def find_runs(x: np.ndarray, longest: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``start, end, period`` of all runs of ``least`` words or more, sorted by start and period; no run is over ``longest`` words."""
    hashed, runs, short = _Stretches(x), [], 2 * least

    def add(lo: int, hi: int, lag: int) -> None:
        if not _has_smaller_period(x, hashed, lo, hi + lag, lag):
            runs.append((lo, hi + lag, lag))

    for lag in range(1, min(short - 1, longest // 2) + 1):
        lows, highs = _equal_stretches(x, lag)
        for at in np.flatnonzero(highs - lows >= max(lag, least - lag)):
            add(int(lows[at]), int(highs[at]), lag)
    scale = short
    while 2 * scale <= longest:
        at, lag = _seeds(hashed, runs, scale)
        lo, hi = hashed.extended(at, lag, longest)
        long = hi - lo >= lag
        seeds = {(int(a), int(q)): (int(i), int(b)) for a, q, i, b in zip(lo[long], lag[long], at[long], hi[long], strict=True)}
        kept = set()
        for (a, q), (i, b) in seeds.items():
            if (x[a:b] != x[a + q : b + q]).any():  # hashes were equal, words are not
                differs = np.flatnonzero(x[: len(x) - q] != x[q:])
                place = int(np.searchsorted(differs, i))
                a = int(differs[place - 1]) + 1 if place else 0
                b = int(differs[place]) if place < len(differs) else len(x) - q
                if b - a < q:
                    continue
            kept.add((a, b, q))
        for a, b, q in sorted(kept):
            add(a, b, q)
        scale *= 2
    return sorted((lo, end, d) for lo, end, d in runs)


def _chunk(texts: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs ``row, start, length, period`` of some texts, their borders, and which words stay."""
    ids: dict[bytes, int] = {}
    lengths = np.array([len(words) for words in texts])
    starts = np.cumsum(lengths + 1) - lengths - 1
    x = np.empty(int(lengths.sum()) + len(texts), np.int64)
    for row, (words, at) in enumerate(zip(texts, starts.tolist(), strict=True)):
        x[at : at + len(words)] = [ids.setdefault(w, len(ids)) for w in words]
        x[at + len(words)] = -1 - row  # equals nothing else
    found = np.array(find_runs(x, int(lengths.max()), least) or np.empty((0, 3)), np.int64).reshape(-1, 3)
    row = np.searchsorted(starts, found[:, 0], "right") - 1
    change = np.zeros(len(x) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    return np.column_stack([row, found[:, 0] - starts[row], found[:, 1] - found[:, 0], found[:, 2]]), starts, np.cumsum(change[:-1]) == 0


#: From a key and the number of words, the order in which the words are taken, or none.
Order = Callable[[Any, int], np.ndarray | None]


def periodic_runs(df: DataFrame, key: str, text: str = "text", least: int = LEAST, order: Order | None = None, words_at_once: int = WORDS) -> DataFrame:
    """``key, n_words, runs, collapsed`` for every row.

    ``runs`` are all runs of ``least`` words or more as ``start, length, period``, in words from 0, by
    start and period; ``collapsed`` are the words that lie in no run behind its first period,
    joined by blanks. Words are parted by ASCII white space and compared exactly. ``order`` tells the
    order in which the words of a text are taken.

    Null, empty and blank texts have no words and no runs. Repeated rows each come back, any key
    may be null, other columns play no part, an empty table gives none. A text is
    looked at whole, however long.
    """
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def answer(keys: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found, starts, stays = _chunk(texts, least)
        joined = [b" ".join(compress(words, stays[at : at + len(words)])) for words, at in zip(texts, starts.tolist(), strict=True)]
        borders = np.append(0, np.cumsum(np.bincount(found[:, 0], minlength=len(texts)))).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], fields=list(struct))
        columns = [keys, pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(borders), runs), pa.array([j.decode() for j in joined])]
        return pa.RecordBatch.from_arrays(columns, names=["k", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for row, (k, t) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                words = (t or "").encode().split()
                if order is not None and (places := order(k, len(words))) is not None:
                    words = [words[i] for i in places]
                held.append(words)
                size += len(words)
                if size >= words_at_once:
                    yield answer(batch.column(0).slice(first, len(held)), held)
                    first, held, size = row + 1, [], 0
            if held:
                yield answer(batch.column(0).slice(first, len(held)), held)

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    found = rows.mapInArrow(run, f"k {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("k", key)
