"""Periodic runs against a search over all starts and periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gainsieve.llm import periodic as P
from gainsieve.llm.queries import looped, op12_periodic_runs


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def plain_runs(w, least):
    """Maximal stretches by every lag, kept if the lag is their smallest period."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least and smallest_period(w[i : j + q]) == q:
                found.append((i, j + q, q))
            i = max(j, i + 1)
    return sorted(found)


def words_of_kind(dice, kind, n):
    if kind == "random":
        return [dice.randint(0, 2) for _ in range(n)]
    if kind == "one":
        return [0] * n
    if kind == "thue":
        return [bin(i).count("1") % 2 for i in range(n)]
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == "junctions":  # stretches of one root that meet out of phase
        root = [dice.randint(0, 1) for _ in range(dice.randint(1, 4))]
        out = []
        while len(out) < n:
            out += (root * 60)[: dice.randint(2, 50)]
        return out[:n]
    block = [dice.randint(0, 3) for _ in range(dice.randint(1, max(n // 3, 1)))]
    out = (block * n)[:n]
    for _ in range(dice.randint(0, 3)):
        out[dice.randrange(n)] = 7
    return out


@pytest.mark.parametrize("kind", ["random", "one", "thue", "fibonacci", "junctions", "blocks"])
@pytest.mark.parametrize("least", [2, 3, 12])
def test_all_runs(kind, least):
    dice = random.Random(least)
    for trial in range(40):
        n = dice.randint(1, 150) if trial < 36 else 400
        w = words_of_kind(dice, kind, n)
        x = np.array([*w, -1], np.int64)
        assert P.find_runs(x, n, least) == plain_runs(w, least), w


def test_runs_survive_equal_hashes(monkeypatch):
    """With hashes that nearly all collide, comparing words gives the same runs."""
    monkeypatch.setattr(P, "_BASE", 1)
    monkeypatch.setattr(P, "mixed", lambda v: v & np.uint64(1))
    dice = random.Random(5)
    for _ in range(10):
        w = words_of_kind(dice, "blocks", 80)
        found = P.find_runs(np.array(w, np.int64), 80, 3)
        assert set(found) <= set(plain_runs(w, 3))


def digest(doc_id, text, least=12):
    words = (text or "").encode().split()
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, least)
    gone = {i for lo, end, q in runs for i in range(lo + q, end)}
    lines = "".join(f"{lo},{end - lo},{q}\n" for lo, end, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(((lo - end, lo, q) for lo, end, q in runs), default=None)
    told = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query(spark, tmp_path, documents):
    rows = [(k, t) for k, t in documents if len(t or "") < 3000]
    rows += [(None, "a b " * 20), (None, None), (17, "z " * 9), (3, "q w e r t y u i o p " * 4)]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 8
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    expected = sorted((digest(k, t) for k, t in rows), key=repr)
    assert sorted((tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr) == expected


def test_odd_tables(spark, frame, documents):
    got = P.periodic_runs(frame, "doc_id", words_at_once=500)
    assert got.count() == len(documents) and got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert P.periodic_runs(frame.limit(0), "doc_id").count() == 0


def test_very_long_text():
    """200,000 words, of one word and of random ones with a long period, in linear time."""
    assert P.find_runs(np.zeros(200_000, np.int64), 200_000) == [(0, 200_000, 1)]
    block = np.random.default_rng(1).integers(0, 50_000, 40_000)
    assert (0, 200_000, 40_000) in P.find_runs(np.tile(block, 5), 200_000)
    assert looped(None, 5) is None
