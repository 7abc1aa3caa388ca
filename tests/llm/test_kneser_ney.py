"""The language model against plain counting."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gainsieve.llm import kneser_ney, words
from gainsieve.llm.common import fold_of


def plain_tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*lowered.encode().split(), 0]


def test_hashes_tell_words_apart(documents, monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 700)
    texts = [t for _, t in documents]
    seen = {}
    for start in (0, 3):
        column = pa.array(texts, pa.string())[start:]
        for row, hashes in words.word_hashes(column):
            plain = plain_tokens(texts[row + start])[:-1]
            assert len(hashes) == len(plain)
            for h, w in zip(hashes.tolist(), plain):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def plain_model(texts, order=2):
    """Token counts, and the probability of a word after a tuple of words, by the recursion over orders."""
    counts, tokens = [Counter() for _ in range(order)], Counter()
    for t in texts:
        ts = plain_tokens(t)
        tokens.update(ts)
        padded = [None] * (order - 1) + ts
        counts[-1].update(tuple(padded[i : i + order]) for i in range(len(ts)))
    for m in range(order - 1, 0, -1):
        counts[m - 1] = Counter(g[1:] for g in counts[m])
    d = [kneser_ney.discounts([sum(n == i for n in c.values()) for i in range(1, 5)]) for c in counts]
    total = [Counter() for _ in range(order)]
    follow = [Counter() for _ in range(order)]
    for m, c in enumerate(counts):
        for g, n in c.items():
            total[m][g[:-1]] += n
            follow[m][g[:-1]] += d[m][min(n, 3) - 1]

    def probability(before, w):
        if not before:
            n = counts[0][w,]
            whole = sum(counts[0].values())
            return (n - d[0][min(n, 3) - 1] if n else 0) / whole + follow[0][()] / whole / (len(tokens) + 1)
        m, before = len(before), tuple(before)
        shorter = probability(before[1:], w)
        if not total[m][before]:
            return shorter
        n = counts[m][(*before, w)]
        return (n - d[m][min(n, 3) - 1] if n else 0) / total[m][before] + follow[m][before] / total[m][before] * shorter

    return tokens, probability


def plain_score(probability, text, order):
    ts = plain_tokens(text)
    padded = [None] * (order - 1) + ts
    return sum(math.log10(probability(padded[i : i + order - 1], w)) for i, w in enumerate(ts))


@pytest.mark.parametrize(("bucket_bytes", "order"), [(1 << 14, 2), (1 << 30, 2), (1 << 14, 3), (1 << 30, 4)])
def test_model(spark, frame, documents, bucket_bytes, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", bucket_bytes)
    held = {r["doc_id"] for r in frame.where(fold_of("doc_id", 7) == 2).select("doc_id").collect()}
    tokens, probability = plain_model([t for k, t in documents if k not in held], order)
    model = kneser_ney.train(frame.where(fold_of("doc_id", 7) != 2), order=order)
    assert (model.tokens, model.vocabulary) == (sum(tokens.values()), len(tokens))
    for before in ([], [b"the"], [b"of", b"the"], [None, None])[:order]:
        assert sum(probability(before, w) for w in [*tokens, "new"]) == pytest.approx(1)
    got = sorted(tuple(r) for r in kneser_ney.score(frame, model, "doc_id").collect())
    expected = []
    for key, text in documents:
        ts = plain_tokens(text)
        base = sum(math.log10((tokens[t] + 1) / (sum(tokens.values()) + len(tokens) + 1)) for t in ts)
        expected.append((key, len(ts), sum(tokens[t] > 0 for t in ts), base, plain_score(probability, text, order)))
    for a, b in zip(got, sorted(expected), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])


@pytest.mark.parametrize("order", [2, 3])
def test_large_counts(spark, documents, order):
    texts = ["a b"] * 700 + ["b a c"] * 2 + [t for _, t in documents[:20]]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=order)
    _, probability = plain_model(texts, order)
    rows = kneser_ney.score(spark.createDataFrame([(1, "a b"), (2, "zz a")], "k long, text string"), model, "k").collect()
    assert {r["k"]: r["score"] for r in rows} == pytest.approx({1: plain_score(probability, "a b", order), 2: plain_score(probability, "zz a", order)})
    empty = kneser_ney.train(spark.createDataFrame([], "text string"), order=order)
    assert kneser_ney.score(spark.createDataFrame([(1, "a")], "k long, text string"), empty, "k").first()["score"] == 0
    assert kneser_ney.score(spark.createDataFrame([], "k long, text string"), model, "k").count() == 0


@pytest.mark.parametrize("words", [1, 2, 3])
def test_packing(words):
    dice = np.random.default_rng(1)
    tokens = [dice.integers(0, 9 if i < words - 1 else 1 << 56, 500).astype(np.uint64) for i in range(words)]
    got = kneser_ney._unpack_grams(kneser_ney._pack_grams(tokens, [np.arange(500), np.arange(500) * 7]), words, 2)
    assert Counter(zip(*(x.tolist() for x in got))) == Counter(zip(*(t.tolist() for t in tokens), range(500), range(0, 3500, 7)))


def test_shared_folder():
    with pytest.raises(ValueError):
        kneser_ney._shared("hdfs://host/x")
    assert kneser_ney._shared("file:///a/b") == kneser_ney._shared("file:/a/b") == "/a/b"
    with pytest.raises(ValueError, match="order"):
        kneser_ney.train(None, order=1)


@pytest.fixture(scope="module")
def babble():
    dice = random.Random(7)
    texts = [" ".join(f"w{min(int(dice.expovariate(0.1)), 40)}" for _ in range(dice.randrange(30))) for _ in range(60)]
    return [*texts, "", None, "w1 w2 w3 w1 w2 w3", *["w5 w6"] * 20]


@pytest.mark.parametrize(("key_bits", "order"), [(64, 3), (8, 2), (8, 3), (8, 4)])
def test_keys_that_do_not_tell_the_pair(spark, babble, key_bits, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "KEY_BITS", key_bits)
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", 1 << 10)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in babble], "text string"), order=order)
    assert [level.exact for level in model.levels[1:]] == [key_bits == 64] * (order - 1)
    _, probability = plain_model(babble, order)
    asked = dict(enumerate([*babble, "w1 unseen w2", "unseen", "w40 w39 w38 w0"]))
    rows = kneser_ney.score(spark.createDataFrame(list(asked.items()), "k long, text string"), model, "k").collect()
    assert {r["k"]: r["score"] for r in rows} == pytest.approx({k: plain_score(probability, t, order) for k, t in asked.items()})


def test_a_bucket_of_contexts_alone_passes_on_what_was_seen(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", 1)
    texts = ["a", "b", "a c", "d"]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    _, probability = plain_model(texts, 3)
    rows = kneser_ney.score(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), model, "k").collect()
    assert {r["k"]: r["score"] for r in rows} == pytest.approx({k: plain_score(probability, t, 3) for k, t in enumerate(texts)})


def test_arrays_take_few_bytes(spark):
    dice = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in dice.integers(0, 3000, 1000)) for _ in range(40)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    size = sum(f.stat().st_size for f in Path(model.folder).iterdir())
    assert size < 14 * model.tokens  # of 24 when hashes were kept whole


def test_shuffled_counts_take_few_bytes():
    level = kneser_ney.Level(3, bound=1 << 20)
    dice = np.random.default_rng(4)
    u, v = (dice.integers(0, 1 << 20, 200_000).astype(np.uint64) for _ in range(2))
    keys, counts = kneser_ney._times(level.keys(u, v), [], True)
    blob = kneser_ney._pack_rows(level, keys, counts)
    assert len(blob) < 4.5 * len(keys)
    back, sums, _ = kneser_ney._added(level, [blob, blob])
    assert (back == keys).all() and (sums == 2 * counts[0]).all()
    assert set(zip(*(x.tolist() for x in level.pairs(back)))) == set(zip(u.tolist(), v.tolist()))


@pytest.mark.parametrize("bits", [1, 2, 7, 41, 63, 64])
def test_spread_is_a_bijection(bits):
    x = np.arange(1 << min(bits, 12), dtype=np.uint64) * np.uint64(max(1, (1 << bits) // 4096))
    there = kneser_ney.spread(x, bits)
    assert len(np.unique(there)) == len(x) and int(there.max()) < 1 << bits
    assert (kneser_ney.gathered(there, bits) == x).all()


@pytest.mark.parametrize(("rows", "bits"), [(0, 40), (1, 56), (5, 64), (3000, 12), (70_000, 35)])
def test_grams_of_a_bucket(tmp_path, rows, bits):
    dice = np.random.default_rng(rows)
    keys = np.unique(dice.integers(0, 1 << bits, rows, np.uint64, False) if bits < 64 else dice.integers(0, 1 << 64, rows, np.uint64))
    counts = dice.choice([1, 2, 14, 15, 16, 1 << 40], len(keys))
    kneser_ney.Grams.write(f"{tmp_path}/g", keys, bits, counts, [])
    grams = kneser_ney.Grams(f"{tmp_path}/g", bits, True)
    assert (grams.keys() == keys).all()
    asked = np.append(keys[::-1], dice.integers(0, 1 << min(bits, 63), 500).astype(np.uint64))
    at, hit = grams.find(asked)
    known = dict(zip(keys.tolist(), zip(range(len(keys)), counts.tolist())))
    assert hit.tolist() == [k in known for k in asked.tolist()]
    assert list(zip(at[hit].tolist(), grams.counts(at[hit]).tolist())) == [known[k] for k in asked[hit].tolist()]


def test_facts_of_a_bucket(tmp_path):
    dice = np.random.default_rng(5)
    values = [dice.choice([0, 1, 2, 7, 4095, 4096, 1 << 40], 5000) for _ in range(kneser_ney.KNOWN)]
    kneser_ney.Facts.write(f"{tmp_path}/f", values)
    places = dice.integers(0, 5000, 9000)
    for got, expected in zip(kneser_ney.Facts(f"{tmp_path}/f").at(places), values, strict=True):
        assert (got == expected[places]).all()
