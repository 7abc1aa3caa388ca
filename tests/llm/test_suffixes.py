"""Repeated windows against all windows in a set."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gainsieve.llm import suffixes


def plain(rows, window):
    first, out = {}, Counter()
    texts = [(k, (t or "").encode()) for k, t in rows]
    for k, t in texts:
        for s in range(len(t) - window + 1):
            w, at = t[s : s + window], (-1 if k is None else k, s)
            first[w] = min(first.get(w, at), at)
    for k, t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - window + 1):
            if first[t[s : s + window]] < (-1 if k is None else k, s):
                gone[s : s + window] = [True] * window
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out[k, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)] += 1
    return out


def made(seed):
    dice = random.Random(seed)
    letters = "abcdefgh é"
    text = lambda n: "".join(dice.choices(letters, k=n))
    passages = [text(dice.randint(10, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        rows.append((i, "".join(dice.choice(passages) if dice.random() < 0.5 else text(dice.randint(0, 40)) for _ in range(dice.randint(0, 8)))))
    rows += [(70 + i, rows[i][1]) for i in range(5)] + [(80, "a" * 300), (81, "ab" * 200), (82, None), (83, ""), (None, rows[9][1])]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_small(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", [150, 400, 1 << 18][seed])
    monkeypatch.setattr(suffixes, "HELD_RUNS", [20, 1000, 1000][seed])
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BUCKET_WINDOWS", 500)
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("doc", F.lit(1)).withColumn("n", F.lit(1))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(df, "doc_id", window=30, digit=12).collect())
    assert got == plain(rows, 30)


def test_documents(spark, frame, documents):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(frame, "doc_id").collect())
    assert got == plain(documents, 100)
    assert suffixes.remove_repeats(frame.limit(0), "doc_id").count() == 0


def test_least_over():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for width in range(1, 20):
        assert suffixes.least_over(x, width).tolist() == [min(x[i : i + width]) for i in range(50 - width + 1)]


@pytest.mark.parametrize("key", [None, 7])
def test_texts_under_one_key(spark, key):
    """Every text keeps what only it holds, and its spans stay within it."""
    dice = random.Random(5)
    text = lambda n: "".join(dice.choices("abcdefgh ", k=n))
    shared, again = text(60), text(40)
    rows = [(key, text(20) + shared + text(50)), (key, text(300) + again + again), (key, text(35)), (key, ""), (3, text(90) + shared), (9, again + text(10))]
    rows += [(key, shared + text(9)), (key, shared + text(9)), rows[1], (8, shared + text(70)), (None, text(50) + again), (None, again)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 6):
        got = suffixes.remove_repeats(df.repartition(parts), "doc_id", window=30, digit=12).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == plain(rows, 30)


def test_footer_in_every_document(spark, monkeypatch):
    """A passage that all documents share, between texts of their own: no group holds a run of each, nothing is missed."""
    dice = random.Random(8)
    footer = "All rights reserved by the owners of this fine page, 2024-2025!!"
    text = lambda: "".join(dice.choice("abcdefghij ") for _ in range(dice.randint(150, 400)))
    texts = [(i, text() + footer + text()) for i in range(600)] + [(1000 + i, "x" * 40 + footer + "y" * 40) for i in range(5)]
    docs = spark.createDataFrame(texts, "doc long, t string").selectExpr("doc", "0L AS row", "CAST(t AS BINARY) AS t").repartition(3)
    sent = suffixes._runs_of_rows(docs, 0, 100, 32)
    digits = Counter()
    for r in sent.where("bucket >= 0").collect():
        digits.update(suffixes.unpack(bytes(r["data"]), 6)[0].tolist())
    assert max(digits.values()) <= 3 * suffixes.MOST_RUNS
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    expected = Counter()
    for (k, *counts, kept), n in plain(texts, 100).items():
        expected[(k, *counts, kept)] += n
    got = Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in suffixes.remove_repeats(frame, "doc_id").collect())
    assert got == expected
    monkeypatch.setattr(suffixes, "MOST_RUNS", 10**9)
    assert Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in suffixes.remove_repeats(frame, "doc_id").collect()) == expected
