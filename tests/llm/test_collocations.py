"""Collocations against counting in plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gainsieve.llm import collocations as C


def plain(rows, longest, least, best):
    """``(lang, rank, phrase, a, l, r, n, score)`` by the definition."""
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            words[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        rows = []
        for p, a in found.items():
            if 100 * inside[p] >= 100 * a:
                continue
            n = words[lang]
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        for rank, (score, a, p, left, right, n) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


ODD = [(None, "en"), ("", "en"), (" \t\n", None), ("Ä Ä Ä ß é. ä Ä Ä", None), ("x y, X Y; x\ty z\x0bx y", "und"), ("a" * 5000 + " b", "de"), ("a b a b a b a b c " * 40, "de"), ("no\xa0blank no\xa0blank", "fr")]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").collect()]
    return rows + ODD + rows[:5]


@pytest.mark.parametrize(("least", "best", "held"), [(4, 50, 3000), (12, 2000, C.HELD)])
def test_equals_plain_counting(spark, texts, monkeypatch, least, best, held):
    df = spark.createDataFrame(texts, "text string, lang string").repartition(4)
    df = df.withColumns({c: F.lit(1) for c in ("fp", "row", "n", "a", "rank", "phrase", "size")})
    got = sorted(tuple(r) for r in C.collocations(df, least=least, best=best, held_runs=held).collect())
    assert got == plain(texts, 5, least, best)
    assert C.collocations(df.limit(0)).count() == 0


def test_collisions_of_fingerprints_stay_apart(spark, texts, monkeypatch):
    """With fingerprints of 6 bits nearly all collide; the second hash tells them apart."""
    whole = C.fingerprints
    monkeypatch.setattr(C, "fingerprints", lambda *a: (lambda f, s: (f & np.uint64(63 << 58), s))(*whole(*a)))
    batch = [np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64), np.array([7, 8, 3, 4], np.uint64)]
    assert sorted(map(tuple, zip(*(c.to_pylist() for c in C._counted([tuple(batch)], True).columns)))) == [(5, 1, 2, 3), (5, 2, 1, 8), (9, 1, 1, 4)]


def test_long_texts_in_parts(monkeypatch):
    """Parts of a long text give the words, places and sentences of the whole."""
    text = "One two, three. four " * 50 + "x" * 300 + " end"
    whole = list(C.tokenised(pa.array([text])))
    C._powers.cache_clear()
    monkeypatch.setattr(C, "CHUNK", 64)
    parts = list(C.tokenised(pa.array([text])))
    C._powers.cache_clear()
    for a, b in zip(whole[0][:4], parts[0][:4], strict=True):
        assert (a == b).all()
    assert ((whole[0][4][1:] == whole[0][4][:-1]) == (parts[0][4][1:] == parts[0][4][:-1])).all()
    assert len(whole[0][0]) == 202


def test_score_does_not_overflow(spark):
    big = 3_000_000_007
    row = spark.createDataFrame([(big, 10**14, big, big + 5)], "a long, n long, l long, r long")
    assert row.select(C._score("a", "n", "l", "r")).first()[0] == 1000 * big * 10**14 // (big * (big + 5))
