"""Tokens: byte-level BPE, longest match, packing."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from gainsieve.llm import bpe, packing
from gainsieve.llm.pieces import json_tokenizer, rank_encoding, token_bytes
from gainsieve.llm.token_counts import LongestMatch, token_counts


def test_halves_give_the_whole_encoding(documents):
    whole = rank_encoding(bpe.RANKS)
    dice = random.Random(5)
    texts = [t or "" for _, t in documents] + ["".join(dice.choices("ab' \n!1é　😀sretl", k=dice.randint(0, 120))) for _ in range(400)]
    for text in texts:
        expected = whole.encode_ordinary(text)
        for leaf in (3, 50) if len(text) < 3000 else (100,):
            ids = bpe.encode(text, leaf=leaf)
            assert ids.tolist() == expected
            assert bpe.decode(ids, leaf=7) == text.encode()


def test_round_trip_rows(spark, frame, documents):
    got = Counter(tuple(r) for r in bpe.round_trip(frame, "doc_id").collect())
    expected = Counter()
    for key, text in documents:
        ids = rank_encoding(bpe.RANKS).encode_ordinary(text or "")
        expected[key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == expected
    assert bpe.round_trip(frame.limit(0), "doc_id").count() == 0
    assert bpe.encode_table(frame.where("doc_id = 1003"), "doc_id").first()["ids"] == rank_encoding(bpe.RANKS).encode_ordinary("a")


def greedy(tokens, word):
    n = 0
    while word:
        end = next(e for e in range(len(word), 0, -1) if word[:e] in tokens)
        word, n = word[end:], n + 1
    return n


def test_longest_match(documents):
    dice = random.Random(1)
    tokens = {bytes([c]) for c in b" abc"} | {bytes(dice.choices(b"abc", k=dice.randint(2, 6))) for _ in range(40)} | {b" " + bytes(dice.choices(b"abc", k=3)) for _ in range(9)}
    small = LongestMatch(tokens)
    for _ in range(2000):
        word = bytes(dice.choices(b"abc", k=dice.randint(1, 20)))
        assert small[word] == greedy(tokens, b" " + word)
    with pytest.raises(ValueError):
        small[b"abz"]


def test_token_counts(spark, frame, documents):
    tokens = set(token_bytes(packing.RANKS))
    got = Counter(tuple(r) for r in token_counts(frame, "doc_id").collect())
    expected = Counter()
    for key, text in documents:
        each = [greedy(tokens, b" " + w) for w in (text or "").encode().split()]
        expected[key, len(each), sum(each), max(each, default=0)] += 1
    assert got == expected


def check_packed(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, frame, documents):
    rows = packing.pack_documents(frame, "doc_id", capacity=256).collect()
    tokenizer = json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for key, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        for piece, start in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[start : first if not piece else start + 256]
            expected[key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    used = check_packed(rows, 256)
    assert used <= 1.05 * sum(r["length"] for r in rows) / 256 + 2
    assert packing.pack_documents(frame.limit(0), "doc_id").count() == 0


def test_plan_covers_counts():
    dice = random.Random(2)
    for _ in range(200):
        capacity = dice.choice([7, 64, 300])
        counts = {dice.randint(1, capacity): dice.choice([1, 5, 1000, 10**9]) for _ in range(dice.randint(0, 40))}
        slots = packing.best_fit_plan(counts, capacity)
        ranks = defaultdict(list)
        for length, lo, hi, *_ in slots:
            ranks[length].append((lo, hi))
        for length, spans in ranks.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == counts[length] - 1
            assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
        if sum(counts.values()) < 20_000:
            rows = [
                {"sequence_id": first + (r - lo) // per, "offset": at + (r - lo) % per * length, "length": length}
                for length, lo, hi, per, first, at in slots
                for r in range(lo, hi + 1)
            ]
            check_packed(rows, capacity)


def test_added_tokens_inside_texts(spark):
    """The ids of the JSON tokenizer as it loads, which reads its added token inside a text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    dice = random.Random(3)
    texts = [f"a {end} b", end, end * 3, f"\n{end}\n", f"x  {end}  y", "<|endoftext|", "<|<|endoftext|>|>", "<|ENDOFTEXT|>", "plain", ""]
    texts += ["".join(dice.choices([end, " ", "a", "\n", "<|", "é", "12"], k=30)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in packing.token_pieces(df, "doc_id", with_ids=True).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, packing.SEPARATOR_ID] for i, t in enumerate(texts)}
    assert got[0] == [64, 220, 50256, 275, packing.SEPARATOR_ID]
