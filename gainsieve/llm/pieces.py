"""Byte-level BPE with the public vocabularies."""

from __future__ import annotations

import base64
import json
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken


@cache
def rank_encoding(path: str, added: str | None = None) -> tiktoken.Encoding:
    """The encoding of a file of ranks, one per worker process; ``added`` is a JSON file whose added tokens it knows as special ones."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(added) if added else {})


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a JSON tokenizer, which it reads inside a text before anything else."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{path}: added tokens that take in what stands beside them are not supported")
    return {t["content"]: t["id"] for t in tokens}


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id."""
    encoding = rank_encoding(path)
    return [encoding.decode_single_token_bytes(i) for i in range(encoding.n_vocab)]


@cache
def token_lengths(path: str) -> np.ndarray:
    return np.array([len(b) for b in token_bytes(path)], dtype=np.int64)


@cache
def json_tokenizer(path: str):
    """The tokenizer of a JSON file; strings of special tokens are ordinary text to it."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer
