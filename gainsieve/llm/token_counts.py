"""Greedy longest-match token counts in one pass over the bytes of a word.

The vocabulary is a trie. Every node has a failure link, the node to go on from when no
child fits, and the number of tokens that are complete when it is followed. A word is
walked once, and its count is the sum of these numbers; no piece of it is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gainsieve.llm.pieces import token_bytes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Words whose counts a worker holds; it starts over when it has that many.
CACHED_WORDS = 200_000


class LongestMatch(dict):
    """Token counts of words; as a dict it holds the counts of words met lately.

    ``vocabulary`` must hold every single byte that can occur, so each word has a division.
    """

    def __init__(self, vocabulary: Iterable[bytes], prefix: bytes = b" "):
        super().__init__()
        self.prefix = prefix
        self.children: list[dict[int, int]] = [{}]
        ends: set[int] = set()
        for token in vocabulary:
            node = 0
            for byte in token:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                node = self.children[node][byte]
            ends.add(node)
        ends.discard(0)
        self.link = [-1] * len(self.children)  # -1: no way on
        self.popped = [0] * len(self.children)
        level = [0]
        while level:
            for node in level:
                for byte, child in self.children[node].items():
                    if child in ends:
                        self.link[child], self.popped[child] = 0, 1
                        continue
                    count, at = self.popped[node], self.link[node]
                    while at >= 0 and byte not in self.children[at]:
                        count, at = count + self.popped[at], self.link[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = self.children[at][byte], count
            level = [child for node in level for child in self.children[node].values()]

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        children, link, popped = self.children, self.link, self.popped
        node = count = 0
        for byte in self.prefix + word:
            while byte not in children[node]:
                count += popped[node]
                node = link[node]
                if node < 0 or not node and byte not in children[0]:
                    raise ValueError(f"byte {byte} is not in the vocabulary")
            node = children[node][byte]
        while node:
            if link[node] < 0:
                raise ValueError("the end of a word cannot be divided")
            count += popped[node]
            node = link[node]
        self[word] = count
        return count


@cache
def matcher(ranks: str) -> LongestMatch:
    return LongestMatch(token_bytes(ranks))


def token_counts(df: DataFrame, key: str, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``key, n_words, n_tokens, longest_word_tokens`` for every row.

    Words are runs of anything but ASCII white space; the pieces of a word are those of the
    word behind a blank. A null, empty or blank text has 0 of each. Keys may be null, repeated rows
    stay, other columns play no part, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = matcher(ranks).__getitem__
        for batch in batches:
            words, tokens, most = [], [], []
            for t in batch.column(1).to_pylist():
                each = list(map(count, (t or "").encode().split()))
                words.append(len(each))
                tokens.append(sum(each))
                most.append(max(each, default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, most))], names=["k", "w", "n", "m"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    out = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, w long, n long, m long")
    return out.toDF(key, "n_words", "n_tokens", "longest_word_tokens")
