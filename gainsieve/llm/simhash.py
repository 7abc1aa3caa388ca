"""SimHash near-duplicates with BK-trees.

Every text gets a 64-bit fingerprint. Different fingerprints are dealt to shards so that any
two within the radius share one: with ``radius + 2`` blocks of bits at least two blocks are
equal, so there is a shard for each pair of blocks and their value. A large shard is split
into parts of bounded size, each a BK-tree that is sent to the other parts of its shard. The
trees are searched along the edges within the radius only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gainsieve.llm.components import connected_components, stars
from gainsieve.session import materialise

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Most fingerprints of a tree, on average; larger shards are split.
PART = 1024
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of the ``shingle``-word runs of ``text``, A-Z in lower case; 0 without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(stops), _CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=False)]
        total += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(stops)).tobytes(), "big")


class BKTree:
    """Fingerprints in a tree whose children are keyed by their distance to the parent."""

    def __init__(self, values: Iterable[int] = ()):
        self.root: tuple[int, dict] | None = None
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while distance := (node[0] ^ value).bit_count():
            if distance not in node[1]:
                node[1][distance] = (value, {})
                return
            node = node[1][distance]

    def near(self, value: int, radius: int) -> list[int]:
        """All members within ``radius`` of ``value``."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            member, children = open_nodes.pop()
            distance = (member ^ value).bit_count()
            if distance <= radius:
                found.append(member)
            for d in range(distance - radius, distance + radius + 1):
                if d in children:
                    open_nodes.append(children[d])
        return found


def shard_links(first: list[int], second: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that join what lies within ``radius``: inside ``first``, or between it and ``second``."""
    tree = BKTree()
    links = []
    for value in first:
        if second is None:
            links += [(value, other) for other in tree.near(value, radius)]
        tree.add(value)
    for value in second or ():
        links += [(value, other) for other in tree.near(value, radius)]
    return stars(links)


def fingerprints(df: DataFrame, key: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``k, fp`` for every row: the key and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["k", "fp"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, fp long")


def _masks(radius: int) -> list[int]:
    """Masks of all pairs of ``radius + 2`` blocks, as signed longs."""
    edges = [BITS * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in (a | b for a, b in combinations(blocks, 2))]


def near_links(values: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Edges ``a, b`` that connect the different fingerprints (``fp``) within ``radius`` of each other.

    Not every such pair is an edge, but each is connected by edges inside one shard.
    """
    shard = ["mask", "value"]
    dealt = values.select("fp", F.explode(F.array(*(F.lit(m) for m in _masks(radius)))).alias("mask"))
    dealt = dealt.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    sizes = dealt.groupBy(*shard).agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    dealt = dealt.join(sizes, shard).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    trees = dealt.groupBy(*shard, "parts", "part").agg(F.sort_array(F.collect_list("fp")).alias("members"))
    whole = trees.where("parts = 1").select(F.col("members").alias("first"), F.lit(None).cast("array<bigint>").alias("second"))
    split = trees.where("parts > 1").withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    split = split.groupBy(*shard, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).agg(F.collect_list("members").alias("m"))
    split = split.where("lo = hi OR size(m) = 2").select(F.col("m")[0].alias("first"), F.when(F.col("lo") != F.col("hi"), F.get("m", F.lit(1))).alias("second"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (1 << BITS) - 1
        for batch in batches:
            links = []
            for first, second in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                links += shard_links([x & whole for x in first], second and [x & whole for x in second], radius)
            ends = [pa.array(np.array([e[i] for e in links], np.uint64).astype(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return whole.unionByName(split).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str, text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``key, fingerprint, component_id`` for every row.

    ``fingerprint`` has 16 hexadecimal digits; ``component_id`` is the smallest key that can
    be reached over links of at most ``radius`` differing bits. Null, empty and blank texts
    have fingerprint 0 and link like any other. Repeated rows each come back; an empty table
    gives none. Equal fingerprints are one member, so copies make no pairs.
    """
    found = materialise(fingerprints(df, key, text, shingle))
    values = materialise(found.groupBy("fp").agg(F.min("k").alias("least")))
    components = connected_components(near_links(values.select("fp"), radius))
    named = values.join(components, values["fp"] == components["node"], "left")
    named = materialise(named.select("fp", "least", F.coalesce("component", "fp").alias("root")))
    # Stored, so that both sides of the join are dealt for it and a large component can be split.
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = named.join(least, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(named, "fp").select(F.col("k").alias(key), digits.alias("fingerprint"), "component_id")
