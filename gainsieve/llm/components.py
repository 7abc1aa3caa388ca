"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from gainsieve.session import materialise


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), *(F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(38,0)")) for i in (0, 1))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``edges`` (``a, b`` long); a component is its smallest node.

    Each round links every node to the smallest neighbour it knows, first from the side of
    larger, then of smaller nodes; the rounds grow with the logarithm of the longest path.
    Rounds are written to the shared folder, so no plan grows and a lost executor costs its
    tasks only. Nodes with many links are one key of a join whose other side is unique.
    """
    directed = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = materialise(directed)
    seen = None
    while (digest := _digest(current)) != seen:
        seen = digest
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(least, "u").select(pairs.alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        current = materialise(small)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def stars(links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links from every member of a group to its least; the same groups as ``links`` make."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]
