"""Resharding against its laws, top-k against all pairs."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gainsieve.llm import topk
from gainsieve.llm.resharding import equal_capacities, minimum_cost_flow, reshard, rewrite


def cheapest(supply, demand, cost):
    best = {tuple(demand): 0}
    for i, s in enumerate(supply):
        after = {}
        for left, paid in best.items():
            for parts in itertools.product(*(range(min(s, x) + 1) for x in left)):
                if sum(parts) == s:
                    state = tuple(x - p for x, p in zip(left, parts))
                    total = paid + sum(p * cost(i, j) for j, p in enumerate(parts))
                    after[state] = min(after.get(state, 10**9), total)
        best = after
    return best[tuple([0] * len(demand))]


def test_flow_is_cheapest():
    dice = random.Random(1)
    for _ in range(60):
        supply = [dice.randint(0, 6) for _ in range(3)]
        demand = equal_capacities(sum(supply), dice.randint(1, 4))
        prices = [[dice.randint(0, 5) for _ in demand] for _ in supply]
        cost = lambda i, j: prices[i][j]
        flow = minimum_cost_flow(supply, demand, cost)
        assert [sum(f) for f in flow] == supply and [sum(c) for c in zip(*flow)] == demand
        assert sum(f * cost(i, j) for i, r in enumerate(flow) for j, f in enumerate(r)) == cheapest(supply, demand, cost)


def test_reshard(spark, frame, documents, tmp_path):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    old = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.pmod("doc_id", F.lit(5)))
    placed = reshard(frame, "doc_id", size, old, 5, 4, {"crc": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))})
    rows = placed.collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((k, len((t or "").encode()) + 1) for k, t in documents)
    shards, held = defaultdict(list), defaultdict(int)
    for r in rows:
        shards[r["shard"]].append(r)
        held[r["old_shard"]] += r["size"]
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for members in shards.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / 4) <= 3 * most
    moved = sum(r["size"] for r in rows if r["shard"] != r["old_shard"])
    assert abs(moved - sum(max(0, h - (total // 4 if i < 4 else 0)) for i, h in held.items())) <= 4 * most
    assert reshard(frame.limit(0), "doc_id", size, old, 5, 4).count() == 0
    unique = frame.dropDuplicates(["doc_id"])
    still = F.pmod("doc_id", F.lit(2)).cast("int")
    placed = reshard(unique.where("doc_id < 100 AND doc_id % 3 <> 9"), "doc_id", F.lit(1), F.when(F.col("doc_id") < 25, 0).when(F.col("doc_id") < 60, 1).otherwise(2), 3, 3)
    touched = rewrite(unique, placed, "doc_id", str(tmp_path / "new"))
    written = spark.read.parquet(str(tmp_path / "new"))
    expected = placed.where(F.col("shard").isin(touched))
    assert sorted(map(tuple, written.select("doc_id", "shard").collect())) == sorted(map(tuple, expected.select("doc_id", "shard").collect()))
    assert rewrite(unique, reshard(unique.where("doc_id < 100"), "doc_id", F.lit(1), still, 2, 2), "doc_id", str(tmp_path / "same")) == []


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SAMPLE", 32)
    dice = np.random.default_rng(block)
    vectors = [(i, dice.normal(size=6).round(1).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[3][1]) for i in range(30)] + [vectors[0]] + [(300, [1.0, 2.0]), (350, [2.0, 2.0]), (400, [5.0, 1.0])]
    odd = [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [1.0] * 6)]
    vectors += [(450, [3e6] + [1.0] * 5), (451, [-2e6, 5e6] + [0.1] * 4), (50, vectors[9][1]), vectors[50]]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("id", F.lit("x"))
    got = topk.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    expected = []
    for at, (q, mine) in enumerate(whole):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for j, (i, v) in enumerate(whole) if j != at and len(v) == len(mine))
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0


def test_top_k_beyond_the_range(spark):
    df = lambda x: spark.createDataFrame([(0, [x, 1.0]), (1, [x, 2.0])], "vec_id long, embedding array<double>")
    for x in (1e300, 1e16):  # no whole number of 64 bits; a score beyond 64 bits
        with pytest.raises(Exception, match="62 bits|64 bits"):
            topk.top_k(df(x), "vec_id", "embedding", F.col("id") == 0).collect()
    assert topk.top_k(df(5e6), "vec_id", "embedding", F.col("id") == 0).first()["score"] == (256 * 5_000_000) ** 2 + 256 * 512


def test_rows_without_an_old_shard(spark, tmp_path):
    rows = [(i, i if i < 6 else None if i < 10 else 77, "x") for i in range(20)] + [(None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, home int, old_shard string").withColumn("slot", F.lit("mine"))
    placed = reshard(df, "doc_id", F.lit(1), F.col("home"), 4, 3)
    got = placed.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((k is None, k) for k, _, _ in rows)
    assert all(r["old_shard"] == (h if h is not None and 0 <= h < 4 else None) for r in got for k, h, _ in rows if k == r["doc_id"])
    assert sorted(sum(r["shard"] == s for r in got) for s in range(3)) == [7, 7, 7]
    touched = rewrite(df, placed, "doc_id", str(tmp_path / "new"))
    written = spark.read.parquet(str(tmp_path / "new"))
    assert touched == [0, 1, 2, 3] and written.count() == 21 and set(written.columns) == {"doc_id", "home", "old_shard", "slot", "shard"}
    assert {r[0] for r in written.select("old_shard").collect()} == {"x"}


def test_a_block_answers_all_queries_together(monkeypatch):
    """Queries share the products with a chunk of candidates, and a chunk is scored only where its bound reaches a query's k-th score."""
    dice = np.random.default_rng(4)
    x = dice.integers(-40, 40, (4000, 8)) + 3000 * np.repeat(np.eye(8, dtype=np.int64), 500, axis=0)
    bound = float((x.astype(float) ** 2).sum(axis=1).max())
    pivots = topk.choose_pivots(x[::7], bound)
    far = topk._distances(topk._augmented(x, bound), pivots)
    merges = []
    k_best = topk._k_best
    monkeypatch.setattr(topk, "_k_best", lambda *given: merges.append(1) or k_best(*given))
    asked = np.arange(0, 4000, 8)
    ids, rows = np.arange(4000) % 1300, np.arange(4000)
    owner, score, near = topk.search_block(x[asked], rows[asked], far[asked], ids, rows, x, far, bound, 3, np.full(len(asked), np.iinfo(np.int64).min))
    assert len(merges) <= 4000 // topk._CHUNK + 1
    found = {q: [(s, n) for o, s, n in zip(owner, score, ids[near], strict=True) if o == q] for q in range(len(asked))}
    for q, row in enumerate(asked.tolist()):
        assert found[q] == [(-s, i) for s, i in sorted((-int(x[row] @ x[other]), int(ids[other])) for other in range(4000) if other != row)[:3]]
