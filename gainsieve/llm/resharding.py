"""Resharding by minimum-cost flow.

Old shards supply their bytes, new shards demand theirs, and moving a byte costs something
between any two shards. The flow that costs least says how many bytes each old shard sends
where. Rows of an old shard, in one fixed order, are cut at these amounts; then only the
shards that lose or gain rows are written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from gainsieve.llm.common import others, running_starts
from gainsieve.session import materialise

#: Rows of an old shard are ordered in this many buckets at most, and about so many rows each.
MOST_BUCKETS, BUCKET_ROWS = 4096, 256


def moving_costs(old: int, new: int) -> int:
    """What moving a byte costs: nothing if it stays."""
    return int(old != new)


def minimum_cost_flow(supply: list[int], demand: list[int], cost: Callable[[int, int], int] = moving_costs) -> list[list[int]]:
    """``flow[i][j]`` from supplies to demands of the same total, of least cost.

    Cheapest augmenting paths over the residual graph of both sides; amounts are whole.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, wanted = list(supply), list(demand)
    while any(left):
        dist: list[float] = [0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        before: list[int] = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    c = cost(i, j)
                    if dist[i] + c < dist[n + j]:
                        dist[n + j], before[n + j], changed = dist[i] + c, i, True
                    if flow[i][j] and dist[n + j] - c < dist[i]:
                        dist[i], before[i], changed = dist[n + j] - c, n + j, True
        end = min((j for j in range(m) if wanted[j]), key=lambda j: dist[n + j])
        path, at = [], n + end
        while before[at] >= 0:
            path.append((before[at], at))
            at = before[at]
        amount = min([left[at], wanted[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        wanted[end] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def reshard(df: DataFrame, key: str, size: Column, old: Column, n_old: int, n_new: int, carried: dict[str, Column] | None = None, cost: Callable[[int, int], int] = moving_costs) -> DataFrame:
    """``key, size, old_shard, shard, slot`` and the ``carried`` columns for every row.

    ``old`` names the present shard, 0 to ``n_old`` - 1; new shards get equal bytes, up to
    half a row at each cut. Slots count from 0 in each shard without a gap. A row whose old shard is
    null or none of these is in no shard yet: it has a null ``old_shard`` and is moved to where there
    is room. Keys may be null, repeated rows each get a place; an empty table gives none.

    The driver sees sums per old shard. Rows are ordered in buckets of an old shard, which
    also splits a shard that holds most rows, and the plan has a row for each transfer.
    """
    names = {f"c{i}": c for i, c in enumerate((carried or {}).values())}
    known = F.coalesce(old.cast("int").between(0, n_old - 1), F.lit(False))
    rows = df.select(F.col(f"`{key}`").alias("k"), size.cast("long").alias("size"), F.when(known, old.cast("int")).otherwise(n_old).alias("old"), *(c.alias(n) for n, c in names.items()))
    rows = materialise(rows)
    sums = {r["old"]: (r["s"], r["n"]) for r in rows.groupBy("old").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    supply = [sums.get(i, (0, 0))[0] for i in range(n_old + 1)]
    price = lambda i, j: cost(i, j) if i < n_old else 1
    flow = minimum_cost_flow(supply, equal_capacities(sum(supply), n_new), price)
    cuts = []
    for i, sent in enumerate(flow):
        at = 0
        for j in sorted(range(n_new), key=lambda j: (price(i, j), j)):
            if sent[j]:
                cuts.append((i, 2 * at, 2 * (at + sent[j]), j))
                at += sent[j]
    plan = rows.sparkSession.createDataFrame(cuts, "old int, lo long, hi long, shard int")
    buckets = max(1, min(MOST_BUCKETS, -(-sum(n for _, n in sums.values()) // BUCKET_ROWS)))
    order = ["k", "size", *names]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    starts = running_starts(rows.groupBy("old", "bucket").agg(F.sum("size").alias("s")), ["old"], ["bucket"], "s", "before").drop("s")
    inside = Window.partitionBy("old", "bucket").orderBy(*order)
    rows = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    middle = 2 * (F.col("before") + F.col("upto")) - F.col("size")  # twice the middle of the row
    placed = rows.join(starts, ["old", "bucket"]).withColumn("middle", middle)
    placed = placed.join(F.broadcast(plan), "old").where("middle >= lo AND middle < hi")
    group = ["shard", "old", "bucket"]
    starts = running_starts(placed.groupBy(*group).agg(F.count("*").alias("n")), ["shard"], ["old", "bucket"], "n", "first").drop("n")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    placed = placed.withColumn("inside", rank).join(starts, group)
    slot = (F.col("first") + F.col("inside") - 1).cast("long").alias("slot")
    return placed.select(F.col("k").alias(key), "size", *(F.col(n).alias(c) for n, c in zip(names, carried or {}, strict=True)), F.when(F.col("old") < n_old, F.col("old")).alias("old_shard"), "shard", slot)


def rewrite(df: DataFrame, placed: DataFrame, key: str, path: str) -> list[int]:
    """Writes the shards that lose or gain rows below ``path`` as ``shard=N`` and returns their numbers.

    Rows are written with all their columns and ``slot``; columns of ``df`` named ``shard`` or ``slot`` are
    replaced. Shards that are not returned hold what they held; their files stay as they are.
    ``key`` must be unique, one null included; a row without an old shard touches its new one.
    """
    placed = materialise(placed.select(F.col(f"`{key}`").alias("_to_key"), F.col("old_shard").alias("_from"), F.col("shard").alias("_to"), F.col("slot").alias("_to_slot")))
    moved = placed.where("NOT (_from <=> _to)")
    touched = sorted({r[0] for r in moved.select(F.explode(F.array("_from", "_to"))).distinct().collect()} - {None})  # at most all shards
    rows = df.join(placed.where(F.col("_to").isin(touched)), df[f"`{key}`"].eqNullSafe(F.col("_to_key")))
    rows = rows.select(*others(df, "shard", "slot"), F.col("_to").alias("shard"), F.col("_to_slot").alias("slot"))
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).write.partitionBy("shard").parquet(path)
    return touched
