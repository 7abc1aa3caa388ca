"""Shannon entropy from exact counts, base 2."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def n_log_n(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def entropy_from_sums(total: Column, sum_n_log_n: Column) -> Column:
    """``log2(N) - sum(n log2 n) / N``, which needs no join of counts with their total."""
    return F.when(total > 0, F.log2(total.cast("double")) - sum_n_log_n / total).otherwise(F.lit(0.0))


def entropy_of(counts: Iterable[int]) -> float:
    """The same for the few class counts that are already on the driver."""
    kept = [n for n in counts if n > 0]
    total = sum(kept)
    return math.log2(total) - math.fsum(n * math.log2(n) for n in kept) / total if total else 0.0
