"""Poisson tail test as a native column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedalgrid.constants import SURPRISE_ALPHA, SURPRISE_CAP, SURPRISE_FLOOR


def surprise_threshold(
    lam: Column,
    alpha: float = SURPRISE_ALPHA,
    floor: int = SURPRISE_FLOOR,
    cap: int = SURPRISE_CAP,
) -> Column:
    """Smallest count k whose chance P(X >= k) is below ``alpha`` when X ~ Poisson(lam).

    Never below ``floor``, never above ``cap``; no rate at all gives ``floor``.
    """
    start = F.struct(
        F.exp(-lam).alias("mass"), F.exp(-lam).alias("below"), F.lit(None).cast("int").alias("k")
    )

    def step(acc, i):
        found = F.coalesce(acc["k"], F.when(1 - acc["below"] < alpha, i))
        mass = acc["mass"] * lam / i
        return F.struct(
            mass.alias("mass"), (acc["below"] + mass).alias("below"), found.alias("k")
        )

    counts = F.sequence(F.lit(1), F.lit(cap - 1))
    first = F.aggregate(counts, start, step, lambda acc: acc["k"])
    return F.when(lam <= 0, floor).otherwise(
        F.greatest(F.coalesce(first, F.lit(cap)), F.lit(floor))
    )
