"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: Column, n: int, slack: int = 4, rows: int | None = None, distinct: bool = False) -> DataFrame:
    """At most n rows of df: those with the smallest hash of `key`, the same for the same rows.

    Only about slack * n rows over the whole cluster reach the final ordering: a share of the hash range is kept, set
    by the number of rows (`rows`, or a count), so that no task sends its own top n.  distinct: equal rows count once
    (made so among those kept, not over the whole table).
    """
    total = rows if rows is not None else df.count()
    h = F.xxhash64(key)
    share = min(1.0, slack * n / max(1, total))
    near = df if share >= 1 else df.filter(F.pmod(h, F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))
    near = near.distinct() if distinct else near
    return near.orderBy(F.pmod(h, F.lit(1_000_003)), h, key).limit(n)
