"""Named counters: sums by name, arithmetic on counter maps, and the roll-up of shards into jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_name(df: DataFrame, *names: Column | str, delta: Column | None = None) -> DataFrame:
    """Sum of delta (1 by default) for each name; rows without a name are left out."""
    cols = [F.col(n) if isinstance(n, str) else n for n in names]
    total = F.sum(delta) if delta is not None else F.count(F.lit(1))
    return df.groupBy(*cols).agg(total.cast("long").alias("value"))


def add_maps(a: Column, b: Column) -> Column:
    """Sum of two counter maps; a name missing in one counts 0 there."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def sub_maps(a: Column, b: Column) -> Column:
    """Difference of two counter maps; a name whose difference is 0 stays."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
