"""Orders of keys: global ranks without a single sorting task, pages with cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import materialise


def rank_rows(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """df with each row's place in the given order, from 1.

    Rows are range-partitioned and sorted where they are; the counts of the partitions, one row each, give the offsets.  Ties
    are numbered in no particular order: give columns that break them.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(placed.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("__part", (before - F.col("__first") + 1).alias("__shift"))
    ranked = placed.withColumn("__part", part).join(F.broadcast(shifts), "__part")
    return ranked.select(*df.columns, (F.col("__at") + F.col("__shift")).cast("long").alias(out))


def page(df: DataFrame, key: str, count: int = 50, cursor: str | int | None = None) -> DataFrame:
    """The count least keys from cursor on and one more, whose key is the next page's cursor: a top-k, never a full sort."""
    rows = df if cursor is None else df.where(F.col(key) >= cursor)
    return rows.orderBy(key).limit(count + 1)


def cursor_of(rows: DataFrame, key: str, count: int = 50) -> DataFrame:
    """One row: the cursor after a page, null on the last one."""
    return rows.agg(F.when(F.count(F.lit(1)) > count, F.max(key)).alias("cursor"))
