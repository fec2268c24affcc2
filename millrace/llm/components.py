"""Distributed connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Edges
stay in DataFrames throughout; each round's edges are written to the shared
checkpoint folder in place of those of the round before, so neither lineage, disk
nor the driver grows with the rounds.  A
vertex with very many neighbours is only ever aggregated with min(), which
combines before the shuffle, and joined back by a broadcast of the few such
vertices; its neighbours are never gathered, in a list or in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Stored, cut, gathered, join_totals, let_go


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = join_totals(both, 2 * size, ["u"], F.min("v").alias("m")).where("v > u")
    return moved.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = join_totals(down, size, ["u"], F.min("v").alias("m"))
    own = moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return own.select("e.u", "e.v").where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, source: str = "u", target: str = "v", most: int | None = None) -> DataFrame:
    """(vertex, component) for every vertex of an edge, component being the least vertex reachable; most: a bound of edges' rows, if known.

    Nulls and self-loops link nothing and are left out; repeated edges count once; without edges the result is empty.
    """
    edges = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).where("u <> v")
    first = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    held = Stored(first if most is None else gathered(first, most))
    before = _state(held.rows)
    while before[0]:
        # A round never makes more edges than there were.
        found = Stored(gathered(_small_star(_large_star(held.rows, before[0]), before[0]), before[0]))
        held.drop()
        held = found
        after = _state(held.rows)
        if after == before:
            break
        before = after
    edges = cut(held.rows)
    held.drop()
    let_go(edges.sparkSession)
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)
