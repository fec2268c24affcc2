"""Put and delete mutations of keyed tables, and the batching of their writes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(ops: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of the rows with one key, that of the greatest seq."""
    others = [c for c in ops.columns if c not in keys]
    best = ops.groupBy(*keys).agg(F.max(F.struct(seq, *[c for c in others if c != seq])).alias("__last"))
    return best.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in others]).select(*ops.columns)


def put(base: DataFrame, puts: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """base with the rows of puts in place of those with their keys; of several puts of one key the last by seq wins.

    Putting the same rows again changes nothing.
    """
    rows = last_by_key(puts, keys, seq).drop(seq) if seq else puts.dropDuplicates(keys)
    return base.join(rows.select(*keys), keys, "left_anti").select(*base.columns).unionByName(rows.select(*base.columns))


def delete(base: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(deletes.select(*keys), keys, "left_anti").select(*base.columns)


def apply_pool(base: DataFrame, ops: DataFrame, keys: list[str], op: str = "op", seq: str = "seq", ordered: bool = False) -> DataFrame:
    """One flush: all puts, then all deletes, so that a key both deleted and put ends deleted; ordered: the last op of a key wins."""
    if ordered:
        ops = last_by_key(ops, keys, seq)
    puts = ops.where(F.col(op) == "put").drop(op)
    return delete(put(base, puts, keys, seq), ops.where(F.col(op) == "delete"), keys)


def put_if_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys base doesn't hold."""
    return rows.join(base.select(*keys), keys, "left_anti").select(*rows.columns)


def multi_get(wanted: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Each wanted key with its row, nulls where there is none."""
    return wanted.join(base, keys, "left")


def flush_number(order: Column | list[Column], limit: int, before: bool, partition: list[str]) -> Column:
    """Flush in which a mutation is written: full pools flush before the next is added, or after the one that fills them.

    partition: what one pool gathers, a task's or a key's; a pool of all rows would be one task's. Both give floor((n - 1) / limit); they differ in when a full pool is written, not in what is written together.
    """
    window = Window.partitionBy(*partition).orderBy(*(order if isinstance(order, list) else [order]))
    return F.floor((F.row_number().over(window) - 1) / limit).cast("long")


class MutationPool:
    """Task-side buffer of puts and deletes, written together by flush: first all puts, then all deletes.

    before: a full pool flushes before the mutation that would exceed count or size; otherwise by size before and by count
    after adding.  Each retry of the task halves the limits.
    """

    def __init__(self, write: Callable[[list, list], None], count: int = 500, size: int = 900_000, before: bool = True, retries: int = 0) -> None:
        self.write, self.before = write, before
        self.count, self.size = max(1, count >> retries), max(1, size >> retries)
        self.puts: list = []
        self.deletes: list = []
        self.held = self.flushes = 0

    def _add(self, kind: str, item: object, size: int) -> None:
        n = len(self.puts) + len(self.deletes)
        if n and (self.before and n >= self.count or (self.held + size > self.size if self.before else self.held + size >= self.size)):
            self.flush()
        getattr(self, kind).append(item)
        self.held += size
        if not self.before and len(self.puts) + len(self.deletes) >= self.count:
            self.flush()

    def put(self, item: object, size: int = 0) -> None:
        self._add("puts", item, size)

    def delete(self, key: object, size: int = 0) -> None:
        self._add("deletes", key, size)

    def flush(self) -> None:
        if self.puts or self.deletes:
            self.write(self.puts, self.deletes)
            self.flushes += 1
        self.puts, self.deletes, self.held = [], [], 0


def batches_by_size(sizes: Iterable[int], count: int = 500, size: int = 900_000, before: bool = True) -> Iterator[int]:
    """Flush number of each of a row of mutations."""
    pool = MutationPool(lambda p, d: None, count, size, before)
    for s in sizes:
        if before:
            pool.put(None, s)
            yield pool.flushes
        else:
            full = len(pool.puts) and pool.held + s >= pool.size
            yield pool.flushes + bool(full)
            pool.put(None, s)
