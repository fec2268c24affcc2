"""Splitting rules: how input is divided among shards where the split itself is the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keyspace import split_strings

SHARDS = 8
MOST_SHARDS = 256
OVERSAMPLE = 32


def scatter_sample(df: DataFrame, key: str, shards: int) -> DataFrame:
    """(key, pos, total): the shards * 32 keys of least md5, numbered from 0 in key order; a top-k, then a sort of that many rows."""
    sample = df.select(F.col(key).alias("key")).orderBy(F.md5(F.col(key).cast("string").cast("binary")), "key").limit(shards * OVERSAMPLE)
    numbered = sample.select("key", (F.row_number().over(Window.orderBy("key")) - 1).alias("pos"))
    return numbered.crossJoin(F.broadcast(sample.agg(F.count(F.lit(1)).alias("total"))))


def _ranges(cuts: DataFrame, first: Column | None = None) -> DataFrame:
    order = Window.orderBy("i")
    inner = cuts.select((F.col("i") + 1).alias("split"), F.col("key").alias("range_start"), F.lead("key").over(order).alias("range_end"))
    head = cuts.agg(F.min("key").alias("range_end")).select(F.lit(0).cast("long").alias("split"), (first if first is not None else F.lit(None).cast("long")).alias("range_start"), "range_end")
    return head.unionByName(inner)


def scatter_ranges(df: DataFrame, key: str, shards: int) -> DataFrame:
    """(split, range_start, range_end), half-open, null for unbounded: cuts at sample[total * i / (shards - 1)], i < shards - 1.

    The first cut is the least sampled key.  One shard, or no rows, gives one unbounded range.
    """
    if shards <= 1:
        return df.sparkSession.createDataFrame([(0, None, None)], "split long, range_start long, range_end long")
    sample = scatter_sample(df, key, shards)
    i = F.explode(F.sequence(F.lit(0), F.lit(shards - 2))).alias("i")
    cuts = sample.select("key", "pos", "total", i).where(F.col("pos") == F.floor(F.col("total") * F.col("i") / (shards - 1))).select(F.col("i").cast("long").alias("i"), "key")
    return _ranges(cuts)


def scatter_ranges_oversampled(df: DataFrame, key: str, shards: int) -> DataFrame:
    """The other rule: from the first key, cuts at sample[i * max(1, total / shards)], 1 <= i < shards, while there are samples.

    The last range is open; no rows give no ranges.
    """
    sample = scatter_sample(df, key, shards)
    step = F.greatest(F.lit(1), F.floor(F.col("total") / shards))
    cuts = sample.where((F.col("pos") % step == 0) & F.floor(F.col("pos") / step).between(1, shards - 1)).select((F.floor(F.col("pos") / step) - 1).cast("long").alias("i"), "key")
    lowest = df.agg(F.min(key).alias("least"))
    ranges = _ranges(cuts).crossJoin(F.broadcast(lowest))
    return ranges.where("least IS NOT NULL").select("split", F.when(F.col("split") == 0, F.col("least")).otherwise(F.col("range_start")).alias("range_start"), "range_end")


def byte_ranges(size: int, shards: int, blobs: int = 1) -> list[tuple[int, int]]:
    """Equal chunks of a blob, the remainder in the last; shards are shared out over the blobs, one each at least."""
    n = max(1, min(MOST_SHARDS, shards) // max(1, blobs))
    chunk = size // n
    return [(i * chunk, size if i == n - 1 else (i + 1) * chunk) for i in range(n)]


def byte_splits(size: int, shards: int = 10) -> list[tuple[int, int]]:
    """Equal chunks, the remainder in the last; fewer bytes than shards give splits of one byte."""
    n = shards if size // shards else size
    chunk = max(1, size // shards)
    return [(i * chunk, size if i == n - 1 else (i + 1) * chunk) for i in range(n)]


def pack_to(sizes: Sequence[int], target: int) -> tuple[list[tuple[int, int]], int]:
    """Consecutive members (first, end) packed until a shard holds target bytes, and the bytes of those left over."""
    cuts, held = [0], 0
    for i, size in enumerate(sizes):
        held += size
        if held >= target:
            cuts.append(i + 1)
            held = 0
    return list(zip(cuts, cuts[1:], strict=False)), held


def pack_members(sizes: Sequence[int], shards: int) -> list[tuple[int, int]]:
    """Consecutive members packed until a shard holds its share of the bytes."""
    found, _ = pack_to(sizes, sum(sizes) // min(MOST_SHARDS, shards))
    end = found[-1][1] if found else 0
    return [*found, (end, len(sizes))] if end != len(sizes) else found


def pack_archive(sizes: Sequence[int], target: int) -> list[tuple[int, int]]:
    """One archive's share of pack_archives: members left over make a shard of their own if they have bytes."""
    found, held = pack_to(sizes, target)
    return [*found, (found[-1][1] if found else 0, len(sizes))] if held else found


def pack_archives(archives: dict[str, Sequence[int]], shards: int) -> list[tuple[str, int, int]]:
    """As pack_members over several archives, with one target for all; no shard crosses an archive."""
    target = sum(map(sum, archives.values())) // min(MOST_SHARDS, shards)
    return [(name, a, b) for name, sizes in archives.items() for a, b in pack_archive(sizes, target)]


def number_ranges(start: int, end: int, shards: int) -> list[tuple[int, int]]:
    """[start, end) in shards pieces whose bounds are rounded half up; 0 <= start < end is required."""
    if start < 0 or end <= start:
        raise ValueError(f"range must satisfy 0 <= start < end: {start}, {end}")
    step = (end - start) / shards
    bounds = [start + int(i * step + 0.5) for i in range(shards)] + [end]
    return list(zip(bounds, bounds[1:], strict=False))


def number_bounds(start: Column, end: Column, shards: Column, i: Column) -> Column:
    """The i-th bound of number_ranges as a Column."""
    return F.when(i == shards, end).otherwise(start + F.floor(i * ((end - start) / shards.cast("double")) + 0.5))


def byte_bounds(size: Column, shards: int) -> Column:
    """Array of (i, chunk_start, chunk_end): the byte_ranges of a blob of size bytes as a Column."""
    chunk = F.floor(size / shards).cast("long")
    piece = lambda i: F.struct(i.alias("i"), (i * chunk).alias("chunk_start"), F.when(i == shards - 1, size).otherwise((i + 1) * chunk).alias("chunk_end"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), piece)


def round_robin(number: Column, shards: int) -> Column:
    return F.pmod(number, F.lit(shards))


def deal_ranges(ranges: Sequence[tuple], shards: int) -> list[list[tuple]]:
    """Ranges of all namespaces, in their order, dealt to shards in turn; shards that get none are left out."""
    return [dealt for k in range(shards) if (dealt := list(ranges[k::shards]))]


def reduce_ranges(job: str, low: str, high: str, shards: int) -> list[tuple[str, str]]:
    """Bounds of the raw keys that each reduce shard reads; equal bounds of the key space give one split that reads all."""
    cuts = split_strings(low, high, shards - 1) if low != high else []
    starts = [low, *cuts]
    return [(f"{job}_{a}_0", f"{job}_{b}_0" if b is not None else f"{job}z") for a, b in zip(starts, [*cuts, None], strict=True)]
