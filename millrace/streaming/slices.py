"""Bounded scans in slices: each micro-batch covers one range of keys, and the checkpoint keeps where the next one starts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.keyspace import KeyRange


class _SliceReader(SimpleDataSourceStreamReader):
    """Offsets are keys.  A batch is a single row, the slice's bounds: the rows themselves are read by an ordinary scan."""

    def __init__(self, options: dict) -> None:
        self.start, self.end, self.width = (int(options[k]) for k in ("start", "end", "width"))
        if self.width < 1:
            raise ValueError("width: at least one key a slice")

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        low = int(start["next"])
        high = min(low + self.width, self.end)
        return (iter([(low, high)]) if high > low else iter(())), {"next": max(low, high)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(int(start["next"]), int(end["next"]))]) if end["next"] > start["next"] else iter(())


class SliceSource(DataSource):
    """Format millrace_slices: options start, end and width, in keys; rows are (low, high), half-open."""

    @classmethod
    def name(cls) -> str:
        return "millrace_slices"

    def schema(self) -> str:
        return "low long, high long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001
        return _SliceReader(self.options)


def width_of(rate: float, seconds: float = 15.0) -> int:
    """Keys of a slice that lasts seconds at a rate of records a second."""
    return max(1, int(rate * seconds))


def slice_stream(spark: SparkSession, start: int, end: int, width: int) -> DataFrame:
    spark.dataSource.register(SliceSource)
    return spark.readStream.format(SliceSource.name()).options(start=start, end=end, width=width).load()


def run_slices(df: DataFrame, key: str, start: int, end: int, width: int, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call process(rows, slice number) for the rows of df in each slice of [start, end).

    The stream carries bounds only, two numbers a slice; the filter on the key reaches df's scan.  A query that is started
    again with the same checkpoint goes on behind its last finished slice; a slice that was cut short is given again with the
    same number, so process must replace what that number left.
    """

    def each(bounds: DataFrame, number: int) -> None:
        for row in bounds.collect():  # one row
            process(df.where(KeyRange(row["low"], row["high"]).predicate(F.col(key))), number)

    return slice_stream(df.sparkSession, start, end, width).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def finish(query: StreamingQuery) -> None:
    """Wait until all slices are done, then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def write_slice(folder: str) -> Callable[[DataFrame, int], None]:
    """A process for run_slices: each slice has a folder of its own, which a repeated slice replaces."""

    def process(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/slice={number}")

    return process


def upsert_slice(folder: str, base: DataFrame, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A process that puts each slice's rows into a table of versions: version n + 1 is version n with slice n's rows put in.

    A repeated slice makes the same version again, so delivery is exactly once.
    """
    from millrace.operators.mutations import put

    spark = base.sparkSession

    def process(rows: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{folder}/version={number}") if number else base
        put(before, rows, keys).write.mode("overwrite").parquet(f"{folder}/version={number + 1}")

    return process


def progress(query: StreamingQuery) -> dict:
    """What the last micro-batch says: its number and the next key."""
    last = query.lastProgress
    source = (last["sources"] if isinstance(last, dict) else last.sources)[0] if last else None
    offset = (source["endOffset"] if isinstance(source, dict) else source.endOffset) if source else None
    offset = json.loads(offset) if isinstance(offset, str) else offset
    return {"slice": (last["batchId"] if isinstance(last, dict) else last.batchId) if last else None, "next": offset.get("next") if offset else None}
