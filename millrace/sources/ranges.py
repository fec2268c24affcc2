"""Numbers of a range, divided among partitions by the rounding rule of splits.number_ranges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.operators.splits import number_ranges


class _Part(InputPartition):
    def __init__(self, shard: int, start: int, end: int) -> None:
        self.shard, self.start, self.end = shard, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ranges = number_ranges(int(options["range_start"]), int(options["range_end"]), int(options.get("shards", 4)))

    def partitions(self) -> list[InputPartition]:
        return [_Part(i, a, b) for i, (a, b) in enumerate(self.ranges)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for value in range(partition.start, partition.end):
            yield value, partition.shard


class NumberRange(DataSource):
    """Format millrace_range: options range_start, range_end (both required, 0 <= start < end) and shards (4)."""

    @classmethod
    def name(cls) -> str:
        return "millrace_range"

    def schema(self) -> str:
        return "value long, shard long"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def numbers(spark: SparkSession, start: int, end: int, shards: int = 4) -> DataFrame:
    """(value, shard) of [start, end), one partition for each shard."""
    number_ranges(start, end, shards)
    spark.dataSource.register(NumberRange)
    return spark.read.format(NumberRange.name()).options(range_start=start, range_end=end, shards=shards).load()
