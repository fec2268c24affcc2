"""Zip archives as a data source: an archive's members are packed into partitions, so that one archive is read by many tasks."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.operators.splits import MOST_SHARDS, pack_archives, pack_members
from millrace.sources.blobs import byte_records, open_blob, validate


class _Members(InputPartition):
    def __init__(self, path: str, first: int, end: int, offset: int) -> None:
        self.path, self.first, self.end, self.offset = path, first, end, offset


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = validate({"blob_keys": options.get("path") or options.get("paths")})
        self.shards = min(MOST_SHARDS, int(options.get("shards", 8)))
        self.lines = options.get("records", "members") == "lines"
        self.first, self.offset = int(options.get("first", 0)), int(options.get("offset", 0))
        self.end = int(options["end"]) if options.get("end") else None

    def _sizes(self, path: str) -> list[int]:
        """From the table of contents alone."""
        with open_blob(path) as stream, zipfile.ZipFile(stream) as z:
            return [i.file_size for i in z.infolist()][self.first : self.end]

    def partitions(self) -> list[InputPartition]:
        sizes = {p: self._sizes(p) for p in self.paths}
        if len(sizes) == 1:
            found = [(p, a, b) for p, s in sizes.items() for a, b in pack_members(s, self.shards)]
        else:
            found = pack_archives(sizes, self.shards)
        return [_Members(p, self.first + a, self.first + b, self.offset if a == 0 else 0) for p, a, b in found]

    def read(self, part: _Members) -> Iterator[tuple]:
        with open_blob(part.path) as stream, zipfile.ZipFile(stream) as z:
            for k, info in enumerate(z.infolist()[part.first : part.end], part.first):
                if not self.lines:
                    yield part.path, k, info.filename, info.file_size, z.read(info)
                    continue
                start = part.offset if k == part.first else 0
                for at, line in byte_records(z.read(info), start=start, leading=True):
                    yield part.path, k, at, line.decode("utf-8", "replace")


class ZipSource(DataSource):
    """Format millrace_zip: options paths (with commas), records (members or lines), shards (8); first, end: members; offset: bytes.

    An offset skips that many bytes of the first member, where a reader that has delivered the lines before it goes on.
    """

    @classmethod
    def name(cls) -> str:
        return "millrace_zip"

    def schema(self) -> str:
        if self.options.get("records", "members") == "lines":
            return "blob_key string, file_index long, byte_offset long, line string"
        return "blob_key string, file_index long, filename string, file_size long, body binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def read_archives(spark: SparkSession, paths: list[str], records: str = "members", shards: int = 8, **options: int) -> DataFrame:
    spark.dataSource.register(ZipSource)
    return spark.read.format(ZipSource.name()).options(paths=",".join(paths), records=records, shards=shards, **options).load()
