"""A sink of mutations: every task gathers puts and deletes in a pool and writes them batch by batch.

A task writes one Parquet file, a row group for each flush of its pool.  Files count once
the driver has committed them, in a manifest of names; those of failed or repeated tasks are
never read, so that a table of mutations holds each of a job's once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from millrace.operators.mutations import MutationPool

SCHEMA = "op string, seq long, key string, payload string"
_ARROW = pa.schema([("op", pa.string()), ("seq", pa.int64()), ("key", pa.string()), ("payload", pa.string()), ("flush", pa.int64())])


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    flushes: int
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.limits = {"count": int(options.get("count", 500)), "size": int(options.get("size", 900_000)), "before": options.get("before", "true") == "true"}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        system, folder = _system(self.path)
        system.create_dir(folder)
        name = f"{folder}/mutations-{task.partitionId()}-{uuid.uuid4().hex}.parquet"
        rows = 0
        with system.open_output_stream(name) as stream, pq.ParquetWriter(stream, _ARROW) as file:

            def flush(puts: list, deletes: list) -> None:
                batch = [*puts, *deletes]
                file.write_table(pa.table([*(pa.array([r[k] for r in batch], _ARROW.field(k).type) for k in range(4)), pa.array([pool.flushes] * len(batch), pa.int64())], schema=_ARROW))

            pool = MutationPool(flush, retries=task.attemptNumber(), **self.limits)
            for found in iterator:
                for row in zip(*(found.column(n).to_pylist() for n in _ARROW.names[:4]), strict=True):
                    add = {"put": pool.put, "delete": pool.delete}.get(row[0])
                    if add is None:
                        raise ValueError(f"neither put nor delete: {row[0]!r}")
                    add(row, len(row[3] or "") + len(row[2] or ""))
                    rows += 1
            pool.flush()
        return _Written(name, pool.flushes, rows)

    def commit(self, messages: list) -> None:
        system, folder = _system(self.path)
        system.create_dir(folder)
        found = [m for m in messages if m is not None]
        body = json.dumps({"files": [m.name for m in found if m.rows], "flushes": sum(m.flushes for m in found), "rows": sum(m.rows for m in found)})
        with system.open_output_stream(f"{folder}/_committed-{uuid.uuid4().hex}.json") as stream:
            stream.write(body.encode())

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                system, _ = _system(self.path)
                system.delete_file(m.name)


class MutationSink(DataSource):
    """Format millrace_mutations, for writing rows of SCHEMA: options path, count (500), size (900,000), before (true)."""

    @classmethod
    def name(cls) -> str:
        return "millrace_mutations"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return _Writer(self.options)


def write_mutations(ops: DataFrame, path: str, **limits: object) -> None:
    """Append ops (op, seq, key, payload, the last two as JSON) to the table of mutations at path."""
    ops.sparkSession.dataSource.register(MutationSink)
    options = {k: str(v).lower() for k, v in limits.items()}
    ops.select("op", "seq", "key", "payload").write.format(MutationSink.name()).mode("append").options(path=path, **options).save()


def manifests(path: str) -> list[dict]:
    """What has been committed at path: files, flushes and rows of each write."""
    system, folder = _system(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    out = []
    for info in sorted((i for i in found if i.base_name.startswith("_committed-")), key=lambda i: i.base_name):
        with system.open_input_stream(info.path) as stream:
            out.append(json.loads(stream.read()))
    return out


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """All committed mutations at path, with the flush of its task that wrote each."""
    files = [f for m in manifests(path) for f in m["files"]]
    schema = f"{SCHEMA}, flush long"
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
