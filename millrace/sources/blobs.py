"""Blob sources: records of lines or bytes with their offsets, and members of zip archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BLOBS = 246
BLOB_KEYS = "blob_keys"


def record_offsets(df: DataFrame, text: str, *keep: str, terminator: str = "\n") -> DataFrame:
    """(keep..., offset, record) of every record of every row's text: ended by terminator, or the unended last one.

    Offsets are in UTF-8 bytes.  Blank records count, nothing follows a final terminator, carriage returns stay, a null text has
    no records.  Rows are cut where they are, whole columns at a time: nothing is shuffled.
    """
    width = len(terminator.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0)
            parts = pc.split_pattern(pc.fill_null(whole, ""), terminator)
            first = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            records = parts.flatten()
            ends = np.cumsum(pc.binary_length(records).to_numpy(zero_copy_only=False).astype(np.int64) + width)
            starts = np.r_[0, ends[:-1]] if len(ends) else ends
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            offset = starts - (starts[first[:-1]] if len(ends) else starts)[row]
            size = pc.binary_length(pc.fill_null(whole, "")).to_numpy(zero_copy_only=False)
            real = np.flatnonzero(offset < size[row])
            at = pa.array(row[real])
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), pa.array(offset[real]), records.take(pa.array(real)).cast(pa.string())], [*keep, "offset", "record"])

    kept = df.select(*keep)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return df.select(F.col(text).cast("string").alias("__text"), *keep).mapInArrow(run, f"{fields}offset long, record string")


def byte_records(data: bytes, terminator: int = 0x0A, start: int = 0, end: int | None = None, leading: bool | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records of a split [start, end].

    A record belongs to the split in which it starts, one that starts at end included; a split that isn't the leading one
    skips its first record, which is the previous split's.  Every record of a blob so comes out once, wherever it is cut.
    """
    if not -128 <= terminator <= 255:
        raise ValueError(f"terminator must be a byte: {terminator}")
    mark = bytes([terminator % 256])
    leading = start == 0 if leading is None else leading
    end = len(data) if end is None else end
    at = start
    if not leading:
        found = data.find(mark, at)
        at = len(data) if found < 0 else found + 1
    while at < len(data) and (at <= end if end < len(data) else True):
        found = data.find(mark, at)
        stop = len(data) if found < 0 else found
        yield at, data[at:stop]
        at = stop + 1


def blob_info(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of files: path, length, modificationTime; content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def blob_query(spark: SparkSession, path: str, rest: str = "") -> DataFrame:
    """SELECT * over blob_info, with what may follow FROM: WHERE, ORDER BY, LIMIT."""
    return spark.sql(f"SELECT * FROM {{blobs}} {rest}", blobs=blob_info(spark, path))


def open_blob(path: str, buffer: int = 131_072) -> io.BufferedReader:
    """A file in any store as a buffered, seekable stream for reading."""
    if "://" in path or path.startswith("file:"):
        system, name = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    else:
        system, name = fs.LocalFileSystem(), path
    return io.BufferedReader(system.open_input_file(name), buffer)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files without their newline; carriage returns stay."""
    return spark.read.option("lineSep", "\n").text(path)


def line_offsets(spark: SparkSession, path: str, terminator: str = "\n") -> DataFrame:
    """(offset, record) of splittable text files, by the Hadoop line reader, which no split makes lose or repeat a record."""
    rdd = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", conf={"textinputformat.record.delimiter": terminator}
    )
    return spark.createDataFrame(rdd, "offset long, record string")


def zip_files(blobs: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(blob_key, file_index, filename, file_size, body) of every member of every archive, in the order of the table of contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for i, info in enumerate(z.infolist()):
                        yield pa.RecordBatch.from_pydict({"blob_key": [name], "file_index": pa.array([i], pa.int64()), "filename": [info.filename], "file_size": [info.file_size], "body": [z.read(info)]})

    return blobs.select(F.col(key).cast("string"), content).mapInArrow(run, "blob_key string, file_index long, filename string, file_size long, body binary")


def zip_lines(blobs: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(blob_key, file_index, byte_offset, line) of every line of every member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for i, info in enumerate(z.infolist()):
                        found = list(byte_records(z.read(info)))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([i] * len(found), pa.int64()), pa.array([o for o, _ in found], pa.int64()), pa.array([r.decode("utf-8", "replace") for _, r in found], pa.string())], ["blob_key", "file_index", "byte_offset", "line"])

    return blobs.select(F.col(key).cast("string"), content).mapInArrow(run, "blob_key string, file_index long, byte_offset long, line string")


def validate(params: dict, exists=lambda key: True) -> list[str]:  # noqa: ANN001
    """The blob keys of a reader's parameters (a list, or a string with commas), checked."""
    keys = params.get(BLOB_KEYS)
    keys = keys.split(",") if isinstance(keys, str) else keys
    if not keys:
        raise ValueError("blob_keys are required")
    if len(keys) > MOST_BLOBS:
        raise ValueError(f"at most {MOST_BLOBS} blob keys")
    if missing := [k for k in keys if not exists(k)]:
        raise ValueError(f"no such blobs: {missing}")
    return keys
