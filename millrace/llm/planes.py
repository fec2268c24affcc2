"""Token ids in binary files of shuffled planes.

A file holds the ids of consecutive documents end to end.  They are cut into
blocks of a fixed number of ids; each block's 32-bit ids are transposed into byte
planes (all lowest bytes, all second bytes, ...) or bit planes, and each plane is
compressed with zstandard on its own.  Behind the blocks stand the chunk index
(place, ids and plane lengths of each block), the document table (id and number of
ids) and a fixed-length footer, so that a reader finds any document by reading the
footer, the index and the blocks that the document lies in.

    blocks | index | documents | footer (index at, documents at, blocks, documents, ids, block size, planes, magic)

All numbers are little-endian.  Writers stream: no more than one block of ids and
its planes is held.  A file is written under a temporary name and moved to its own
name when complete; the name depends on the partition only, so a repeated task
replaces its own file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import shared_dir
from ._text import tidied
from .bpe import encoder

BLOCK_IDS = 1 << 16
LEVEL = 1
_FOOTER = struct.Struct("<QQQQQII8s")
_MAGIC = b"MRPLANE1"
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])


def split_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of 32-bit ids, least significant first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def join_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in parts], 1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts], 1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file to a binary stream."""

    def __init__(self, stream, planes: int = 4, block_ids: int = BLOCK_IDS) -> None:  # noqa: ANN001
        if planes not in (4, 32):
            raise ValueError("planes: 4 (bytes) or 32 (bits)")
        self.stream, self.planes, self.block_ids = stream, planes, block_ids
        self._compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self._open: list[bytes] = []
        self._open_bytes = self._at = self.ids = 0
        self._index: list[np.ndarray] = []
        self._docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append a document's packed ids."""
        self._docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self._open.append(ids)
        self._open_bytes += len(ids)
        self.ids += len(ids) // 4
        while self._open_bytes >= 4 * self.block_ids:
            data = b"".join(self._open)
            self._block(data[: 4 * self.block_ids])
            self._open = [data[4 * self.block_ids :]]
            self._open_bytes = len(self._open[0])

    def _block(self, data: bytes) -> None:
        parts = [self._compress(p) for p in split_planes(np.frombuffer(data, "<u4"), self.planes)]
        self._index.append(np.array([self._at, len(data) // 4, *map(len, parts)], "<u8"))
        for p in parts:
            self._put(p)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self._at += len(data)

    def close(self) -> None:
        if self._open_bytes:
            self._block(b"".join(self._open))
        index_at = self._at
        self._put(self._compress(b"".join(x.tobytes() for x in self._index)))
        docs_at = self._at
        self._put(self._compress(np.array(self._docs, _DOC).tobytes()))
        self._put(_FOOTER.pack(index_at, docs_at, len(self._index), len(self._docs), self.ids, self.block_ids, self.planes, _MAGIC))


class PlaneReader:
    """Reads a file written by PlaneWriter from a seekable stream."""

    def __init__(self, stream) -> None:  # noqa: ANN001
        self.stream = stream
        stream.seek(0, 2)
        size = stream.tell()
        if size < _FOOTER.size:
            raise ValueError("not a plane file: too short")
        index_at, docs_at, blocks, docs, self.ids, self.block_ids, self.planes, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not a plane file: wrong magic")
        self._expand = zstandard.ZstdDecompressor().decompress
        self.index = np.frombuffer(self._expand(self._read(index_at, docs_at - index_at)), "<u8").reshape(blocks, 2 + self.planes)
        self.docs = np.frombuffer(self._expand(self._read(docs_at, size - _FOOTER.size - docs_at)), _DOC)
        self.starts = np.r_[0, np.cumsum(self.docs["n"])].astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, *lengths = self.index[k].tolist()
        raw = self._read(at, sum(lengths))
        parts, p = [], 0
        for m in lengths:
            parts.append(self._expand(raw[p : p + m]))
            p += m
        return join_planes(parts, n)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        start, end = int(self.starts[k]), int(self.starts[k + 1])
        parts = [self.block(b) for b in range(start // self.block_ids, -(-end // self.block_ids))] if end > start else []
        ids = np.concatenate(parts or [np.zeros(0, "<u4")])
        base = start // self.block_ids * self.block_ids
        return ids[start - base : end - base]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, start within the file and ids of every document, reading each block once."""
        held, first, following = np.zeros(0, "<u4"), 0, 0
        for k, (doc_id, null, n) in enumerate(self.docs.tolist()):
            start = int(self.starts[k])
            parts = [held[start - first :]]
            have = len(parts[0])
            while have < n:
                parts.append(self.block(following))
                have += len(parts[-1])
                following += 1
            held, first = (np.concatenate(parts) if len(parts) > 1 else parts[0]), start
            yield (None if null else doc_id), start, held[:n]


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_planes(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 1, planes: int = 4, id_column: str = "doc_id", text_column: str = "text") -> list[tuple[str, int, int]]:
    """Encode all documents and write them to folder in ascending id order; (path, documents, ids) of each file, in order.

    folder must be seen by driver and executors alike.  Null ids come first; rows with equal ids are ordered by a hash of their
    texts.  A null text is an empty one: its document consists of end_id alone, or of nothing without one.  Rows are
    range-partitioned by id, one file for each partition; an empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        system, base = _filesystem(folder)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}.planes"
        temporary = f"{base}/.{uuid.uuid4().hex}"
        writer = stream = None
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc_id, packed in zip(part.column(1).to_pylist(), coder.encode_batch(part.column(0).to_pylist()), strict=True):
                    if writer is None:
                        system.create_dir(base, recursive=True)
                        stream = system.open_output_stream(temporary)
                        writer = PlaneWriter(stream, planes)
                    writer.add(doc_id, packed + end)
                    count += 1
        if writer is not None:
            writer.close()
            stream.close()
            system.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([count], pa.int64()), pa.array([writer.ids], pa.int64())], ["part", "path", "docs", "ids"])

    ordered = docs.select(F.col(text_column).cast("string").alias("__text"), F.col(id_column).cast("long").alias("__id"), F.xxhash64(text_column).alias("__tie"))
    ordered = ordered.repartitionByRange("__id", "__tie").sortWithinPartitions("__id", "__tie").drop("__tie")
    files = ordered.mapInArrow(tidied(run, "encoder"), "part int, path string, docs long, ids long").collect()
    prefix = folder[: folder.index(":") + 1] if ":" in folder.split("/")[0] else ""
    return [(prefix + r["path"] if prefix == "file:" else r["path"], r["docs"], r["ids"]) for r in sorted(files, key=lambda r: r["part"])]


def read_planes(spark: SparkSession, files: list[tuple[str, int, int]], folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it, over all files), n_tokens, ids_crc32 and, with_ids, ids, from the files.

    The list of files has one entry for each partition written; each file is read by one task, block by block.
    """
    rows, start = [], 0
    for path, _, n in files:
        rows.append((path, start))
        start += n
    extra = ", ids array<long>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(path.removeprefix("file:")) as stream:
                    out: list[list] = [[], [], [], [], []]
                    held = 0

                    def flush(out: list[list]) -> pa.RecordBatch:
                        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
                        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=False)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

                    for doc_id, at, ids in PlaneReader(stream).documents():
                        for x, v in zip(out, (doc_id, base + at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))), strict=False):
                            x.append(v)
                        if with_ids:
                            out[4].append(ids.astype(np.int64))
                        held += len(ids)
                        if held >= 1 << 20:
                            yield flush(out)
                            out, held = [[], [], [], [], []], 0
                    if out[0]:
                        yield flush(out)

    schema = f"doc_id long, start long, n_tokens long, ids_crc32 long{extra}"
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(rows, "path string, start long").repartition(len(rows), "path").mapInArrow(tidied(run, "encoder"), schema)


def plane_documents(docs: DataFrame, tokenizer: str, planes: int = 4, end_id: int | None = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write all documents as plane files into the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = f"{shared_dir(docs.sparkSession)}/planes-{uuid.uuid4().hex}"
    return read_planes(docs.sparkSession, write_planes(docs, tokenizer, folder, end_id, planes, id_column, text_column), folder)
