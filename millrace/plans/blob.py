"""Blob queries: lines, byte records, archives."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import splits
from millrace.sources import blobs
from millrace.sources.tables import table


def blob_lines(s: SparkSession, d: str) -> DataFrame:
    return blobs.record_offsets(table(s, d, "documents"), "text", "doc_id").withColumnRenamed("record", "line")


def blob_lines_sharded(s: SparkSession, d: str) -> DataFrame:
    """Lines of each of four byte ranges of each document: a line belongs to the range it starts in, bounds to the earlier one.

    Texts under four bytes have ranges without bytes: their first line is in the first, what follows in the last.
    """
    docs = table(s, d, "documents").select("doc_id", "text", F.floor(F.octet_length("text") / 4).cast("long").alias("chunk"))
    lines = blobs.record_offsets(docs, "text", "doc_id", "chunk")
    start, chunk = F.col("offset"), F.col("chunk")
    shard = F.when(start == 0, 0).when(chunk == 0, 3).otherwise(F.least(F.lit(3), F.greatest(F.ceil(start / chunk) - 1, F.lit(0))))
    return lines.groupBy("doc_id", shard.cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def blob_records(s: SparkSession, d: str) -> DataFrame:
    return blobs.record_offsets(table(s, d, "documents"), "text", "doc_id", terminator=".")


def blob_info(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))


def _archives(s: SparkSession, d: str) -> DataFrame:
    """(blob_key, content): an archive of each source's documents, in the order of their ids, members named by id."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, text in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True):
                z.writestr(f"{i}.txt", text)
        return pa.table({"blob_key": [t.column("blob_key")[0].as_py()], "content": pa.array([out.getvalue()], pa.binary())})

    docs = table(s, d, "documents").select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 100).cast("string")).alias("blob_key"), "doc_id", "text")
    return docs.groupBy("blob_key").applyInArrow(pack, "blob_key string, content binary")


def zip_files(s: SparkSession, d: str) -> DataFrame:
    """Members of archives of a hundred ids of one source each."""
    return blobs.zip_files(_archives(s, d), "blob_key").select("blob_key", "file_index", "filename", "file_size", F.md5("body").alias("body_md5"))


def zip_lines(s: SparkSession, d: str) -> DataFrame:
    return blobs.zip_lines(_archives(s, d), "blob_key")


def split_zip(s: SparkSession, d: str) -> DataFrame:
    """Packing of each archive's members into four shards."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("file_index")
        key, found = t.column("blob_key")[0].as_py(), splits.pack_members(t.column("file_size").to_pylist(), 4)
        return pa.table({"blob_key": pa.array([key] * len(found), pa.string()), "shard": pa.array(range(len(found)), pa.int64()), "first_file": pa.array([a for a, _ in found], pa.int32()), "end_file": pa.array([b for _, b in found], pa.int32())})

    members = blobs.zip_files(_archives(s, d), "blob_key").select("blob_key", "file_index", "file_size")
    return members.groupBy("blob_key").applyInArrow(pack, "blob_key string, shard long, first_file int, end_file int")


def split_zip_lines(s: SparkSession, d: str) -> DataFrame:
    """Packing of all archives' members into 64 shards, none crossing an archive: the target is a figure of all, the rest is by archive."""
    members = blobs.zip_files(_archives(s, d), "blob_key").select("blob_key", "file_index", "file_size")
    total = members.agg(F.sum("file_size").alias("total"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("file_index")
        key, sizes, target = t.column("blob_key")[0].as_py(), t.column("file_size").to_pylist(), t.column("total")[0].as_py() // 64
        out = splits.pack_archive(sizes, target)
        return pa.table({"blob_key": pa.array([key] * len(out), pa.string()), "first_file": pa.array([a for a, _ in out], pa.int32()), "end_file": pa.array([b for _, b in out], pa.int32())})

    return members.crossJoin(F.broadcast(total)).groupBy("blob_key").applyInArrow(pack, "blob_key string, first_file int, end_file int")


QUERIES = {f.__name__: f for f in (blob_lines, blob_lines_sharded, blob_records, blob_info, zip_files, zip_lines, split_zip, split_zip_lines)}

_LINES = """p AS (SELECT doc_id, text, string_split(text, '{t}') AS w FROM documents),
    e AS (SELECT doc_id, strlen(text) AS size, unnest(w) AS record, unnest(range(0, len(w))) AS n FROM p),
    l AS (SELECT doc_id, size, CAST(coalesce(sum(strlen(record) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", record FROM e)"""
_NEWLINE = _LINES.replace("'{t}'", "chr(10)")
_ZIP = "a AS (SELECT source || '-' || CAST(doc_id // 100 AS VARCHAR) AS blob_key, doc_id, text, row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) - 1 AS file_index FROM documents)"
_PACK = """m AS (SELECT blob_key, file_index, strlen(text) AS size, count(*) OVER (PARTITION BY blob_key) AS files, {target} AS target FROM a),
    g(blob_key, i, first, held, closed, files) AS (
        SELECT blob_key, 0, 0, size, size >= target, files FROM m WHERE file_index = 0
        UNION ALL SELECT m.blob_key, g.i + 1, CASE WHEN g.closed THEN g.i + 1 ELSE g.first END, CASE WHEN g.closed THEN m.size ELSE g.held + m.size END,
            CASE WHEN g.closed THEN m.size ELSE g.held + m.size END >= m.target, g.files FROM g JOIN m ON m.blob_key = g.blob_key AND m.file_index = g.i + 1),
    r AS (SELECT blob_key, first AS first_file, i + 1 AS end_file FROM g WHERE closed OR (i = files - 1 AND held > 0))"""

ORACLE = {
    "blob_lines": f'WITH {_NEWLINE} SELECT doc_id, "offset", record AS line FROM l WHERE "offset" < size',
    "blob_lines_sharded": f"""WITH {_NEWLINE}, c AS (SELECT doc_id, size // 4 AS chunk, "offset" AS o FROM l WHERE "offset" < size)
        SELECT doc_id, CAST(CASE WHEN o = 0 THEN 0 WHEN chunk = 0 THEN 3 ELSE least(3, greatest(CAST(ceil(o / CAST(chunk AS DOUBLE)) AS INT) - 1, 0)) END AS INT) AS shard, count(*) AS n FROM c GROUP BY 1, 2""",
    "blob_records": f'WITH {_LINES.format(t=".")} SELECT doc_id, "offset", record FROM l WHERE "offset" < size',
    "blob_info": "SELECT doc_id, strlen(text) AS size FROM documents",
    "zip_files": f"WITH {_ZIP} SELECT blob_key, file_index, CAST(doc_id AS VARCHAR) || '.txt' AS filename, strlen(text) AS file_size, md5(text) AS body_md5 FROM a",
    "zip_lines": f"""WITH {_ZIP}, {_NEWLINE} SELECT blob_key, file_index, "offset" AS byte_offset, record AS line FROM l JOIN a USING (doc_id) WHERE "offset" < size""",
    "split_zip": f"""WITH RECURSIVE {_ZIP}, {_PACK.format(target="sum(strlen(text)) OVER (PARTITION BY blob_key) // 4")}
        SELECT blob_key, row_number() OVER (PARTITION BY blob_key ORDER BY first_file) - 1 AS shard, first_file, end_file FROM r""",
    "split_zip_lines": f"WITH RECURSIVE {_ZIP}, {_PACK.format(target='sum(strlen(text)) OVER () // 64')} SELECT blob_key, first_file, end_file FROM r",
}
