"""Sliced scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.sources import hadoop
from millrace.sources.shared import shared_dir
from millrace.sources.tables import table
from millrace.streaming.slices import finish, run_slices, write_slice


def slices(s: SparkSession, d: str) -> DataFrame:
    """Events scanned in five slices of their keys, each written on its own; what was written."""
    events = table(s, d, "events").select("event_id", "event_type", "user_id")
    bounds = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    base = shared_dir(s)
    low, high = (bounds["low"], bounds["high"] + 1) if bounds["low"] is not None else (0, 0)
    finish(run_slices(events, "event_id", low, high, max(1, -(-(high - low) // 5)), write_slice(f"{base}/slices"), f"{base}/checkpoint"))
    return s.read.schema(events.schema).parquet(f"{base}/slices/slice=*") if high > low else events


def sink_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Written as Parquet by the commit protocol and read back."""
    path = f"{shared_dir(s)}/orders"
    table(s, d, "orders").write.parquet(path)
    return s.read.parquet(path)


def sink_noop(s: SparkSession, d: str) -> DataFrame:
    """Rows that a sink which keeps nothing was given, counted as they passed."""
    seen = Observation("written")
    table(s, d, "orders").observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(seen.get["n"],)], "written long")


def seqfile_sort(s: SparkSession, d: str) -> DataFrame:
    """Orders through a file of keys and values in Hadoop's sequence format, sorted by key."""
    path = f"{shared_dir(s)}/orders.seq"
    hadoop.write_sequence(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", path)
    return hadoop.read_sequence(s, path, "o_orderkey long, o_orderstatus string").orderBy("o_orderkey")


QUERIES = {f.__name__: f for f in (slices, sink_roundtrip, sink_noop, seqfile_sort)}

ORACLE = {
    "slices": "SELECT event_id, event_type, user_id FROM events",
    "sink_roundtrip": "SELECT * FROM orders",
    "sink_noop": "SELECT count(*) AS written FROM orders",
    "seqfile_sort": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey",
}
