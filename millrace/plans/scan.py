"""Scans: whole tables, keys, key ranges, namespaces, snapshots, extremes and numeric ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keyspace import KeyRange
from millrace.operators import splits
from millrace.sources.ranges import numbers
from millrace.sources.tables import consistent_keys, table


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ds_scan(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer")


def ds_scan_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey")


def ds_scan_entity(s: SparkSession, d: str) -> DataFrame:
    """Each property of each entity as a row of its own."""
    return table(s, d, "nation").unpivot(["n_nationkey"], [F.col("n_name"), F.col("n_regionkey").cast("string").alias("n_regionkey")], "prop", "value").withColumnRenamed("n_nationkey", "key")


_BOUNDS = {"[]": (True, True), "[)": (True, False), "(]": (False, True), "()": (False, False)}


def ds_key_range(s: SparkSession, d: str) -> DataFrame:
    df, key = table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey")
    return _union([df.where(KeyRange(100, 120, a, b).predicate(key)).select(F.lit(name).alias("bounds"), "*") for name, (a, b) in _BOUNDS.items()])


def ds_scan_range(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where(KeyRange(500, 900).predicate(F.col("o_orderkey"))).select("o_orderkey", "o_custkey", "o_orderstatus")


def ds_resume(s: SparkSession, d: str) -> DataFrame:
    """What a scan of [500, 900) has left after key 700."""
    return table(s, d, "orders").where(KeyRange(500, 900).after(700).predicate(F.col("o_orderkey"))).select("o_orderkey", "o_custkey", "o_orderstatus")


def ds_multi_ns(s: SparkSession, d: str) -> DataFrame:
    """One key range of each of two namespaces: the filter on names prunes partitions where the table has them."""
    df = table(s, d, "events").select("event_id", "event_type", "user_id")
    ranges = [KeyRange(100, 300, namespace="click"), KeyRange(200, 500, False, True, namespace="view")]
    return df.where(F.col("event_type").isin("click", "view") & reduce(lambda a, b: a | b, [r.predicate(F.col("event_id"), F.col("event_type")) for r in ranges]))


def ds_namespaces(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("ns")).distinct().orderBy("ns")


_T0, _START = 300, 700


def ds_scan_consistent(s: SparkSession, d: str) -> DataFrame:
    """Keys of a base table with all writes logged before a start time rolled forward."""
    events = table(s, d, "events").select("event_id", "user_id")
    return consistent_keys(events.where(F.col("event_id") < _T0).select("user_id"), events.where(F.col("event_id") >= _T0), "user_id", "event_id", _START)


def ds_min_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").agg(F.min("o_orderkey").alias("min_key"))


def ds_max_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").agg(F.max("o_orderkey").alias("max_key"))


def ds_key_desc(s: SparkSession, d: str) -> DataFrame:
    """The hundred greatest keys, a top-k; the greatest key is known by then, but ranks are counted, as keys may have gaps."""
    from pyspark.sql import Window

    top = table(s, d, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_orderkey"))).cast("long").alias("rank"))


def split_scatter(s: SparkSession, d: str) -> DataFrame:
    return splits.scatter_ranges(table(s, d, "orders"), "o_orderkey", 8)


def split_scatter_java(s: SparkSession, d: str) -> DataFrame:
    return splits.scatter_ranges_oversampled(table(s, d, "orders"), "o_orderkey", 4)


def split_round_robin(s: SparkSession, d: str) -> DataFrame:
    """Ranges of a hundred events dealt to eight shards, of which empty ones don't exist; the rows of each shard."""
    events = table(s, d, "events").select("event_id")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    ranges = [] if low is None else [(a, a + 100) for a in range(low // 100 * 100, high + 1, 100)]
    first = low // 100 if low is not None else 0
    dealt = splits.deal_ranges(ranges, 8)
    bounds = s.createDataFrame([((first + k) % 8, a, b) for k, part in enumerate(dealt) for a, b in part], "shard long, a long, b long")
    held = events.join(F.broadcast(bounds), F.floor(F.col("event_id") / 100) * 100 == F.col("a"))
    return held.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


_RANGES = [(0, 4, 2), (0, 3, 2), (0, 5, 5), (0, 5, 10), (0, 1, 3), (10, 1000, 7), (2147483651, 2147483655, 2)]


def split_range(s: SparkSession, d: str) -> DataFrame:
    cases = s.createDataFrame(_RANGES, "range_start long, range_end long, shards int")
    each = cases.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long"))).alias("i"))
    return each.withColumn("bound", splits.number_bounds(F.col("range_start"), F.col("range_end"), F.col("shards"), F.col("i")).cast("long"))


def split_bytes(s: SparkSession, d: str) -> DataFrame:
    """Four chunks of each document's bytes."""
    each = table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return each.select("doc_id", F.inline(splits.byte_bounds(F.col("size"), 4)))


def range_scan(s: SparkSession, d: str) -> DataFrame:
    return numbers(s, 10, 1010, 7)


QUERIES = {f.__name__: f for f in (ds_scan, ds_scan_keys, ds_scan_entity, ds_key_range, ds_scan_range, ds_resume, ds_multi_ns, ds_namespaces, ds_scan_consistent, ds_min_key, ds_max_key, ds_key_desc, split_scatter, split_scatter_java, split_round_robin, split_range, split_bytes, range_scan)}

_SCATTER = """WITH f AS (SELECT o_orderkey AS key FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT {n}),
    p AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS total FROM f),"""
_BOUND = "CASE WHEN i = shards THEN range_end ELSE range_start + CAST(floor(i * ((range_end - range_start) / CAST(shards AS DOUBLE)) + 0.5) AS BIGINT) END"

ORACLE = {
    "ds_scan": "SELECT * FROM customer",
    "ds_scan_keys": "SELECT c_custkey FROM customer",
    "ds_scan_entity": "SELECT n_nationkey AS key, 'n_name' AS prop, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation",
    "ds_key_range": " UNION ALL ".join(f"SELECT '{n}' AS bounds, o_orderkey, o_custkey FROM orders WHERE o_orderkey >{'=' * a} 100 AND o_orderkey <{'=' * b} 120" for n, (a, b) in _BOUNDS.items()),
    "ds_scan_range": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 900",
    "ds_resume": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 700 AND o_orderkey < 900",
    "ds_multi_ns": "SELECT event_id, event_type, user_id FROM events WHERE (event_type = 'click' AND event_id >= 100 AND event_id < 300) OR (event_type = 'view' AND event_id > 200 AND event_id <= 500)",
    "ds_namespaces": "SELECT DISTINCT event_type AS ns FROM events ORDER BY ns",
    "ds_scan_consistent": f"SELECT user_id FROM events WHERE event_id < {_T0} UNION SELECT user_id FROM events WHERE event_id >= {_T0} AND event_id < {_START}",
    "ds_min_key": "SELECT min(o_orderkey) AS min_key FROM orders",
    "ds_max_key": "SELECT max(o_orderkey) AS max_key FROM orders",
    "ds_key_desc": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS rank FROM orders ORDER BY o_orderkey DESC LIMIT 100",
    "split_scatter": f"""{_SCATTER.format(n=256)} c AS (SELECT i, key FROM p, range(0, 7) t(i) WHERE pos = CAST(floor(total * i / 7.0) AS BIGINT))
        SELECT 0 AS split, NULL AS range_start, min(key) AS range_end FROM c UNION ALL SELECT i + 1, key, lead(key) OVER (ORDER BY i) FROM c""",
    "split_scatter_java": f"""{_SCATTER.format(n=128)} c AS (SELECT i, key FROM p, range(1, 4) t(i) WHERE pos = i * greatest(1, total // 4))
        SELECT 0 AS split, (SELECT min(o_orderkey) FROM orders) AS range_start, min(key) AS range_end FROM c UNION ALL SELECT i, key, lead(key) OVER (ORDER BY i) FROM c""",
    "split_round_robin": "SELECT (event_id // 100) % 8 AS shard, count(*) AS n FROM events GROUP BY 1",
    "split_range": f"SELECT range_start, range_end, shards, i, {_BOUND} AS bound FROM (VALUES {', '.join(map(str, _RANGES))}) t(range_start, range_end, shards), unnest(range(0, shards + 1)) u(i)",
    "split_bytes": "SELECT doc_id, i, i * (strlen(text) // 4) AS chunk_start, CASE WHEN i = 3 THEN strlen(text) ELSE (i + 1) * (strlen(text) // 4) END AS chunk_end FROM documents, range(0, 4) t(i)",
    "range_scan": "SELECT v AS value, (SELECT max(i) FROM range(0, 7) s(i) WHERE v >= 10 + floor(i * (1000 / 7.0) + 0.5)) AS shard FROM range(10, 1010) t(v)",
}
