"""Scalar functions of keys, names and durations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions import encode
from millrace.functions.keyspace import bisect, split_strings as spread
from millrace.operators import counters
from millrace.sources.tables import table


def hex_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", encode.hex_key(F.col("p_name")).alias("key"))


def parse_raw_key(s: SparkSession, d: str) -> DataFrame:
    """Back from the raw name of a shuffle block to its key, and null from a name that is none."""
    raw = encode.raw_key(F.lit("job"), F.concat(F.col("p_brand"), F.lit("_"), F.col("p_name")), F.col("p_size"))
    return table(s, d, "part").select("p_partkey", raw.alias("raw"), encode.parse_raw_key(raw).alias("key"), encode.parse_raw_key(F.col("p_name")).alias("none"))


def parse_bool(s: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(x) for x in ("True", "1", "yes", "t", "ON", "false", "0", "no", "")]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", encode.parse_bool(text).alias("flag"))


def short_name(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", encode.short_name(F.concat_ws(".", F.lit("parts"), "p_brand", "p_name")).alias("name"))


def shard_id(s: SparkSession, d: str) -> DataFrame:
    name = encode.shard_id(F.concat(F.lit("job-"), F.col("o_custkey").cast("string")), F.col("o_orderkey") % 16)
    return table(s, d, "orders").select("o_orderkey", name.alias("shard_id"), encode.shard_number(name).alias("number"))


def descending_key(s: SparkSession, d: str) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return table(s, d, "events").select("event_id", encode.descending_key(seconds, F.col("user_id") % 101).alias("key"))


def task_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", encode.task_name(F.concat_ws("_", F.lit("attempt"), F.col("o_custkey").cast("string"), F.lit("m")), F.col("o_orderkey") % 16).alias("name"))


def last_work_item(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", encode.last_work_item(F.col("text")).alias("item"))


def json_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """props parsed and written again with sorted keys."""
    parsed = F.from_json("props", "k long")
    return table(s, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("event_id"), parsed["k"].alias("k"))).alias("json"))


@F.pandas_udf(ArrayType(StringType()))
def _spread(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for low, high in pairs:
        yield pd.Series([spread(*sorted((a, b)), 3) if a != b else [] for a, b in zip(low, high, strict=True)])


@F.pandas_udf(StringType())
def _bisect(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for low, high in pairs:
        yield pd.Series([bisect(*sorted((a, b))) for a, b in zip(low, high, strict=True)])


def split_strings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", _spread("p_name", "p_type").alias("cuts"))


def bisect_strings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", _bisect("p_name", "p_type").alias("middle"))


def _span(s: SparkSession, d: str) -> DataFrame:
    """Events of each type and the milliseconds from the first to the last."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    by = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(micros).alias("first"), F.max(micros).alias("last"))
    return by.select("event_type", "n", F.floor((F.col("last") - F.col("first")) / 1000).cast("long").alias("ms"))


def counter_rates(s: SparkSession, d: str) -> DataFrame:
    return _span(s, d).select("event_type", encode.rate(F.col("n"), F.col("ms")).alias("rate"))


def elapsed_string(s: SparkSession, d: str) -> DataFrame:
    return _span(s, d).select("event_type", encode.elapsed(F.col("ms")).alias("elapsed"))


def chart_encode(s: SparkSession, d: str) -> DataFrame:
    """Events of each shard on an axis from 0 to a twentieth above the largest."""
    per = counters.by_name(table(s, d, "events"), (F.col("user_id") % 8).alias("shard"))
    bars = per.agg(F.array_sort(F.collect_list(F.struct("shard", "value"))).alias("bars"), F.max("value").alias("most"))
    values = F.transform("bars", lambda b: b["value"].cast("double"))
    return bars.select(encode.chart_codes(values, F.col("most") * 1.05).alias("simple"), encode.chart_codes_enhanced(values, F.col("most") * 1.05).alias("enhanced"))


QUERIES = {f.__name__: f for f in (hex_key, parse_raw_key, parse_bool, short_name, shard_id, descending_key, task_names, last_work_item, json_roundtrip, split_strings, bisect_strings, counter_rates, elapsed_string, chart_encode)}

_SPAN = "WITH e AS (SELECT event_type, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM events GROUP BY 1), t AS (SELECT event_type, n, ms, ms // 1000 AS s FROM e)"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-.'"

ORACLE = {
    "hex_key": "SELECT p_partkey, hex(encode(p_name)) AS key FROM part",
    "parse_raw_key": "SELECT p_partkey, 'job_' || p_brand || '_' || p_name || '_' || CAST(p_size AS VARCHAR) AS raw, p_brand || '_' || p_name AS key, CAST(NULL AS VARCHAR) AS none FROM part",
    "parse_bool": "SELECT o_orderkey, o_orderkey % 9 < 5 AS flag FROM orders",
    "short_name": "SELECT p_partkey, split_part('parts.' || p_brand || '.' || p_name, '.', -1) AS name FROM part",
    "shard_id": "SELECT o_orderkey, 'job-' || CAST(o_custkey AS VARCHAR) || '-' || CAST(o_orderkey % 16 AS VARCHAR) AS shard_id, CAST(o_orderkey % 16 AS INT) AS number FROM orders",
    "descending_key": "SELECT event_id, CAST((17179869184 - epoch_us(ts) // 1000000) * 100 AS VARCHAR) || CAST(user_id % 101 AS VARCHAR) AS key FROM events",
    "task_names": "SELECT o_orderkey, 'worker-attempt-' || CAST(o_custkey AS VARCHAR) || '-m--' || CAST(o_orderkey % 16 AS VARCHAR) AS name FROM orders",
    "last_work_item": "SELECT doc_id, substring(text, 1, 100) AS item FROM documents",
    "json_roundtrip": "SELECT event_id, '{\"event_id\":' || CAST(event_id AS VARCHAR) || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events",
    "counter_rates": f"{_SPAN} SELECT event_type, CASE WHEN ms > 0 THEN floor(n * 100000.0::DOUBLE / ms + 0.5) / 100 END AS rate FROM t",
    "elapsed_string": f"""{_SPAN} SELECT event_type, CASE WHEN s // 86400 = 1 THEN '1 day, ' WHEN s // 86400 > 1 THEN CAST(s // 86400 AS VARCHAR) || ' days, ' ELSE '' END
        || lpad(CAST(s % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed FROM t""",
    "chart_encode": f"""WITH p AS (SELECT user_id % 8 AS shard, count(*) AS n FROM events GROUP BY 1), m AS (SELECT shard, n, max(n) OVER () * 1.05::DOUBLE AS top FROM p),
        c AS (SELECT shard, CAST(floor(n * (61.0::DOUBLE / top) + 0.5) AS INT) AS a, CAST(floor(n * (4095.0::DOUBLE / top) + 0.5) AS INT) AS b FROM m)
        SELECT 's:' || string_agg(substr({_LETTERS}, a + 1, 1), '' ORDER BY shard) AS simple, 'e:' || string_agg(substr({_LETTERS}, b // 64 + 1, 1) || substr({_LETTERS}, b % 64 + 1, 1), '' ORDER BY shard) AS enhanced FROM c""",
}
