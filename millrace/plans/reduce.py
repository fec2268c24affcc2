"""Group-by-key queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import encode
from millrace.operators import order, reduce
from millrace.sources.tables import table


def word_count(s: SparkSession, d: str) -> DataFrame:
    """Number of occurrences of each white-space separated word of documents.text."""
    words = table(s, d, "documents").select(F.explode(F.split("text", "[ \t\r\n]+")).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy("word")


def reduce_values(s: SparkSession, d: str) -> DataFrame:
    """The parts of each order, in order, as text."""
    lists = reduce.group_values(table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey", "l_partkey", "l_linenumber", "l_partkey")
    return lists.select("l_orderkey", F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))).alias("part_keys"), F.size("values").cast("long").alias("n"))


def reduce_sum(s: SparkSession, d: str) -> DataFrame:
    """Prices as decimals, so that the order of addition doesn't matter."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = table(s, d, "lineitem").select("l_partkey", price.alias("price"), F.col("l_quantity").cast("long").alias("quantity"))
    total = F.sum("price").cast("decimal(38,2)").cast("string").alias("total")
    return reduce.reduce_columns(rows, ["l_partkey"], total, F.count(F.lit(1)).alias("n"), F.min("quantity").alias("least"), F.max("quantity").alias("most"))


def reduce_multi_emit(s: SparkSession, d: str) -> DataFrame:
    """The three dearest orders of each customer: group limits are applied before the shuffle too."""
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    placed = table(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(best).alias("place")).where("place <= 3")
    return placed.withColumn("place", F.col("place").cast("long"))


def reduce_order_text(s: SparkSession, d: str) -> DataFrame:
    """Text keys in the order in which a shuffle by raw key names delivers them."""
    keys = table(s, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).withColumn("sort_key", F.concat("p_name", F.lit("_")))
    return order.rank_rows(keys, F.col("sort_key")).select("rank", "p_name", "n")


def reduce_order_long(s: SparkSession, d: str) -> DataFrame:
    """Long keys by their encoding: numbers from 0 on, then negative ones by magnitude."""
    keys = table(s, d, "orders").groupBy((F.col("o_custkey") - 500).alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("sort_key", encode.long_key(F.col("key")))
    return order.rank_rows(keys, F.col("sort_key")).select("rank", "key", "sort_key", "n")


def output_key_range(s: SparkSession, d: str) -> DataFrame:
    return reduce.key_range(table(s, d, "part").select((F.col("p_partkey") % 8).alias("shard"), "p_name"), "p_name", "shard")


def reduce_side_join(s: SparkSession, d: str) -> DataFrame:
    """Customers and their orders as tagged values of one key."""
    names = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(None).cast("long").alias("order_key"))
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.lit(None).cast("string").alias("name"), F.col("o_orderkey").alias("order_key"))
    return reduce.reduce_columns(names.unionByName(orders), ["key"], F.max("name").alias("name"), F.count("order_key").alias("orders"), F.max("order_key").alias("last_order"))


QUERIES = {f.__name__: f for f in (word_count, reduce_values, reduce_sum, reduce_multi_emit, reduce_order_text, reduce_order_long, output_key_range, reduce_side_join)}

#: long_key in SQL: thirteen base-36 digits by repeated division.
_DIGITS = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', 1 + CAST(abs(key) // {36**i} % 36 AS INT), 1)" for i in range(11, -1, -1))
_LONG_KEY = f"CASE WHEN key < 0 THEN '-' ELSE '+' END || '0' || {_DIGITS}"

ORACLE = {
    "word_count": """
        SELECT word, count(*) AS n
        FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\r\n]+')) AS word FROM documents)
        WHERE word <> '' GROUP BY word ORDER BY word""",
    "reduce_values": "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS part_keys, count(*) AS n FROM lineitem GROUP BY 1",
    "reduce_sum": "SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR) AS total, count(*) AS n, min(CAST(l_quantity AS BIGINT)) AS least, max(CAST(l_quantity AS BIGINT)) AS most FROM lineitem GROUP BY 1",
    "reduce_multi_emit": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3",
    "reduce_order_text": "SELECT row_number() OVER (ORDER BY p_name || '_') AS rank, p_name, n FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)",
    "reduce_order_long": f"SELECT row_number() OVER (ORDER BY sort_key) AS rank, key, sort_key, n FROM (SELECT key, {_LONG_KEY} AS sort_key, n FROM (SELECT o_custkey - 500 AS key, count(*) AS n FROM orders GROUP BY 1))",
    "output_key_range": "SELECT shard, min(p_name) AS min_key, max(p_name) AS max_key FROM (SELECT p_partkey % 8 AS shard, p_name FROM part) GROUP BY ROLLUP (shard)",
    "reduce_side_join": "SELECT key, c_name AS name, coalesce(n, 0) AS orders, last_order FROM (SELECT c_custkey AS key, c_name FROM customer) FULL JOIN (SELECT o_custkey AS key, count(*) AS n, max(o_orderkey) AS last_order FROM orders GROUP BY 1) USING (key)",
}
