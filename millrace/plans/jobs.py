"""Job control as queries: roll-ups, lists, shard details and quotas, over orders as shards of their customers' jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import encode
from millrace.operators import order, status
from millrace.sources.tables import table


def _shards(s: SparkSession, d: str) -> DataFrame:
    """Orders as shards: open ones active, finished ones successful, pending ones failed; every tenth job is to abort, every eleventh misses a shard."""
    state = F.when(F.col("o_orderstatus") == "O", status.ACTIVE).when(F.col("o_orderstatus") == "F", status.SUCCESS).otherwise(status.FAILED)
    n = F.count(F.lit(1)).over(Window.partitionBy("job"))
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("job"), "o_orderkey", state.alias("state"))
    return rows.select("*", (n + F.when(F.col("job") % 11 == 0, 1).otherwise(0)).alias("expected"), (F.col("job") % 10 == 0).alias("abort"))


def job_rollup(s: SparkSession, d: str) -> DataFrame:
    return status.roll_up(_shards(s, d), "job", "state", "expected", "abort")


def job_rollup_strict(s: SparkSession, d: str) -> DataFrame:
    return status.roll_up_strict(_shards(s, d), "job", "state")


def _jobs(s: SparkSession, d: str) -> DataFrame:
    """Orders as jobs under keys that put newer ones first."""
    key = encode.descending_key(F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000000), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return table(s, d, "orders").select(key.alias("job_key"), "o_orderkey", "o_orderstatus")


def job_list_page(s: SparkSession, d: str) -> DataFrame:
    """The second page of fifty jobs, newest first, from the cursor that the first page gives."""
    jobs = _jobs(s, d)
    cursor = order.cursor_of(order.page(jobs, "job_key"), "job_key")
    following = jobs.join(F.broadcast(cursor), F.col("job_key") >= F.col("cursor")).drop("cursor")
    return following.orderBy("job_key").limit(50)


def job_shards(s: SparkSession, d: str) -> DataFrame:
    """Shards of every job, numbered and named."""
    number = (F.row_number().over(Window.partitionBy("job").orderBy("o_orderkey")) - 1).cast("long")
    return _shards(s, d).select("job", number.alias("shard_number"), encode.shard_id(F.concat(F.lit("job-"), F.col("job").cast("string")), number).alias("shard_id"), "state")


def quota_admit(s: SparkSession, d: str) -> DataFrame:
    """Rows of each shard that a quota of 40 lets through, in key order."""
    place = F.row_number().over(Window.partitionBy("shard").orderBy("event_id"))
    rows = table(s, d, "events").select((F.col("user_id") % 8).alias("shard"), "event_id")
    return rows.withColumn("place", place).where("place <= 40").select("shard", "event_id")


def quota_refill(s: SparkSession, d: str) -> DataFrame:
    """Quota due by either rule for jobs that are the event types, over the time their events span."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    jobs = table(s, d, "events").groupBy("event_type").agg(F.countDistinct(F.col("user_id") % 8).alias("active"), F.floor((F.max(micros) - F.min(micros)) / 1000).cast("long").alias("ms"))
    return jobs.select("event_type", status.refill(F.lit(100), F.floor(F.col("ms") / 1000), F.col("active")).alias("quota"), status.refill_whole(F.lit(1000), F.col("ms"), F.col("active")).alias("whole"), status.refill_whole(F.lit(1000), F.lit(None).cast("long"), F.col("active")).alias("first_tick"))


QUERIES = {f.__name__: f for f in (job_rollup, job_rollup_strict, job_list_page, job_shards, quota_admit, quota_refill)}

_STATE = "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'success' ELSE 'failed' END"
_COUNTS = f"""s AS (SELECT o_custkey AS job, o_orderkey, {_STATE} AS state FROM orders),
    c AS (SELECT job, count(*) AS shards, count(*) FILTER (state = 'active') AS active_shards, count(*) FILTER (state = 'failed') AS failed_shards, 0::BIGINT AS aborted_shards, count(*) FILTER (state = 'success') AS success_shards FROM s GROUP BY 1)"""

ORACLE = {
    "job_rollup": f"WITH {_COUNTS} SELECT *, CASE WHEN job % 11 = 0 THEN 'failed' WHEN active_shards > 0 THEN 'active' WHEN job % 10 = 0 THEN 'aborted' WHEN success_shards < shards THEN 'failed' ELSE 'success' END AS status FROM c",
    "job_rollup_strict": f"WITH {_COUNTS}, t AS (SELECT *, CASE WHEN failed_shards > 0 THEN 'error' WHEN active_shards = 0 THEN 'done' ELSE 'active' END AS status FROM c) SELECT *, CASE WHEN status = 'active' THEN shards ELSE 0 END AS kept_shards FROM t",
    "job_list_page": "SELECT CAST((17179869184 - epoch_us(o_orderdate) // 1000000) * 100 AS VARCHAR) || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS job_key, o_orderkey, o_orderstatus FROM orders ORDER BY job_key LIMIT 50 OFFSET 50",
    "job_shards": f"WITH {_COUNTS}, n AS (SELECT job, row_number() OVER (PARTITION BY job ORDER BY o_orderkey) - 1 AS shard_number, state FROM s) SELECT job, shard_number, 'job-' || CAST(job AS VARCHAR) || '-' || CAST(shard_number AS VARCHAR) AS shard_id, state FROM n",
    "quota_admit": "SELECT user_id % 8 AS shard, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) <= 40",
    "quota_refill": """WITH j AS (SELECT event_type, count(DISTINCT user_id % 8) AS active, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM events GROUP BY 1)
        SELECT event_type, CASE WHEN ms // 1000 < 1 THEN 0 ELSE CAST(ceil(100 * (ms // 1000) / CAST(active AS DOUBLE)) AS BIGINT) END AS quota, ms // active AS whole, 1000 // active AS first_tick FROM j""",
}
