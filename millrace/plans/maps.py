"""Maps, counters and mutations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import context, counters, mutations, operations
from millrace.operators.mapper import Mapper, run_mapper
from millrace.sources import pools
from millrace.sources.shared import shared_dir
from millrace.sources.tables import table


def map_lower(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", F.lower("c_name").alias("c_name"), F.lower("c_mktsegment").alias("c_mktsegment"))


def map_upper(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", F.upper("c_name").alias("c_name"), F.upper("c_mktsegment").alias("c_mktsegment"))


def flat_map_ops(s: SparkSession, d: str) -> DataFrame:
    """Each order yields two operations, in order: a put of its customer and a counter by status."""
    op = lambda seq, kind, key, amount: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("op"), key.cast("string").alias("target"), amount.cast("long").alias("amount"))
    ops = F.inline(F.array(op(0, "put", F.col("o_custkey"), F.col("o_orderkey")), op(1, "increment", F.col("o_orderstatus"), F.lit(1))))
    return table(s, d, "orders").select("o_orderkey", ops)


class _Totals(Mapper):
    """Number and sum of the keys that a task has seen, given out as it ends."""

    def task_setup(self) -> None:
        self.n = self.total = 0

    def map_batch(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.n += batch.num_rows
        self.total += pc.sum(batch.column(0)).as_py() or 0
        return iter(())

    def task_cleanup(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"n": [self.n], "total": [self.total]})


def mapper_lifecycle(s: SparkSession, d: str) -> DataFrame:
    parts = run_mapper(table(s, d, "orders").select("o_orderkey"), _Totals, "n long, total long")
    return parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def counters_by_name(s: SparkSession, d: str) -> DataFrame:
    return counters.by_name(table(s, d, "events"), F.col("event_type").alias("name"))


def counters_by_group(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "events")
    pairs = counters.by_name(df, F.lit("event").alias("counter_group"), F.col("event_type").alias("name"))
    users = counters.by_name(df, F.lit("user").alias("counter_group"), (F.col("user_id") % 10).cast("string").alias("name"), delta=F.col("event_id"))
    return pairs.unionByName(users)


def counters_skub(s: SparkSession, d: str) -> DataFrame:
    """Votes by a property that some rows lack: those count for neither side."""
    k = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("long"))
    votes = table(s, d, "events").select(k.alias("k")).where("k IS NOT NULL")
    return counters.by_name(votes, F.lit("Skub").alias("counter_group"), F.when(F.col("k") % 2 == 0, "Pro").otherwise("Anti").alias("name"))


def counters_add_sub(s: SparkSession, d: str) -> DataFrame:
    """Counters of users with even and with odd numbers, added and subtracted by name; the latter have no counter called view."""
    df = table(s, d, "events")
    as_map = lambda: F.map_from_entries(F.collect_list(F.struct("name", "value")))
    a = counters.by_name(df.where("user_id % 2 = 0"), F.col("event_type").alias("name")).agg(as_map().alias("a"))
    b = counters.by_name(df.where("user_id % 2 = 1 AND event_type <> 'view'"), F.col("event_type").alias("name")).agg(as_map().alias("b"))
    both = a.crossJoin(b).select(F.map_zip_with(counters.add_maps(F.col("a"), F.col("b")), counters.sub_maps(F.col("a"), F.col("b")), lambda _, x, y: F.struct(x.alias("added"), y.alias("subtracted"))).alias("m"))
    return both.select(F.explode("m").alias("name", "v")).select("name", "v.added", "v.subtracted")


def job_counters(s: SparkSession, d: str) -> DataFrame:
    """Shards' counters, then the job's: calls of the mapper and events by type."""
    shard = table(s, d, "events").select((F.col("user_id") % 8).alias("shard"), F.explode(F.array(F.lit("mapper_calls"), F.concat(F.lit("event."), "event_type"))).alias("name"))
    return counters.by_name(counters.by_name(shard, "shard", "name"), "name", delta=F.col("value"))


def processed_per_shard(s: SparkSession, d: str) -> DataFrame:
    per = counters.by_name(table(s, d, "events"), (F.col("user_id") % 8).alias("shard")).withColumnRenamed("value", "processed")
    every = per.agg(F.max("processed").alias("most"), F.sum("processed").alias("total"))
    return per.crossJoin(F.broadcast(every)).select("shard", "processed", "most", "total")


def _ops(s: SparkSession, d: str) -> DataFrame:
    """Every order puts its customer with the order's price as balance, customers of no account yet included; debtors are deleted.

    Deletes come first by seq, an order's key is its put's.
    """
    c = table(s, d, "customer")
    o = table(s, d, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderstatus").alias("c_mktsegment"))
    puts = o.select(F.lit("put").alias("op"), "seq", "c_custkey", F.concat(F.lit("order "), F.col("seq").cast("string")).alias("c_name"), F.lit(0).alias("c_nationkey"), "c_acctbal", "c_mktsegment")
    return puts.unionByName(c.where("c_acctbal < 0").select(F.lit("delete").alias("op"), F.lit(-1).cast("long").alias("seq"), *c.columns))


def op_put(s: SparkSession, d: str) -> DataFrame:
    """Upserts, applied twice: putting again what was put changes nothing."""
    puts = _ops(s, d).where("op = 'put'").drop("op")
    return mutations.put(mutations.put(table(s, d, "customer"), puts, ["c_custkey"], "seq"), puts, ["c_custkey"], "seq")


def op_delete(s: SparkSession, d: str) -> DataFrame:
    return mutations.delete(table(s, d, "customer"), _ops(s, d).where("op = 'delete'"), ["c_custkey"])


def op_put_delete(s: SparkSession, d: str) -> DataFrame:
    return mutations.apply_pool(table(s, d, "customer"), _ops(s, d), ["c_custkey"])


def op_last_wins(s: SparkSession, d: str) -> DataFrame:
    """The ordered form: deletes come first by seq, so later puts bring their keys back."""
    return mutations.apply_pool(table(s, d, "customer"), _ops(s, d), ["c_custkey"], ordered=True)


def pool_sink(s: SparkSession, d: str) -> DataFrame:
    """op_put_delete with its operations written through pools into a sink of mutations, and read from there."""
    ops = _ops(s, d)
    columns = [c for c in ops.columns if c not in ("op", "seq")]
    path = shared_dir(s)
    pools.write_mutations(ops.select("op", "seq", F.to_json(F.struct("c_custkey")).alias("key"), F.to_json(F.struct(*columns)).alias("payload")), path, count=100)
    row = F.from_json("payload", ops.select(*columns).schema)
    return mutations.apply_pool(table(s, d, "customer"), pools.read_mutations(s, path).select("op", "seq", row.alias("r")).select("op", "seq", "r.*"), ["c_custkey"])


class _Kinds:
    """A pool of a handler's own: amounts by kind, given out as counters when it is flushed."""

    def __init__(self) -> None:
        self.held: dict[str, int] = {}

    def add(self, kind: str, amount: int) -> None:
        self.held[kind] = self.held.get(kind, 0) + amount

    def flush(self) -> list[operations.Increment]:
        out, self.held = [operations.Increment(f"user.{k}", n) for k, n in self.held.items()], {}
        return out


def _count_event(row: dict) -> None:
    """Counts by the context of its task, and in a pool that it registers there."""
    task = context.current()
    if task.pool("kinds") is None:
        task.register("kinds", _Kinds())
    task.increment(f"event.{row['event_type']}")
    task.pool("kinds").add(task.params["prefix"] + row["event_type"], row["user_id"])


def handler_context(s: SparkSession, d: str) -> DataFrame:
    done = operations.run_handler(table(s, d, "events").select("event_type", "user_id"), _count_event, {"prefix": "of "})
    return operations.counters(done)


def pool_batches(s: SparkSession, d: str) -> DataFrame:
    """Flushes of each customer's orders, ten at a time, by both rules; the figure of a flush is the same in both."""
    each = table(s, d, "orders").select("o_custkey", "o_orderkey", mutations.flush_number(F.col("o_orderkey"), 10, True, ["o_custkey"]).alias("before"), mutations.flush_number(F.col("o_orderkey"), 4, False, ["o_custkey"]).alias("after"))
    return each


def delete_all_in_range(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where("NOT (o_orderkey >= 1000 AND o_orderkey < 5000)").select("o_orderkey", "o_custkey")


def put_if_absent(s: SparkSession, d: str) -> DataFrame:
    """Keys that orders name and no customer has."""
    named = table(s, d, "orders").select((F.col("o_custkey") * 2).alias("c_custkey")).distinct()
    return mutations.put_if_absent(table(s, d, "customer"), named, ["c_custkey"])


def multi_get(s: SparkSession, d: str) -> DataFrame:
    wanted = table(s, d, "orders").select((F.col("o_custkey") * 2).alias("c_custkey")).distinct()
    return mutations.multi_get(wanted, table(s, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])


QUERIES = {f.__name__: f for f in (map_lower, map_upper, flat_map_ops, mapper_lifecycle, counters_by_name, counters_by_group, counters_skub, counters_add_sub, job_counters, processed_per_shard, op_put, op_delete, op_put_delete, op_last_wins, pool_sink, handler_context, pool_batches, delete_all_in_range, put_if_absent, multi_get)}

_PUTS = """puts AS (SELECT o_custkey * 2 AS c_custkey, 'order ' || CAST(max(o_orderkey) AS VARCHAR) AS c_name, 0 AS c_nationkey, arg_max(o_totalprice, o_orderkey) AS c_acctbal, arg_max(o_orderstatus, o_orderkey) AS c_mktsegment FROM orders GROUP BY 1),
    dels AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
    put AS (SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM puts) UNION ALL SELECT * FROM puts)"""

ORACLE = {
    "map_lower": "SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer",
    "map_upper": "SELECT c_custkey, upper(c_name) AS c_name, upper(c_mktsegment) AS c_mktsegment FROM customer",
    "flat_map_ops": "SELECT o_orderkey, 0 AS seq, 'put' AS op, CAST(o_custkey AS VARCHAR) AS target, o_orderkey AS amount FROM orders UNION ALL SELECT o_orderkey, 1, 'increment', o_orderstatus, 1 FROM orders",
    "mapper_lifecycle": "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders",
    "counters_by_name": "SELECT event_type AS name, count(*) AS value FROM events GROUP BY 1",
    "counters_by_group": "SELECT 'event' AS counter_group, event_type AS name, count(*) AS value FROM events GROUP BY 2 UNION ALL SELECT 'user', CAST(user_id % 10 AS VARCHAR), CAST(sum(event_id) AS BIGINT) FROM events GROUP BY 2",
    "counters_skub": "SELECT 'Skub' AS counter_group, CASE WHEN k % 2 = 0 THEN 'Pro' ELSE 'Anti' END AS name, count(*) AS value FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error') WHERE k IS NOT NULL GROUP BY 2",
    "counters_add_sub": """WITH a AS (SELECT event_type AS name, count(*) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS name, count(*) AS v FROM events WHERE user_id % 2 = 1 AND event_type <> 'view' GROUP BY 1)
        SELECT name, coalesce(a.v, 0) + coalesce(b.v, 0) AS added, coalesce(a.v, 0) - coalesce(b.v, 0) AS subtracted FROM a FULL JOIN b USING (name)""",
    "job_counters": "SELECT 'mapper_calls' AS name, count(*) AS value FROM events UNION ALL SELECT 'event.' || event_type, count(*) FROM events GROUP BY 1",
    "processed_per_shard": "SELECT shard, processed, max(processed) OVER () AS most, CAST(sum(processed) OVER () AS BIGINT) AS total FROM (SELECT user_id % 8 AS shard, count(*) AS processed FROM events GROUP BY 1)",
    "op_put": f"WITH {_PUTS} SELECT * FROM put",
    "op_delete": f"WITH {_PUTS} SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM dels)",
    "op_put_delete": f"WITH {_PUTS} SELECT * FROM put WHERE c_custkey NOT IN (SELECT c_custkey FROM dels)",
    "pool_sink": f"WITH {_PUTS} SELECT * FROM put WHERE c_custkey NOT IN (SELECT c_custkey FROM dels)",
    "handler_context": """SELECT 'mapper_calls' AS name, count(*) AS value FROM events UNION ALL SELECT 'event.' || event_type, count(*) FROM events GROUP BY 1
        UNION ALL SELECT 'user.of ' || event_type, CAST(sum(user_id) AS BIGINT) FROM events GROUP BY 1""",
    "op_last_wins": f"WITH {_PUTS} SELECT * FROM put WHERE c_custkey NOT IN (SELECT c_custkey FROM dels WHERE c_custkey NOT IN (SELECT c_custkey FROM puts))",
    "pool_batches": 'SELECT o_custkey, o_orderkey, (row_number() OVER w - 1) // 10 AS "before", (row_number() OVER w - 1) // 4 AS "after" FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)',
    "delete_all_in_range": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderkey >= 1000 AND o_orderkey < 5000)",
    "put_if_absent": "SELECT DISTINCT o_custkey * 2 AS c_custkey FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)",
    "multi_get": "SELECT w.c_custkey, c.c_name FROM (SELECT DISTINCT o_custkey * 2 AS c_custkey FROM orders) w LEFT JOIN customer c ON c.c_custkey = w.c_custkey",
}
