"""Handlers over rows, and the operations that they yield."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.context import Context
from millrace.operators.mapper import resolve
from millrace.operators.quota import Buckets, Consumer

#: One row for each operation: its shard, its place among the shard's operations, and what it does.
SCHEMA = "shard int, seq long, op string, name string, key string, payload string, delta long"
#: Counted before each call of the handler.
CALLS = "mapper_calls"
#: Name of the operation that carries a task's status text, as its payload.
STATUS = "status"


@dataclass(frozen=True)
class Put:
    """Upsert of a row: its key, and all of its columns."""

    key: object
    row: dict

    def record(self) -> tuple:
        return "put", None, json.dumps(self.key), json.dumps(self.row, default=str, sort_keys=True), None


@dataclass(frozen=True)
class Delete:
    key: object

    def record(self) -> tuple:
        return "delete", None, json.dumps(self.key), None, None


@dataclass(frozen=True)
class Increment:
    name: str
    delta: int = 1

    def record(self) -> tuple:
        return "increment", self.name, None, None, self.delta


@dataclass(frozen=True)
class _Status:
    text: str

    def record(self) -> tuple:
        return STATUS, None, None, self.text, None


class Pace:
    """Lets a task take so many rows a second: a bucket that fills by the rate, rounded up, and a consumer that waits for it."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if rate <= 0:
            raise ValueError(f"rate must be positive: {rate}")
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.buckets = Buckets()
        self.consumer = Consumer(self.buckets, "task", batch=1)
        self.began, self.filled = clock(), 0

    def take(self) -> None:
        while not self.consumer.consume():
            due = math.ceil(self.rate * (self.clock() - self.began)) - self.filled
            if due > 0:
                self.buckets.put("task", due)
                self.filled += due
            else:
                self.sleep(min(1 / self.rate, 1.0))


def run_handler(df: DataFrame, handler: Callable | str, params: dict | None = None, rate: float | None = None) -> DataFrame:
    """Operations that handler gives for the rows of df, as rows of SCHEMA.

    handler: a function of a row (a dict), or its dotted name.  It may return nothing, an operation, or an iterable of them (be
    a generator); anything else that it gives is ignored.  Calls are counted by one operation a task.

    While it runs, context.current() has params, counts, takes a status text, and holds pools; what these give when they are
    flushed, after each Arrow batch, follows the batch's own operations.  rate: rows a second that each task takes at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = resolve(handler) if isinstance(handler, str) else handler
        task = TaskContext.get()
        shard, seq = task.partitionId(), 0
        names = ["shard", "seq", "op", "name", "key", "payload", "delta"]
        kinds = [pa.int32(), pa.int64(), *[pa.string()] * 4, pa.int64()]

        def made(found: list) -> pa.RecordBatch:
            nonlocal seq
            rows = [(shard, seq + k, *op.record()) for k, op in enumerate(found)]
            seq += len(rows)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names)

        with Context(shard, task.attemptNumber(), params) as context:
            context.increment(CALLS, 0)
            pace = Pace(rate) if rate else None
            for batch in batches:
                done: list = []
                for row in batch.to_pylist():
                    if pace:
                        pace.take()
                    context.increment(CALLS)
                    found = call(row)
                    for op in () if found is None else (found,) if isinstance(found, (Put, Delete, Increment)) else found if hasattr(found, "__iter__") else ():
                        if isinstance(op, (Put, Delete, Increment)):
                            done.append(op)
                done += context.flush()
                if done:
                    yield made(done)
            status = [_Status(context.status)] if context.status is not None else []
            yield made([*context.flush(), *status, *(Increment(name, delta) for name, delta in context.counters.items())])

    return df.mapInArrow(run, SCHEMA)


def counters(operations: DataFrame) -> DataFrame:
    """(name, value) over all increments."""
    return operations.where("op = 'increment'").groupBy("name").agg(F.sum("delta").alias("value"))


def mutations(operations: DataFrame, schema: str, key: str) -> DataFrame:
    """Puts and deletes as rows (op, seq, columns of schema), for mutations.apply_pool; seq is by shard, then place."""
    seq = F.col("shard").cast("long") * F.lit(1 << 33) + F.col("seq")
    row = F.from_json("payload", schema)
    rows = operations.where("op IN ('put', 'delete')").select("op", seq.alias("seq"), F.col("key").alias("__key"), row.alias("__row"))
    found = rows.select("op", "seq", "__key", "__row.*")
    kind = found.schema[key].dataType
    return found.withColumn(key, F.coalesce(F.from_json(F.concat(F.lit('{"k":'), F.col("__key"), F.lit("}")), f"k {kind.simpleString()}")["k"], F.col(key))).drop("__key")
