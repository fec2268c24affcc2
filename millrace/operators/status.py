"""Roll-ups of shard rows into the state of jobs, and quota refills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE, SUCCESS, FAILED, ABORTED = "active", "success", "failed", "aborted"


def _counts(shards: DataFrame, job: str, state: str, *more: Column) -> DataFrame:
    n = lambda s: F.count_if(F.col(state) == s)
    return shards.groupBy(job).agg(F.count(F.lit(1)).alias("shards"), n(ACTIVE).alias("active_shards"), n(FAILED).alias("failed_shards"), n(ABORTED).alias("aborted_shards"), n(SUCCESS).alias("success_shards"), *more)


def roll_up(shards: DataFrame, job: str, state: str, expected: str, abort: str) -> DataFrame:
    """Counts by job and its status, from shard rows that carry the number of shards expected and whether the job is to abort.

    Missing shard rows fail the job.  While a shard is active so is the job.  Then an order to abort makes it aborted, and any
    shard without success makes it failed: one failed shard doesn't stop the others.
    """
    out = _counts(shards, job, state, F.max(expected).alias("__expected"), F.max(abort).alias("__abort"))
    status = (
        F.when(F.col("shards") != F.col("__expected"), FAILED)
        .when(F.col("active_shards") > 0, ACTIVE)
        .when(F.col("__abort"), ABORTED)
        .when(F.col("success_shards") < F.col("shards"), FAILED)
        .otherwise(SUCCESS)
    )
    return out.withColumn("status", status).drop("__expected", "__abort")


def job_status(states: list[str], expected: int, abort: bool = False) -> str:
    """The status that roll_up gives a job whose shards have these states."""
    if len(states) != expected:
        return FAILED
    if ACTIVE in states:
        return ACTIVE
    if abort:
        return ABORTED
    return SUCCESS if all(x == SUCCESS for x in states) else FAILED


def roll_up_strict(shards: DataFrame, job: str, state: str) -> DataFrame:
    """The other rule: any failed shard is the job's error, else it is done when none is active; finished jobs keep no shard rows."""
    out = _counts(shards, job, state)
    status = F.when(F.col("failed_shards") > 0, "error").when(F.col("active_shards") == 0, "done").otherwise(ACTIVE)
    return out.withColumn("status", status).withColumn("kept_shards", F.when(F.col("status") == ACTIVE, F.col("shards")).otherwise(0).cast("long"))


def refill(rate: Column, seconds: Column, active: Column) -> Column:
    """Quota for each active shard: the rate's share of the seconds since the last refill, rounded up; none within the first second."""
    return F.when((seconds < 1) | (active == 0), 0).otherwise(F.ceil(rate * seconds / active)).cast("long")


def refill_whole(rate: Column, milliseconds: Column, active: Column) -> Column:
    """The other rule: rate at the first tick (null milliseconds), else by whole numbers, divided among active shards."""
    due = F.coalesce(F.floor(milliseconds * rate / 1000), rate)
    return F.when(active == 0, 0).otherwise(F.floor(due / active)).cast("long")
