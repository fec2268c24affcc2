"""Group by key, with combiners and reducers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which every key's rows are dealt before they are combined.
SALTS = 64


def group_values(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, values): each key's values in the given order.

    A list is one row of the result, so this suits keys whose lists are meant to be rows; reduce a key with very many values by
    reduce_columns or reduce_groups instead.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(key).agg(F.transform(items, lambda x: x["__v"]).alias("values"))


def reduce_columns(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by key: Spark combines in each task before the shuffle, so a hot key brings one row from each task."""
    return df.groupBy(*keys).agg(*aggregates)


class Reducer:
    """reduce gives out any number of rows for a key, none by default; task_setup and task_cleanup run around each group.

    combine must be associative and give rows of the input's schema: it is applied to parts of a key's rows, and to what it has
    given out before.
    """

    def task_setup(self) -> None: ...

    def combine(self, key: tuple, rows: pa.Table) -> pa.Table:
        return rows

    def reduce(self, key: tuple, rows: pa.Table) -> Iterator[dict]:
        return iter(())

    def task_cleanup(self) -> None: ...


def reduce_groups(df: DataFrame, keys: list[str], make: Callable[[], Reducer], schema: str, combines: bool = True) -> DataFrame:
    """A Python reducer by key.

    With combines, rows are dealt over SALTS parts of their key and combined there first, so that the task which reduces a hot
    key receives one combined part from each.
    """
    columns = df.columns
    arrow = _arrow(schema)

    def names(key: tuple) -> tuple:
        return tuple(k.as_py() for k in key)

    def combine(key: tuple, rows: pa.Table) -> pa.Table:
        reducer = make()
        return reducer.combine(names(key)[:-1], rows.drop_columns(["__salt"])).select(columns)

    def reduce(key: tuple, rows: pa.Table) -> pa.Table:
        reducer = make()
        reducer.task_setup()
        found = list(reducer.reduce(names(key), rows) or ())
        reducer.task_cleanup()
        return pa.Table.from_pylist(found, arrow) if found else arrow.empty_table()

    if combines:
        salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        df = salted.groupBy(*keys, "__salt").applyInArrow(combine, df.schema)
    return df.groupBy(*keys).applyInArrow(reduce, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def key_range(df: DataFrame, key: str, shard: str) -> DataFrame:
    """(shard, min_key, max_key) of each shard and, with a null shard, of all; rows without a key don't count."""
    return df.where(F.col(key).isNotNull()).rollup(shard).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))
