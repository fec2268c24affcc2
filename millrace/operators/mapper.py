"""Mappers that hold state for a task: Arrow batches in, Arrow batches out."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class Mapper:
    """setup and task_setup run before a task's rows, task_cleanup and cleanup after them; map does nothing by default.

    A mapper has to override map (row by row, yielding rows as dicts) or map_batch (Arrow batch in, batches out).
    """

    def setup(self) -> None: ...

    def task_setup(self) -> None: ...

    def map(self, row: dict) -> Iterator[dict]:
        return iter(())

    def map_batch(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [out for row in batch.to_pylist() for out in self.map(row) or ()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    def task_cleanup(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    def cleanup(self) -> None: ...


def run_mapper(df: DataFrame, make: Callable[[], Mapper], schema: str) -> DataFrame:
    """One mapper for each task, from make (a class, or any callable without arguments)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = make()
        mapper.setup()
        mapper.task_setup()
        for batch in batches:
            yield from mapper.map_batch(batch)
        yield from mapper.task_cleanup() or ()
        mapper.cleanup()

    return df.mapInArrow(run, schema)


def resolve(name: str) -> Callable:
    """The handler called module.function, module.Class (an instance, to be called) or module.Class.method (bound to an instance)."""
    parts = name.split(".")
    for n in range(len(parts) - 1, 0, -1):
        try:
            found = importlib.import_module(".".join(parts[:n]))
        except ModuleNotFoundError as e:
            if e.name and not ".".join(parts[:n]).startswith(e.name):
                raise
            continue
        for part in parts[n:]:
            found = getattr(found() if inspect.isclass(found) else found, part)
        return found() if inspect.isclass(found) else found
    raise ImportError(f"no module for {name!r}")


def yields(handler: Callable) -> bool:
    """Whether calling it makes a generator."""
    return inspect.isgeneratorfunction(handler) or inspect.isgeneratorfunction(getattr(handler, "__call__", None))  # noqa: B004
