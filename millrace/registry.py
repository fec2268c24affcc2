"""The engine's registered queries and their SQL twins."""

from __future__ import annotations

import functools
import importlib
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of millrace.plans; each has QUERIES and ORACLE.
MODULES: tuple[str, ...] = ("reduce", "scan", "blob", "maps", "keys", "jobs", "stream")


def ship(spark: SparkSession) -> None:
    """Let Python workers of this session find the package where the driver has it (on a cluster: by --py-files, or installed)."""
    root, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"millrace.plans.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict[str, Query]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
