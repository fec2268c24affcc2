"""Parquet tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def validate(params: dict, known: Callable[[str], bool] = lambda kind: True, keys: bool = False) -> dict:
    """A table reader's parameters, checked: entity_kind is required and known, batch_size at least 1, namespaces a list or text with commas.

    keys: the reader gives keys; one that gives rows rejects keys_only.
    """
    kind = params.get("entity_kind")
    if not kind:
        raise ValueError("entity_kind is required")
    if not known(kind):
        raise ValueError(f"no such table: {kind}")
    batch = params.get("batch_size", 50)
    if isinstance(batch, bool) or not isinstance(batch, (int, str)) or not str(batch).lstrip("-").isdigit() or int(batch) < 1:
        raise ValueError(f"batch_size must be a number from 1 on: {batch!r}")
    spaces = params.get("namespaces")
    spaces = spaces.split(",") if isinstance(spaces, str) else spaces
    if spaces is not None and not (isinstance(spaces, list) and all(isinstance(n, str) for n in spaces)):
        raise ValueError("namespaces must be text or a list of text")
    if params.get("keys_only") and not keys:
        raise ValueError("keys_only: use the reader of keys")
    return params | {"batch_size": int(batch), "namespaces": spaces}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table called name; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def consistent_keys(base: DataFrame, log: DataFrame, key: str, at: str, start: object) -> DataFrame:
    """Keys of base with those of writes that were logged before start, and may not be in base yet, rolled forward; each once."""
    return base.select(key).unionByName(log.where(F.col(at) < start).select(key)).distinct()
