"""Hadoop formats by class name: any input format as a source, sequence files both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_format(spark: SparkSession, path: str, input_format: str, key_class: str, value_class: str, schema: str, conf: dict[str, str] | None = None) -> DataFrame:
    """(key, value) rows of the input format class, whose own splits become partitions."""
    rdd = spark.sparkContext.newAPIHadoopFile(path, input_format, key_class, value_class, conf=conf or {})
    return spark.createDataFrame(rdd, schema)


def write_sequence(df: DataFrame, key: str, value: str, path: str) -> None:
    df.select(key, value).rdd.map(tuple).saveAsSequenceFile(path)


def read_sequence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)
