"""Session helpers of the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that a file of a stored table has at least, where their number is known.
FILE_ROWS = 25_000


def gathered(df: DataFrame, most: int) -> DataFrame:
    """df, of at most so many rows, in no more partitions than FILE_ROWS calls for, to be stored.

    Every partition is a file, and for each file and folder Hadoop starts processes that set its mode, unless it has its native
    library: a small table dealt over hundreds of partitions costs thousands of them.
    """
    return df.coalesce(max(1, -(-most // FILE_ROWS)))


class Stored:
    """A table written in the shared folder: as safe from lost executors as cut() makes it, narrower on disk, and read by column."""

    def __init__(self, df: DataFrame) -> None:
        self._spark = df.sparkSession
        self._path = f"{shared_dir(self._spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self._path)
        self.rows = self._spark.read.schema(df.schema).parquet(self._path)

    def drop(self) -> None:
        """Delete the table; nothing may read it any more."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of tables that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Have executors give back what they no longer need: what operators keep in Python workers, and the JVM's free heap.

    A JVM's heap stays as large as its largest task made it, and would add to what workers hold in the next stage.  The tasks, one
    for each core, change nothing but memory; an executor that gets none of them keeps what it has.
    """
    n = spark.sparkContext.defaultParallelism
    each = spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("x"))
    each.mapInArrow(tidied(lambda batches: batches), "x string").collect()


#: Keys with very many rows that are broadcast at most, and rows below which a key isn't one of these.
HOT_KEYS = 10_000
HOT_ROWS = 1_000


def join_totals(rows: DataFrame, size: int, keys: list[str], *totals: Column) -> DataFrame:
    """rows joined with aggregates over the rows of each key, and with their number as n; size: how many rows there are, about.

    Keys with more than a ten-thousandth of all rows, of which there are about HOT_KEYS at most whatever the data, are joined by
    a broadcast, so that no task gets a hot key's rows; the others by a shuffle.
    """
    found = rows.groupBy(*keys).agg(*totals, F.count(F.lit(1)).alias("n"))
    if size <= HOT_ROWS:
        return rows.join(found, keys)
    limit = max(HOT_ROWS, size // HOT_KEYS)
    hot = rows.join(F.broadcast(found.where(F.col("n") > limit)), keys)
    rest = rows.join(F.broadcast(found.where(F.col("n") > limit).select(*keys)), keys, "left_anti")
    return hot.unionByName(rest.join(found.where(F.col("n") <= limit), keys))


def document_key(id_column: Column | str, text: Column | str) -> list[Column]:
    """Identity of a document as columns k1 and k2: 128 bits of its id and text, so that repeated rows agree and clashing ids do not."""
    return [F.xxhash64(id_column, text).alias("k1"), F.xxhash64(F.lit(1), id_column, text).alias("k2")]


def text_key(id_column: str, text_column: str):
    """Identity of a document: its id and a 128-bit digest of its text, so that repeated rows agree and clashing ids do not."""
    return F.col(id_column), F.md5(F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")))
