"""What the operators share: reading tables, tables written in the shared folder, batch sizes."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.session import scratch_path, tune

# Bytes of text that an array kernel takes at a time.
CHUNK_BYTES = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"


# Rows of an Arrow batch: with long texts, many of them are more than a small executor has room for.
BATCH_ROWS = 2000


def tuned(spark: SparkSession) -> SparkSession:
    """The session with the runtime settings of the library and of these operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_tag(*columns: str) -> Column:
    """A 64-bit name of these columns' values, nulls included; never null itself."""
    return F.xxhash64(*(x for c in columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())))


def one_each(docs: DataFrame, tag: str) -> DataFrame:
    """One row for each value of ``tag``; costs no shuffle after a join on it."""
    turn = fresh(docs, "turn")
    rows = Window.partitionBy(tag).orderBy(F.lit(0))
    return docs.withColumn(turn, F.row_number().over(rows)).filter(F.col(turn) == 1).drop(turn)


def released(spark: SparkSession) -> None:
    """Have the driver notice what is out of use, so that shuffle files of steps that were saved leave the disks."""
    for _ in range(2):  # references from Python go first, those that they held go next
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
