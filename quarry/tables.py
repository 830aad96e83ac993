"""Tables cut from their lineage, written in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that may be broadcast: a side of at most so many estimated bytes.
BROADCAST_BYTES = 32 << 20


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a new temporary one where it is unset and all work is on this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _own_folder()


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again, so that later stages neither repeat nor lose them. Texts take a third less by zstd than by the default."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """The side marked for broadcast if it is small, by its counted rows; else for a shuffled join: by the size of its compressed files Spark may take millions of rows for few."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("shuffle_merge")


#: Rows that are held as part of a plan: a side of queries and their few hits.
HELD_ROWS = 5_000


def held(df: DataFrame, name: str, most: int = 0) -> tuple[DataFrame, int]:
    """The rows and their number: as part of the plan if they are few, so that no table is written for them, else as a written table.

    most: rows that there may be, where that is known. If these can't be held, the table is written at once, so that the rows aren't made twice.
    """
    few = df.limit(HELD_ROWS + 1).toArrow() if most <= HELD_ROWS else None
    if few is not None and few.num_rows <= HELD_ROWS:
        return df.sparkSession.createDataFrame(few, schema=df.schema), few.num_rows
    table = cut(df, name)
    return table, table.count()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A scan of few splits (one row group, say) dealt out to all cores by these columns; a scan of many splits as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df
