"""Where intermediate tables go, the folder the cluster shares; and what may travel to every task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or for a local session without one a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
    return root


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which goes when Spark ends."""
    path = f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    parent = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(parent)
    store.deleteOnExit(parent)
    return f"{path}/files"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint; a local session without a folder gets one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once into the shared folder and read again, which cuts its lineage; it goes when Spark ends.
    (A checkpoint computes what it stores twice.)"""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, per_task: int, *by: str) -> DataFrame:
    """rows over as many tasks as they fill, per_task each: a small file is read by few tasks, whatever its rows
    go through afterwards. by: columns whose equal values stay together."""
    return rows.repartition(rows.count() // per_task + 1, *by)


#: Rows of a table that every row of another is set beside.
SMALL_ROWS = 10_000


def small_table(rows: DataFrame, what: str) -> DataFrame:
    """rows, once their number is known to be small enough to travel to every task."""
    n = rows.limit(SMALL_ROWS + 1).count()
    if n > SMALL_ROWS:
        raise ValueError(f"{what} holds at most {SMALL_ROWS} rows")
    return rows


def size_of(df: DataFrame) -> int:
    """Catalyst's size estimate of df in bytes, from file sizes; no job is run. It only picks how finely
    data are dealt out, never what is computed."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 1 << 30
