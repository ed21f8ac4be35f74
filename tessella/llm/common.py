"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the one the cluster shares (spark.checkpoint.dir); it goes when Spark ends.

    Where that is unset, as in local tests, a temporary folder is set up and
    remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    store, at = _located(spark, path)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def _located(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path object, whatever the store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) that hold inside the block only."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """The tables that one operator writes on its way, in the shared folder.

    A written table cuts the lineage: it was computed once, and lost executors cost no
    more than a re-read. Shuffle files are removed once the table they led to stands;
    tables are dropped after their last use, and what a lazy result still reads goes
    when Spark ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, scratch(spark, name), 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """df, written and read again. rows: how many an Arrow batch holds meanwhile. Spark's
        10,000 suit short rows; of long texts they take tens of megabytes in each task."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        more = {} if rows is None else {"spark__sql__execution__arrow__maxRecordsPerBatch": str(rows)}
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **more):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that `write` gave, once nothing lazy reads them any more."""
        for table in tables:
            _, path = self.paths.pop(id(table))
            store, at = _located(self.spark, path)
            store.delete(at, True)


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df, from file sizes; no job is run.

    It only picks how finely data are dealt out, never what is computed.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 1 << 30


def parts(df: DataFrame, mb: float, least: int = 8) -> int:
    """Into how many parts of about mb (compressed) megabytes df divides."""
    return max(least, int(scan_bytes(df) / (mb * 1e6)) + 1)


def n_words(text: str | Column) -> Column:
    """Words in a text (null: 0), as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_crc32(text: str | Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes (null counts as empty)."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def held_out(doc_id: str | Column, folds: int = 5) -> Column:
    """True for the fold no model may learn from: crc32(id as text) mod folds = 0; a null id is in no fold: false."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(text) % folds == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
