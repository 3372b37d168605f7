"""Session helpers shared by operators that cut lineage or need an eager size check."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a fresh temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="claimscope-checkpoint-"))
    return _local[0]


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _freed_shuffles(spark: SparkSession, wanted: bool) -> Iterator[None]:
    """If ``wanted``, an execution inside removes its shuffle files when it ends, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if wanted:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if wanted:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, *by: str, compression: str | None = None, rows: int = 0, free: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders of the columns ``by`` and files of at most ``rows`` rows (0: any number), and return that table: no lineage, computed once, safe from lost executors.

    With ``free``, the shuffle files of the write go as soon as the table is there. ``discard`` removes the table when nothing that reads it is left to run; tables behind a returned DataFrame stay.
    """
    path = new_path(df.sparkSession)
    with _freed_shuffles(df.sparkSession, free):
        df.write.partitionBy(*by).option("maxRecordsPerFile", rows).parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from ``cut``; other DataFrames are left alone."""
    for df in tables:
        if path := _written.pop(df, None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rows_up_to(df: DataFrame, limit: int) -> int | None:
    """Number of rows of ``df`` if it is at most ``limit``, else None. Reads no more than ``limit`` + 1 rows."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None
