"""Tables that a query writes for itself: steps that are read several times, without a cache that would stay behind.

The shuffles of such a step go when it is written, not when the driver happens to collect its garbage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}
_kept: dict[tuple[str, str], tuple[str, object]] = {}


def new_path(spark: SparkSession) -> str:
    """A path in the folder that driver and executors share; a session on one machine may do without the setting. It goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Spark's setting (since 4.1) by which what is executed removes its shuffle files at its end.
_REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed within leaves no shuffle files; nothing reads them again once it is written."""
    before = spark.conf.get(_REMOVES_SHUFFLES, None)
    spark.conf.set(_REMOVES_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVES_SHUFFLES)
        else:
            spark.conf.set(_REMOVES_SHUFFLES, before)


def write(df: DataFrame, path: str) -> None:
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path, compression="zstd")


def written(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """As ``written``, but a table of a name that the application has written before is read again."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        df, path = make(), new_path(spark)
        write(df, path)
        _kept[key] = path, df.schema
    path, schema = _kept[key]
    return spark.read.schema(schema).parquet(path)
