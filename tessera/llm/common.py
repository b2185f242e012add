"""What several operators share: the shared folder, cutting lineage, tables that go, and joins with small tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.written import write

#: Rows up to which a lookup table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000

#: Rows of texts that a Python worker gets at once, where the session has Spark's own default.
BATCH_ROWS, DEFAULT_BATCH_ROWS = 1_000, 10_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that is unset, a session on one machine (as in tests) gets a folder of its own; a cluster is told to set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def of_texts(df: DataFrame) -> DataFrame:
    """``df``, whose rows hold texts: a batch of them, held several times over on its way to Python and back, is kept to some megabytes.

    A session that sets the size of its batches keeps its own.
    """
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH_SETTING)) == DEFAULT_BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized = path
    return out


def columns_of(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a table that ``materialize`` gave; ``drop`` takes them for the table."""
    out = df.select(*columns)
    out._materialized = df._materialized
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` gave, when all that reads them has been written."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._materialized)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def is_small(lookup: DataFrame) -> bool:
    return lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", small: bool | None = None) -> DataFrame:
    """Join a materialised lookup (unique on ``keys``), broadcast only while its size is small: counted here, or by the caller.

    Keys compare null-safely. Beyond ``BROADCAST_ROWS`` it is a sort-merge join, whose hot keys
    AQE splits (the lookup is read from a file, so both sides are plain shuffles).
    """
    small = is_small(lookup) if small is None else small
    right = lookup.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in lookup.columns if c not in keys])
    on = None
    for k in keys:
        same = df[k].eqNullSafe(right[f"__k_{k}"])
        on = same if on is None else on & same
    out = df.join(F.broadcast(right) if small else right, on, how)
    return out.drop(*[f"__k_{k}" for k in keys])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` for a task, after which its worker, kept for later tasks, gives freed memory back."""

    @wraps(run)
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU allocator's
                trim(0)

    return task
