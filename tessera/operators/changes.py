"""Rows added, changed and removed, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import passes


def coerce(value: Column, kind: T.DataType) -> Column:
    """A value for a column of a storage type: text, whole number or binary; missing if it is none."""
    if isinstance(kind, T.BinaryType):
        return F.try_to_binary(value.cast("string"), F.lit("utf-8"))
    return value.try_cast(kind)


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by column name; columns that are not named are missing."""
    return df.unionByName(rows.select(*[coerce(F.col(c), df.schema[c].dataType).alias(c) for c in rows.columns]), allowMissingColumns=True)


def update(df: DataFrame, assignments: dict[str, Column], where: Column | None = None) -> DataFrame:
    """SET expressions see the old values; rows for which ``where`` is not true stay."""
    chosen = passes(where) if where is not None else F.lit(True)
    return df.withColumns({c: F.when(chosen, coerce(v, df.schema[c].dataType)).otherwise(F.col(c)) for c, v in assignments.items()})


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    return df.filter(~passes(where)) if where is not None else df.limit(0)


def modify(df: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of ``changed`` take the place of those with their key; new keys are added."""
    return df.join(changed.select(key), key, "left_anti").unionByName(changed)


def remove(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def reserve_ids(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """New rows with ids beyond those in use: distinct and increasing, not without gaps."""
    most = F.coalesce(F.max(key), F.lit(-1)).alias("__most")
    return rows.crossJoin(df.agg(most)).withColumn(key, F.col("__most") + 1 + F.monotonically_increasing_id()).drop("__most")


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a unique index that several rows have; keys with a missing part do not count."""
    return df.dropna(subset=keys).groupBy(*keys).count().filter("count > 1")


def backup(df: DataFrame, path: str, since: Column | None = None) -> None:
    """A snapshot, or with ``since`` the rows changed later."""
    (df if since is None else df.filter(since)).write.parquet(path)


def restore(full: DataFrame, increments: list[DataFrame], key: str) -> DataFrame:
    for i in increments:
        full = modify(full, i, key)
    return full
