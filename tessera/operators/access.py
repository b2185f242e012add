"""Ordered access by record number or key, and joins in the language's forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieve(df: DataFrame, key: str, value: object = None, how: str = "exact") -> DataFrame:
    """One row in key order: ``exact``, ``including`` (>=), ``excluding`` (>), ``first`` or ``last``."""
    if how == "exact":
        return df.filter(F.col(key) == value)
    if how in ("first", "last"):
        return df.orderBy(F.col(key).asc() if how == "first" else F.col(key).desc()).limit(1)
    return df.filter(F.col(key) >= value if how == "including" else F.col(key) > value).orderBy(key).limit(1)


def between(df: DataFrame, key: str, low: object = None, high: object = None) -> DataFrame:
    """A partial scan: Parquet statistics prune where the data lies in key order."""
    if low is not None:
        df = df.filter(F.col(key) >= low)
    return df if high is None else df.filter(F.col(key) <= high)


def retrieve_key(index: DataFrame, parts: list[str], values: list[object], how: str = "including") -> DataFrame:
    """The first entry at or beyond a composite key, in key order and then by record number."""
    key, wanted = F.struct(*parts), F.struct(*[F.lit(v).alias(p) for p, v in zip(parts, values, strict=True)])
    found = {"exact": key == wanted, "including": key >= wanted, "excluding": key > wanted}[how]
    return index.filter(found).orderBy(*parts, "drn").limit(1)


def records_of_keys(index: DataFrame, records: DataFrame, id_col: str = "drn") -> DataFrame:
    """From index entries to their records, each once."""
    return records.join(index.select(id_col), id_col, "left_semi")


def in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that ``right`` has too, in all of their columns.

    Rows that were made from others are far larger than Catalyst takes them for (an array counts as one element,
    a text as 20 bytes), so the sides are shuffled: a broadcast would take them whole through the driver.
    """
    return left.join(right.hint("merge"), left.columns)


def any_of(df: DataFrame, criteria: list[Column]) -> DataFrame:
    """The union of sub-queries over one table without repeats: one scan."""
    return df.filter(reduce(lambda a, b: a | b, criteria))


def comma_join(tables: list[DataFrame], where: Column) -> DataFrame:
    """Tables side by side with a condition; each may be named once.

    A filter drops the unknown as it drops the false, so the condition stays bare: Catalyst finds the join
    keys in it and pushes the rest to the scans.
    """
    if len({id(t) for t in tables}) != len(tables):
        raise ValueError("a table may be joined once")
    return reduce(lambda a, b: a.crossJoin(b), tables).filter(where)
