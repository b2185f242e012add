"""Places in an ordered result: sort keys, first to last, steps, absolute and relative places.

Every order ends with the id, so that it is total and a place can be found again in any later run.
Places are counted over range partitions: a partition's rows are numbered within it and moved by the
partitions before, so no task sees the whole result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import EXACT, Rules
from tessera.sources.written import written

SCALE = 1000


@dataclass(frozen=True)
class SortKey:
    """A column of a sort order; of an array (many values) the lowest counts, or the highest if descending."""

    column: str
    descending: bool = False
    missing_high: bool = False
    rules: Rules = EXACT
    limit: int | None = None
    many: bool = False

    def value(self) -> Column:
        own = F.col(self.column)
        if self.many:
            own = (F.array_max if self.descending else F.array_min)(F.array_compact(own))
        if self.rules != EXACT:
            own = self.rules.key(own)
        return F.substring(own, 1, self.limit) if self.limit else own

    def order(self) -> Column:
        v = self.value()
        if self.descending:
            return v.desc_nulls_first() if self.missing_high else v.desc_nulls_last()
        return v.asc_nulls_last() if self.missing_high else v.asc_nulls_first()


#: Sort keys that an order may have.
MOST_KEYS = 32


def verify(df: DataFrame, keys: list[SortKey], id_col: str) -> None:
    """Raise ValueError for sort keys that cannot be: none or too many, columns that are not there or come twice, many values of what is no array, limits below 1."""
    if not 1 <= len(keys) <= MOST_KEYS:
        raise ValueError(f"an order has 1 to {MOST_KEYS} sort keys")
    if len({k.column for k in keys}) < len(keys):
        raise ValueError("a column is a sort key once")
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    for k in keys:
        if k.column not in kinds or id_col not in kinds:
            raise ValueError(f"no column {k.column if k.column not in kinds else id_col}")
        if k.many != (kinds[k.column] == "array"):
            raise ValueError(f"{k.column} has {'one value' if k.many else 'many values'}")
        if k.limit is not None and k.limit < 1:
            raise ValueError(f"{k.column} is cut to nothing")


def order_by(keys: list[SortKey], id_col: str) -> list[Column]:
    return [*[k.order() for k in keys], F.col(id_col).asc()]


def ordered(df: DataFrame, keys: list[SortKey], id_col: str) -> DataFrame:
    return df.orderBy(*order_by(keys, id_col))


def numbered(df: DataFrame, keys: list[SortKey], id_col: str, name: str = "position") -> DataFrame:
    """``df`` with each row's place from 1."""
    order = order_by(keys, id_col)
    dealt = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").count()  # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(name, own).join(F.broadcast(shifts), "__part").withColumn(name, (F.col(name) + F.col("__shift")).cast("long")).drop("__part", "__shift")


def first(df: DataFrame, keys: list[SortKey], id_col: str) -> DataFrame:
    return ordered(df, keys, id_col).limit(1)


def last(df: DataFrame, keys: list[SortKey], id_col: str) -> DataFrame:
    return _turned(df, keys, id_col).limit(1)


def _turned(df: DataFrame, keys: list[SortKey], id_col: str) -> DataFrame:
    """From the last row to the first."""
    turned = []
    for k in keys:
        v = k.value()
        turned.append((v.asc_nulls_last() if k.missing_high else v.asc_nulls_first()) if k.descending else (v.desc_nulls_first() if k.missing_high else v.desc_nulls_last()))
    return df.orderBy(*turned, F.col(id_col).desc())


def at(df: DataFrame, keys: list[SortKey], id_col: str, position: int) -> DataFrame:
    """The row at a place from 1; 0 is before the first and −1 after the last, where no row is."""
    if position <= 0:
        return df.limit(0)
    return numbered(df, keys, id_col, "__at").filter(F.col("__at") == position).drop("__at")


def _beyond(keys: list[SortKey], id_col: str, here: str, after: bool) -> Column:
    """Whether a row comes after (or before) another, whose values are the columns ``here`` and a number."""

    def later(a: Column, b: Column, descending: bool, nulls_first: bool) -> Column:
        one_missing = (b if nulls_first else a).isNull() & (a.isNull() != b.isNull())
        return F.when(a.isNull() | b.isNull(), one_missing).otherwise((a < b) if descending else (a > b))

    found, same = F.lit(False), F.lit(True)
    for i, (v, *how) in enumerate([*[(k.value(), k.descending, k.missing_high == k.descending) for k in keys], (F.col(id_col), False, True)]):
        h = F.col(f"{here}{i}")
        found, same = found | same & (later(v, h, *how) if after else later(h, v, *how)), same & v.eqNullSafe(h)
    return found


def move(df: DataFrame, keys: list[SortKey], id_col: str, from_id: object, by: int) -> DataFrame:
    """The row some steps after (before, if negative) the row with an id: of the rows beyond it only the nearest are put in order."""
    here = df.filter(F.col(id_col) == from_id).limit(1)
    if by == 0:
        return here
    values = [*[k.value() for k in keys], F.col(id_col)]
    marks = here.select(*[v.alias(f"__here{i}") for i, v in enumerate(values)])
    some = df.crossJoin(F.broadcast(marks)).filter(_beyond(keys, id_col, "__here", by > 0)).select(*df.columns)  # one row
    return (ordered(some, keys, id_col) if by > 0 else _turned(some, keys, id_col)).offset(abs(by) - 1).limit(1)


def next_page(df: DataFrame, keys: list[SortKey], id_col: str, after: Column | None, size: int) -> DataFrame:
    """Rows after a saved place, given as a condition on the keys; the place needs no state."""
    return ordered(df if after is None else df.filter(after), keys, id_col).limit(size)


def percent_place(df: DataFrame, keys: list[SortKey], id_col: str) -> DataFrame:
    """Each row's place from 0 to SCALE; a single row is at 0."""
    places = numbered(df, keys, id_col)
    total = places.agg(F.count("*").alias("__n"))
    share = F.when(F.col("__n") > 1, F.floor((F.col("position") - 1) * SCALE / (F.col("__n") - 1))).otherwise(0)
    return places.crossJoin(F.broadcast(total)).withColumn("percent_position", share.cast("long")).drop("__n")  # one row


def at_percent(df: DataFrame, keys: list[SortKey], id_col: str, place: int) -> DataFrame:
    """The first row at or beyond a place from 0 to SCALE."""
    return percent_place(df, keys, id_col).filter(F.col("percent_position") >= place).orderBy("position").limit(1).drop("position", "percent_position")


def seek(df: DataFrame, keys: list[SortKey], id_col: str, value: object, how: str = "including") -> DataFrame:
    """The first row whose first sort key is at or beyond a value."""
    if not keys:
        raise ValueError("a search needs sort keys")
    v, k = keys[0].value(), keys[0]
    found = {"exact": v == value, "including": (v <= value) if k.descending else (v >= value), "excluding": (v < value) if k.descending else (v > value)}[how]
    return first(df.filter(found), keys, id_col)


def compare_places(df: DataFrame, keys: list[SortKey], id_col: str, a: object, b: object) -> DataFrame:
    """−1, 0 or 1 as the row with id ``a`` is before, at or after that with id ``b``."""
    places = numbered(df.filter(F.col(id_col).isin(a, b)), keys, id_col)
    pa, pb = F.max(F.when(F.col(id_col) == a, F.col("position"))), F.max(F.when(F.col(id_col) == b, F.col("position")))
    return places.agg(F.signum(pa - pb).cast("int").alias("comparison"))


def counts(df: DataFrame, criterion: Column) -> DataFrame:
    """Rows read, and rows that passed."""
    return df.agg(F.count("*").alias("read"), F.count_if(criterion).alias("passed"))
