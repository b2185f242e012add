"""Index tables: one row for each key and record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.phonetic import word_codes
from tessera.functions.text import EXACT, Rules

VALUE_LIMIT = 128
SUBSTRING_LIMIT = 48


def value_keys(df: DataFrame, id_col: str, text: Column, rules: Rules = EXACT, limit: int = VALUE_LIMIT) -> DataFrame:
    return df.select(F.col(id_col).alias("drn"), F.substring(rules.key(text), 1, limit).alias("key")).filter("key is not null").distinct()


def word_keys(df: DataFrame, id_col: str, text: Column, rules: Rules = EXACT) -> DataFrame:
    """A key for each word; apostrophes, dashes, dots and the like part words."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(rules.apply(text), F.lit(r"[\p{L}0-9]+"), F.lit(0))))
    return df.select(F.col(id_col).alias("drn"), words.alias("key"))


def substring_keys(df: DataFrame, id_col: str, text: Column, rules: Rules = EXACT, limit: int = SUBSTRING_LIMIT) -> DataFrame:
    """A key for each place in the text that is no space, up to the limit. A record's texts meet and its keys are told apart there: keys are not shuffled."""
    own = df.select(F.col(id_col).alias("drn"), rules.apply(text).alias("text")).filter("length(text) > 0")
    texts = own.groupBy("drn").agg(F.collect_set("text").alias("texts"))
    starts = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda at: F.substring(t, at, F.lit(limit)))
    keys = F.filter(F.array_distinct(F.flatten(F.transform("texts", starts))), lambda k: ~F.startswith(k, F.lit(" ")))
    return texts.select("drn", F.explode(keys).alias("key"))


def presence_keys(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Which fields a record has."""
    there = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]))
    return df.select(F.col(id_col).alias("drn"), F.explode(there).alias("key"))


def sound_keys(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    return df.select(F.col(id_col).alias("drn"), F.explode(word_codes(text)).alias("key"))


def compound_keys(parts: list[DataFrame], required: list[bool]) -> DataFrame:
    """All combinations of a record's keys of several parts; a part that is not required may be missing."""
    out = parts[0].withColumnRenamed("key", "key0")
    for i, (part, must) in enumerate(zip(parts[1:], required[1:], strict=True), 1):
        part = part.withColumnRenamed("key", f"key{i}")
        out = out.join(part, "drn", "inner" if must and required[0] else "left" if required[0] else "right" if must else "full")
    return out.distinct()


def covering(index: DataFrame, df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """An index whose entries carry values of their records besides the key, so that queries need no record."""
    return index.join(df.select(F.col(id_col).alias("drn"), *columns), "drn")


def alternate_keys(df: DataFrame, id_col: str, texts: list[Column], rules: Rules = EXACT, limit: int = VALUE_LIMIT) -> DataFrame:
    """A key from the first of some fields that a record has."""
    return value_keys(df, id_col, F.coalesce(*texts), rules, limit)


def post_keys(df: DataFrame, id_col: str, text: Column, limit: int = VALUE_LIMIT) -> DataFrame:
    """Keys without case, and behind each where its capitals were, so that the value can be had from the key."""
    own = F.substring(text, 1, limit)
    flags = F.array_join(F.transform(F.split(own, ""), lambda c: F.when((c != F.lower(c)) & (c == F.upper(c)), "1").otherwise("0")), "")
    return df.select(F.col(id_col).alias("drn"), F.lower(own).alias("key"), flags.alias("post")).filter("key is not null").distinct()


def across(indexes: dict[str, DataFrame]) -> DataFrame:
    """One index over several containers: each entry with the container that its record is in."""
    return reduce(DataFrame.unionByName, [i.withColumn("container", F.lit(name)) for name, i in indexes.items()])


def key_counts(index: DataFrame) -> DataFrame:
    """Each key's references."""
    return index.groupBy("key").agg(F.countDistinct("drn").alias("refs"))


def index_counts(index: DataFrame) -> DataFrame:
    """Keys and references of a whole index."""
    return index.groupBy("key").agg(F.count("*").alias("refs")).agg(F.count("*").alias("keys"), F.sum("refs").alias("refs"))


def extend(index: DataFrame, df: DataFrame, id_col: str, build) -> DataFrame:
    """An index taken up again after its last record: only later records are read."""
    last = index.agg(F.max("drn").alias("__last"))
    later = df.crossJoin(F.broadcast(last)).filter(F.col("__last").isNull() | (F.col(id_col) > F.col("__last"))).drop("__last")  # one row
    return index.unionByName(build(later))
