"""Records as trees of typed fields: an id (``drn``) and an array of fields in document order.

A field is (seq, parent_seq, level, tag, type, text, num, bin, ref); any record may carry any field any
number of times. Paths are tags from an ancestor down to a field, such as ``[1, 3]``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = "struct<seq:int,parent_seq:int,level:int,tag:int,type:string,text:string,num:decimal(20,0),bin:binary,ref:bigint>"
RECORD = f"drn bigint, fields array<{FIELD}>"
VALUE = {"text": "text", "number": "num", "binary": "bin", "pointer": "ref"}


def make_field(seq: int, parent: int | None, level: int, tag: int, kind: str, value: Column | None = None) -> Column:
    """A field from a column: its value goes to the part of its kind (``context`` has none)."""
    part = VALUE.get(kind)
    types = {"text": "string", "num": "decimal(20,0)", "bin": "binary", "ref": "bigint"}
    parts = [(value if name == part and value is not None else F.lit(None)).cast(t).alias(name) for name, t in types.items()]
    return F.struct(F.lit(seq).alias("seq"), F.lit(parent).cast("int").alias("parent_seq"), F.lit(level).alias("level"), F.lit(tag).alias("tag"), F.lit(kind).alias("type"), *parts).cast(FIELD)


def values_of(tag: int, kind: str = "text", fields: str = "fields") -> Column:
    """All values of a field, in order."""
    return F.transform(F.filter(fields, lambda f: f["tag"] == tag), lambda f: f[VALUE[kind]])


def values_of_any(kind: str = "text", fields: str = "fields") -> Column:
    """The values of every field, whatever its tag."""
    return F.filter(F.transform(F.col(fields), lambda f: f[VALUE[kind]]), lambda v: v.isNotNull())


def has_field(tag: int, fields: str = "fields") -> Column:
    return F.coalesce(F.exists(fields, lambda f: f["tag"] == tag), F.lit(False))


def values_at(path: list[int], kind: str = "text", rooted: bool = False, fields: str = "fields") -> Column:
    """Values of the fields at a path, anywhere or (rooted) from the record's root.

    A field's place in the array is its ``seq``, so its ancestors are looked up there: the fields are gone
    through once, and only for those with the path's last tag are the others looked at.
    """

    def fits(f: Column) -> Column:
        found, own = f["tag"] == path[-1], f
        for tag in reversed(path[:-1]):
            own = F.get(F.col(fields), own["parent_seq"])
            found = found & (own["tag"] == tag)
        return F.coalesce(found & (own["level"] == 0) if rooted else found, F.lit(False))

    return F.transform(F.filter(fields, fits), lambda f: f[VALUE[kind]])


def root_is(tag: int, fields: str = "fields") -> Column:
    """Whether a record is of a type: its root's tag."""
    return F.coalesce(F.exists(fields, lambda f: (f["level"] == 0) & (f["tag"] == tag)), F.lit(False))


def long_table(records: DataFrame) -> DataFrame:
    """A row for each field."""
    return records.select("drn", F.explode("fields").alias("f")).select("drn", "f.*")


_ESCAPED = re.compile(r"\\(.)")


def _unescaped(value: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], value)


def from_text_tree(lines: DataFrame, id_col: str = "drn", text_col: str = "text") -> DataFrame:
    """Records from indented text: ``level tag type value`` lines, a record's in one text.

    Within a text value a line end is written as ``\\n`` and a backslash as two.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for drn, text in zip(batch["drn"], batch["text"], strict=True):
                fields, open_ = [], []
                for seq, line in enumerate(x for x in (text or "").split("\n") if x):
                    level, tag, kind, *rest = line.split(" ", 3)
                    level, value = int(level), rest[0] if rest else None
                    del open_[level:]
                    field = {"seq": seq, "parent_seq": open_[-1] if open_ else None, "level": level, "tag": int(tag), "type": kind, "text": None, "num": None, "bin": None, "ref": None}
                    if kind in VALUE and value is not None:
                        field[VALUE[kind]] = {"text": _unescaped, "number": str, "binary": bytes.fromhex, "pointer": int}[kind](value)
                    open_.append(seq)
                    fields.append(field)
                out.append(fields)
            yield pd.DataFrame({"drn": batch["drn"], "fields": out})

    plain = FIELD.replace("num:decimal(20,0)", "num:string")
    rows = lines.select(F.col(id_col).cast("long").alias("drn"), F.col(text_col).alias("text")).mapInPandas(run, f"drn bigint, fields array<{plain}>")
    return rows.withColumn("fields", F.col("fields").cast(f"array<{FIELD}>"))


def to_text_tree(fields: str = "fields") -> Column:
    text = lambda f: F.replace(F.replace(f["text"], F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    value = lambda f: F.coalesce(text(f), f["num"].cast("string"), F.lower(F.hex(f["bin"])), f["ref"].cast("string"))
    line = lambda f: F.concat_ws(" ", f["level"].cast("string"), f["tag"].cast("string"), f["type"], value(f))
    return F.array_join(F.transform(fields, line), "\n")


def unused_tags(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary fields (a ``tag`` each) that no record carries."""
    return dictionary.join(long_table(records).select("tag").distinct(), "tag", "left_anti")


def unknown_tags(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tags that records carry without an entry, with how often."""
    return long_table(records).groupBy("tag").count().join(dictionary.select("tag"), "tag", "left_anti")


def follow(records: DataFrame, tag: int, targets: DataFrame) -> DataFrame:
    """Record pointers in a field, with the records they point at."""
    pointers = records.select("drn", F.explode(values_of(tag, "pointer")).alias("ref"))
    return pointers.join(targets.select(F.col("drn").alias("ref"), F.col("fields").alias("target")), "ref")
