"""Comparisons with missing values and many values.

``Missing`` says what a comparison with a missing operand gives: SQL leaves it unknown; NODE makes it
false, or true under a NOT; RECORD resolves it to true exactly where every value is asked for.

A comparison over many values holds if it does for some value. Its negation is not "for no value equal"
of the same test turned round, but the opposite comparison for every value: NOT (f = v) is f <> v for
each value of f, while f <> v alone asks for some value.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


class Missing(Enum):
    SQL = "sql"
    NODE = "node"
    RECORD = "record"


OPPOSITE = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def test(op: str, a: Column, b: Column) -> Column:
    """The plain comparison: missing operands give an unknown."""
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def resolve(result: Column, missing: Missing, negated: bool = False, every: bool = False) -> Column:
    if missing is Missing.SQL:
        return result
    return F.coalesce(result, F.lit(negated if missing is Missing.NODE else every))


def compare(op: str, a: Column, b: Column, missing: Missing = Missing.SQL, negated: bool = False) -> Column:
    """``a op b``, or under ``negated`` the opposite comparison."""
    return resolve(test(OPPOSITE[op] if negated else op, a, b), missing, negated, negated)


def any_value(values: Column, holds: Test) -> Column:
    """Whether a test holds for some value; unknown if there is none. Missing values do not count."""
    there = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.exists(there, lambda x: F.coalesce(holds(x), F.lit(False))))


def every_value(values: Column, holds: Test) -> Column:
    there = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.forall(there, lambda x: F.coalesce(holds(x), F.lit(False))))


def compare_values(op: str, values: Column, other: Column, missing: Missing = Missing.SQL, negated: bool = False) -> Column:
    """A field of many values against one value."""
    if negated:
        return resolve(every_value(values, lambda x: test(OPPOSITE[op], x, other)), missing, True, True)
    return resolve(any_value(values, lambda x: test(op, x, other)), missing)


def compare_all_pairs(op: str, values: Column, others: Column, missing: Missing = Missing.SQL, negated: bool = False) -> Column:
    """Two fields of many values: some pair, or under ``negated`` the opposite for every pair."""
    if negated:
        return resolve(every_value(values, lambda x: every_value(others, lambda y: test(OPPOSITE[op], x, y))), missing, True, True)
    return resolve(any_value(values, lambda x: any_value(others, lambda y: test(op, x, y))), missing)


def exists(value: Column) -> Column:
    """A bare field: whether it is there."""
    return value.isNotNull()


def any_present(values: Column) -> Column:
    return F.coalesce(F.size(F.filter(values, lambda x: x.isNotNull())) > 0, F.lit(False))


def with_default(value: Column, kind: str) -> Column:
    """A missing field as its type's default: an empty text, 0, or empty binary."""
    return F.coalesce(value, {"text": F.lit(""), "number": F.lit(0), "binary": F.lit(b"")}[kind])


def truth(value: Column, kind: str) -> Column:
    """A value as a criterion of its own: numbers but 0, and texts but empty ones, are true."""
    return value if kind == "boolean" else value != 0 if kind == "number" else F.length(value) > 0


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def passes(criterion: Column) -> Column:
    """What a query returns: rows for which the criterion is true, not unknown."""
    return F.coalesce(criterion, F.lit(False))
