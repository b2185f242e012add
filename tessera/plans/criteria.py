"""Criteria as Python expressions that become one Spark column.

    wanted = (field("l_quantity") > 45) & ((field("l_returnflag") == "R") | ~field("tags", many=True).equals("x"))
    rows.filter(wanted.column(Missing.RECORD))

The classes only carry what Spark columns lose: which field has many values, which rules a text is
compared by, and whether a comparison stands under a NOT, so that negation turns a comparison of many
values into its opposite for every value. All else is left to Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import phonetic, text, values
from tessera.functions.text import EXACT, Rules
from tessera.functions.values import Missing


class Criterion:
    def build(self, missing: Missing, negated: bool) -> Column:
        raise NotImplementedError

    def column(self, missing: Missing = Missing.SQL) -> Column:
        """True, false or (SQL) unknown for a row."""
        return self.build(missing, False)

    def rows(self, df: DataFrame, missing: Missing = Missing.SQL) -> DataFrame:
        return df.filter(self.column(missing))  # bare, so that it reaches the scan

    def __and__(self, other: Criterion) -> Criterion:
        return Both(self, other, True)

    def __or__(self, other: Criterion) -> Criterion:
        return Both(self, other, False)

    def __invert__(self) -> Criterion:
        return Negated(self)


@dataclass(frozen=True)
class Both(Criterion):
    left: Criterion
    right: Criterion
    conjunction: bool

    def build(self, missing: Missing, negated: bool) -> Column:
        a, b = self.left.build(missing, negated), self.right.build(missing, negated)
        return a & b if self.conjunction != negated else a | b


@dataclass(frozen=True)
class Negated(Criterion):
    of: Criterion

    def build(self, missing: Missing, negated: bool) -> Column:
        return self.of.build(missing, not negated)


@dataclass(frozen=True)
class Known(Criterion):
    """A column that is a criterion already; its NOT is the plain one."""

    value: Column

    def build(self, missing: Missing, negated: bool) -> Column:
        return values.resolve(~self.value if negated else self.value, missing, negated, negated)


def constant(value: bool | None) -> Criterion:
    """TRUE, FALSE or UNKNOWN; in the latter no dialect sees a missing field."""
    return Fixed(value)


@dataclass(frozen=True)
class Fixed(Criterion):
    value: bool | None

    def build(self, missing: Missing, negated: bool) -> Column:
        return F.lit(None if self.value is None else self.value != negated).cast("boolean")


@dataclass(frozen=True)
class Comparison(Criterion):
    op: str
    left: Field
    right: Any

    def build(self, missing: Missing, negated: bool) -> Column:
        other = self.right.value if isinstance(self.right, Field) else self.right if isinstance(self.right, Column) else F.lit(self.right)
        constant = isinstance(self.right, str)
        if constant and self.op in ("=", "<>") and self.left.rules != EXACT:
            # a rule or wildcard decides about equality; the opposite comparison is its NOT
            is_equal = (self.op == "=") != negated
            holds = lambda x: text.equals(x, self.right, self.left.rules) if is_equal else ~text.equals(x, self.right, self.left.rules)
            return self.left.test(holds, missing, negated)
        if isinstance(self.right, Field) and self.right.many:
            if self.left.many:
                return values.compare_all_pairs(self.op, self.left.value, self.right.value, missing, negated)
            turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(self.op, self.op)
            return values.compare_values(turned, self.right.value, self.left.value, missing, negated)
        rules = self.left.rules
        fold = (lambda x: rules.key(x)) if rules != EXACT and (constant or isinstance(self.right, Field)) else (lambda x: x)
        if self.left.many:
            op = values.OPPOSITE[self.op] if negated else self.op
            return self.left.test(lambda x: values.test(op, fold(x), fold(other)), missing, negated)
        return values.compare(self.op, fold(self.left.value), fold(other), missing, negated)


@dataclass(frozen=True)
class TextTest(Criterion):
    """A test of a text against a constant; under NOT its denial."""

    left: Field
    holds: Any

    def build(self, missing: Missing, negated: bool) -> Column:
        return self.left.test(lambda x: ~self.holds(x) if negated else self.holds(x), missing, negated)


@dataclass(frozen=True, eq=False)
class Field:
    """A column, or with ``many`` an array of a field's values."""

    value: Column
    many: bool = False
    rules: Rules = EXACT

    def test(self, holds: Any, missing: Missing, negated: bool) -> Column:
        if self.many:
            return values.resolve((values.every_value if negated else values.any_value)(self.value, holds), missing, negated, negated)
        return values.resolve(holds(self.value), missing, negated, negated)

    def equals(self, other: Any) -> Criterion:
        return Comparison("=", self, other)

    __eq__ = equals  # type: ignore[assignment]

    def __ne__(self, other: Any) -> Criterion:  # type: ignore[override]
        return Comparison("<>", self, other)

    def __lt__(self, other: Any) -> Criterion:
        return Comparison("<", self, other)

    def __le__(self, other: Any) -> Criterion:
        return Comparison("<=", self, other)

    def __gt__(self, other: Any) -> Criterion:
        return Comparison(">", self, other)

    def __ge__(self, other: Any) -> Criterion:
        return Comparison(">=", self, other)

    __hash__ = None  # type: ignore[assignment]

    def exists(self) -> Criterion:
        return Present(self)

    def matches(self, pattern: str) -> Criterion:
        return TextTest(self, lambda x: text.matches(x, pattern, self.rules))

    def match_begin(self, pattern: str) -> Criterion:
        return TextTest(self, lambda x: text.match_begin(x, pattern, self.rules))

    def match_end(self, pattern: str) -> Criterion:
        return TextTest(self, lambda x: text.match_end(x, pattern, self.rules))

    def contains(self, pattern: str) -> Criterion:
        return TextTest(self, lambda x: text.contains(x, pattern, self.rules))

    def sounds_like(self, words: str | Field) -> Criterion:
        """Every word of the constant sounds like some word of the field; of two fields, every word of this one like some word of the other."""
        if isinstance(words, Field):
            joined = [F.array_join(f.value, " ") if f.many else f.value for f in (self, words)]
            return Known(phonetic.sounds_alike(*joined))
        return TextTest(self, lambda x: phonetic.sounds_like(x, words)) if not self.many else Known(phonetic.sounds_like(F.array_join(self.value, " "), words))


@dataclass(frozen=True)
class Present(Criterion):
    """Existence is never unknown."""

    of: Field

    def build(self, missing: Missing, negated: bool) -> Column:
        there = values.any_present(self.of.value) if self.of.many else self.of.value.isNotNull()
        return ~there if negated else there


def field(column: str | Column, many: bool = False, rules: Rules = EXACT) -> Field:
    return Field(F.col(column) if isinstance(column, str) else column, many, rules)
