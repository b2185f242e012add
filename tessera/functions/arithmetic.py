"""64-bit whole-number arithmetic of the criteria language.

A missing operand gives a missing result; so do division and remainder by zero, and results that do not
fit (where unchecked machine arithmetic would wrap). Signed values are BIGINT, unsigned ones
DECIMAL(20,0) within 0 to 2**64 - 1. Operands of mixed signs give DECIMAL(20,0) within -2**63 to 2**64 - 1:
negative results are signed ones, all others unsigned. Quotients are cut toward zero. Bits are those of
signed numbers, or with ``unsigned_`` of unsigned ones, where a negative operand stands for its 64-bit pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSIGNED = "decimal(20,0)"
MOST_UNSIGNED = 2**64 - 1
LEAST_SIGNED = -(2**63)


def signed(value: Column) -> Column:
    """As BIGINT; text that is no number, and numbers beyond the range, are missing."""
    return value.try_cast("bigint")


def unsigned(value: Column) -> Column:
    """As an unsigned 64-bit number; missing outside its range."""
    number = value.try_cast(UNSIGNED)
    return F.when(number.between(0, F.lit(str(MOST_UNSIGNED)).cast(UNSIGNED)), number)


def add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def negate(a: Column) -> Column:
    return F.try_subtract(F.lit(0).cast("bigint"), a)


def divide(a: Column, b: Column) -> Column:
    """Quotient cut toward zero."""
    a, b = signed(a), signed(b)
    by = F.when(b.isin(0, -1), F.lit(None)).otherwise(b)
    return F.when(b == -1, negate(a)).otherwise(F.call_function("div", a, by))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign."""
    a, b = signed(a), signed(b)
    return F.when(b == -1, F.when(a.isNotNull(), F.lit(0).cast("bigint"))).otherwise(F.try_mod(a, b))


def unsigned_divide(a: Column, b: Column) -> Column:
    a, b = unsigned(a), unsigned(b)
    by = F.nullif(b, F.lit(0).cast(UNSIGNED))
    return ((a - a % by) / by).cast(UNSIGNED)


def unsigned_modulo(a: Column, b: Column) -> Column:
    return (unsigned(a) % F.nullif(unsigned(b), F.lit(0).cast(UNSIGNED))).cast(UNSIGNED)


def unsigned_add(a: Column, b: Column) -> Column:
    return unsigned(unsigned(a).cast("decimal(38,0)") + unsigned(b))


def unsigned_multiply(a: Column, b: Column) -> Column:
    return unsigned(F.try_multiply(unsigned(a).cast("decimal(38,0)"), unsigned(b).cast("decimal(38,0)")))


def unsigned_subtract(a: Column, b: Column) -> Column:
    return mixed_subtract(unsigned(a), unsigned(b))


def mixed(value: Column) -> Column:
    """A signed or unsigned 64-bit number; missing outside both ranges."""
    number = value.try_cast("decimal(38,0)")
    fits = number.between(F.lit(str(LEAST_SIGNED)).cast("decimal(38,0)"), F.lit(str(MOST_UNSIGNED)).cast("decimal(38,0)"))
    return F.when(fits, number).cast(UNSIGNED)


def mixed_add(a: Column, b: Column) -> Column:
    return mixed(mixed(a) + mixed(b))


def mixed_subtract(a: Column, b: Column) -> Column:
    return mixed(mixed(a) - mixed(b))


def mixed_multiply(a: Column, b: Column) -> Column:
    return mixed(F.try_multiply(mixed(a).cast("decimal(38,0)"), mixed(b).cast("decimal(38,0)")))


def mixed_divide(a: Column, b: Column) -> Column:
    a, b = mixed(a), mixed(b)
    by = F.nullif(b, F.lit(0).cast(UNSIGNED))
    return mixed((a - a % by) / by)


def mixed_modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign."""
    return (mixed(a) % F.nullif(mixed(b), F.lit(0).cast(UNSIGNED))).cast(UNSIGNED)


def _pattern(value: Column) -> Column:
    """The 64 bits of a number, as a BIGINT."""
    number = mixed(value)
    return F.when(number >= F.lit(str(2**63)).cast(UNSIGNED), (number - F.lit(str(2**64)).cast(UNSIGNED))).otherwise(number).cast("bigint")


def _number(bits: Column) -> Column:
    """The unsigned number of 64 bits."""
    return F.when(bits < 0, bits.cast(UNSIGNED) + F.lit(str(2**64)).cast(UNSIGNED)).otherwise(bits.cast(UNSIGNED)).cast(UNSIGNED)


def bit_and(a: Column, b: Column) -> Column:
    return signed(a).bitwiseAND(signed(b))


def bit_or(a: Column, b: Column) -> Column:
    return signed(a).bitwiseOR(signed(b))


def bit_xor(a: Column, b: Column) -> Column:
    return signed(a).bitwiseXOR(signed(b))


def unsigned_bit_and(a: Column, b: Column) -> Column:
    return _number(_pattern(a).bitwiseAND(_pattern(b)))


def unsigned_bit_or(a: Column, b: Column) -> Column:
    return _number(_pattern(a).bitwiseOR(_pattern(b)))


def unsigned_bit_xor(a: Column, b: Column) -> Column:
    return _number(_pattern(a).bitwiseXOR(_pattern(b)))


def wide(value: Column) -> Column:
    """For comparing signed with unsigned numbers."""
    return value.try_cast(UNSIGNED)
