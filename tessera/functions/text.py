"""Text comparison rules, wildcards and the match operators.

Rules are applied in one fixed order, to both operands, to index keys and to sort keys alike:
underscores to spaces, other white space to spaces, dashes dropped, spaces dropped or compressed, ends
trimmed, case folded. Without a rule a text is compared as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    no_case: bool = False
    no_underscores: bool = False
    white_space_as_space: bool = False
    no_dashes: bool = False
    no_spaces: bool = False
    compress_spaces: bool = False
    ignore_leading: bool = False
    ignore_trailing: bool = False
    wild: bool = False
    collation: str | None = None

    def apply(self, text: Column) -> Column:
        """The text in the form in which it is compared."""
        if self.no_underscores:
            text = F.translate(text, "_", " ")
        if self.white_space_as_space:
            text = F.translate(text, "\t\n\r", "   ")
        if self.no_dashes:
            text = F.replace(text, F.lit("-"), F.lit(""))
        if self.no_spaces:
            text = F.replace(text, F.lit(" "), F.lit(""))
        elif self.compress_spaces:
            text = F.regexp_replace(text, " +", " ")
        if self.ignore_leading:
            text = F.ltrim(text)
        if self.ignore_trailing:
            text = F.rtrim(text)
        if self.no_case:
            text = F.lower(text)
        return text

    def key(self, text: Column) -> Column:
        """A column that sorts as the rules and the collation order texts."""
        own = self.apply(text)
        return F.collate(own, self.collation) if self.collation else own


EXACT = Rules()
#: What record queries start from: any case, and wildcards in constants.
RECORD_DEFAULT = Rules(no_case=True, wild=True)


def pattern_parts(pattern: str) -> list[str | None]:
    r"""A pattern's literal stretches; None for each ``*``. ``\*`` and ``\\`` are literal, as is a last ``\``."""
    parts: list[str | None] = []
    literal, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern) and pattern[i + 1] in "*\\":
            literal, i = literal + pattern[i + 1], i + 2
            continue
        if c == "*":
            if literal:
                parts.append(literal)
            parts.append(None)
            literal = ""
        else:
            literal += c
        i += 1
    return [*parts, literal] if literal else parts


def _folded(literal: str, rules: Rules) -> str:
    if rules.no_underscores:
        literal = literal.replace("_", " ")
    if rules.white_space_as_space:
        literal = re.sub(r"[\t\n\r]", " ", literal)
    if rules.no_dashes:
        literal = literal.replace("-", "")
    if rules.no_spaces:
        literal = literal.replace(" ", "")
    elif rules.compress_spaces:
        literal = re.sub(" +", " ", literal)
    return literal.lower() if rules.no_case else literal


def _like(text: Column, parts: list[str | None], rules: Rules) -> Column:
    """Whole-value match of literal stretches with any run between them."""
    folded = [None if p is None else _folded(p, rules) for p in parts]
    if rules.ignore_leading and folded and folded[0]:
        folded[0] = folded[0].lstrip(" ")
    if rules.ignore_trailing and folded and folded[-1]:
        folded[-1] = folded[-1].rstrip(" ")
    own = rules.apply(text)
    if None not in folded:
        return own == F.lit("".join(x or "" for x in folded))
    if folded[-1] is None and None not in folded[:-1]:
        return F.startswith(own, F.lit("".join(x or "" for x in folded)))
    if folded[0] is None and None not in folded[1:]:
        return F.endswith(own, F.lit("".join(x or "" for x in folded)))
    if folded[0] is None and folded[-1] is None and None not in folded[1:-1]:
        return F.contains(own, F.lit("".join(x or "" for x in folded)))
    regex = "".join(".*" if x is None else re.escape(x) for x in folded)
    return F.rlike(own, F.lit(rf"(?s)\A{regex}\z"))


def _literal(pattern: str, rules: Rules) -> list[str | None]:
    return pattern_parts(pattern) if rules.wild else [pattern]


def equals(text: Column, constant: str, rules: Rules = EXACT) -> Column:
    """Equality with a constant; its wildcards count under the rule ``wild``."""
    return _like(text, _literal(constant, rules), rules)


def matches(text: Column, pattern: str, rules: Rules = RECORD_DEFAULT) -> Column:
    """Whole-value match of a pattern."""
    return _like(text, pattern_parts(pattern), rules)


def match_begin(text: Column, pattern: str, rules: Rules = RECORD_DEFAULT) -> Column:
    return _like(text, [*_literal(pattern, rules), None], replace(rules, ignore_trailing=False))


def match_end(text: Column, pattern: str, rules: Rules = RECORD_DEFAULT) -> Column:
    return _like(text, [None, *_literal(pattern, rules)], replace(rules, ignore_leading=False))


def contains(text: Column, pattern: str, rules: Rules = RECORD_DEFAULT) -> Column:
    return _like(text, [None, *_literal(pattern, rules), None], replace(rules, ignore_leading=False, ignore_trailing=False))


def compare_texts(a: Column, b: Column, rules: Rules = EXACT) -> Column:
    """−1, 0 or 1 for two columns; wildcards never count between columns."""
    x, y = rules.key(a), rules.key(b)
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)


def binary_contains(value: Column, part: bytes) -> Column:
    """Byte search, without rules."""
    return F.contains(F.hex(value), F.lit(part.hex().upper())) & (F.instr(F.hex(value), part.hex().upper()) % 2 == 1) if part else value.isNotNull()


# XPath-style functions that the query language names.


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def substring_before(text: Column, mark: str) -> Column:
    return F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, 1)).when(text.isNotNull(), F.lit(""))


def substring_after(text: Column, mark: str) -> Column:
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).when(text.isNotNull(), F.lit(""))
