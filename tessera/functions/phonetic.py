"""Words by sound: a table-driven reading of the published double metaphone algorithm.

A word's sounds are at most four of the symbols below, packed in four bits each; letters that are
spoken in two ways give a second code. Rules are tried in order at each place of the upper-cased word;
each has what precedes, the letters read, what follows, and the one or two sounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The algorithm's symbols (0 is the sound of TH), from 1 as four-bit numbers.
SYMBOLS = "AFHJKLMNPRSTX0"
LENGTH = 4

# Letters and their sounds, as "before|letters|after|sounds"; ^ and $ are a word's ends.
RULES = """
^|GN||N
^|KN||N
^|PN||N
^|WR||R
^|PS||S
^|X||S
^|WH||A
^|W|[AEIOUY]|A F
^|UE?||A
^|[AEIOY]||A
|[AEIOUY]||
M|B|$|
|BB?||P
|Ç||S
^|CAESAR||SSR
|CHIA||KA
^A?R|CH||K
^|CH|A(RAC|RIS)|K
^|CH|OR[^E]|K
^|CH|[YI]M|K
^|CH|EM|K
(^VAN |^VON |^SCH)|CH||K
|CHT||KT
^MI|CH|A|K X
|CH|[LRNMBHFVW]|K
^M|C|C|K
^|CH||X
|CH||X K
^W?I|CZ||X S
|CZ||S X
|CIA||X
^MA?|CC||K
|CC|[IEH]|KS
|CC||K
|C[KGQ]||K
|CI[OE]||S X
|C|[IEY]|S
|C C?||K
|C||K
|DG|[IEY]|J
|DG||TK
|D[TD]||T
|D||T
|FF?||F
[^AEIOUY]|GH||K
^|GHI||J
^|GH||K
[BHD].|GH||
[BHD]..|GH||
[CGLRT].?U|GH||F
|GH|T|
|GH||
|GN$||N KN
|GN||KN N
|GLI||KL L
^|G|[EIY]|K J
|GG|[EIY]|J K
|G|ER$|K J
|G|[EIY]|J K
|GG?||K
^|H|[AEIOUY]|H
[AEIOUY]|H|[AEIOUY]|H
|H||
^|JOSE||H
^SAN |J||H
^|J||J A
[AEIOUY]|J|[AO]|J H
|J|$|J
|JJ?||J
|KK?||K
[I]|LL|[OA]S?$|L
|LL?||L
U|MB|$|M
|MM?||M
|NN?||N
|Ñ||N
|PH||F
|P[PB]?||P
|QQ?||K
IE|R|$| R
|RR?||R
[IY]|SL||L
^|SUGAR||XKR SKR
|SH|EIM|S
|SH|OE[KM]|S
|SH||X
|SI[OA]||S X
^|S|[MNLW]|S X
|SZ||S X
|SCH|(OO|ER|EN|UY|ED|EM)|SK
|SCH||X
|SC|[IEY]|S
|SC||SK
[AO]I|S|$| S
|S[SZ]?||S
|TION||XN
|TI[AO]||X
|TCH||X
|TH|[OA]M|T
|TTH||0 T
|TH||0 T
|T[TD]?||T
|VV?||F
|WR||R
[AEIOUY]|W|$| F
|WI[CT]Z||TS FX
|W||
[AEO]U|X|$|
|X||KS
|ZH||J
|ZZ?[OIA]||S TS
|ZZ?||S
"""


def _parts(line: str) -> list[str]:
    """The four parts of a rule; bars within parentheses are their own."""
    return re.split(r"\|(?![^(]*\))", line)


def _compiled() -> list[tuple[re.Pattern[str] | None, re.Pattern[str], list[str]]]:
    out = []
    for line in RULES.strip().splitlines():
        before, letters, after, sounds = _parts(line)
        look = f"{letters}(?={after})" if after else letters
        behind = re.compile(f"(?:{before})\\Z") if before else None
        out.append((behind, re.compile(look), sounds.split(" ") if " " in sounds else [sounds]))
    return out


_RULES: list | None = None


def sounds(word: str) -> list[str]:
    """One or two strings of SYMBOLS."""
    global _RULES
    if _RULES is None:
        _RULES = _compiled()
    word = word.upper()
    first, second, at = "", "", 0
    while at < len(word) and min(len(first), len(second)) < LENGTH:
        for behind, letters, made in _RULES:
            m = letters.match(word, at)
            if m and m.end() > at and (behind is None or behind.search(word[:at]) is not None):
                first, second, at = first + made[0], second + made[-1], m.end()
                break
        else:
            at += 1
    first, second = first[:LENGTH], second[:LENGTH]
    return [first] if first == second else [first, second]


def packed(code: str) -> int:
    """Four bits for each symbol, the first one highest."""
    out = 0
    for c in code.ljust(LENGTH):
        out = out << 4 | (SYMBOLS.index(c) + 1 if c != " " else 0)
    return out


_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=100_000)
def _codes(word: str) -> tuple[int, ...]:
    """A word's codes; a worker works each word out once, while it is among the latest."""
    return tuple(packed(x) for x in sounds(word))


def codes_of_words(text: str) -> list[tuple[int, ...]]:
    return [_codes(w) for w in _WORD.findall(text)]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def word_codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All codes of a text's words; null for null."""
    for texts in batches:
        yield pd.Series([None if t is None else sorted({c for w in codes_of_words(t) for c in w}) for t in texts], dtype=object)


def word_sounds_alike(driving: str, other: str) -> bool:
    wanted, known = codes_of_words(driving), {c for w in codes_of_words(other) for c in w}
    return bool(wanted) and all(not known.isdisjoint(codes) for codes in wanted)


@F.pandas_udf(T.BooleanType())
def sounds_alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether each word of the driving column sounds, in one of its ways, like some word of the other; null for null.

    Of two columns the left one drives; a constant drives wherever it stands (``sounds_like``).
    """
    for driving, other in batches:
        yield pd.Series([None if a is None or b is None else word_sounds_alike(a, b) for a, b in zip(driving, other, strict=True)], dtype=object)


def sounds_like(text: Column, words: str) -> Column:
    """Whether each word of the constant sounds, in one of its ways, like some word of the text."""
    wanted = codes_of_words(words)
    known = word_codes(text)
    found = F.lit(bool(wanted))
    for codes in wanted:
        found = found & F.arrays_overlap(known, F.array(*[F.lit(c) for c in codes]))
    return F.when(text.isNotNull(), found)
