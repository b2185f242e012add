"""Personal data: identifiers in plain and in disguised form, with places in the source text.

Two transducers rewrite a text and keep, for each character they put out, where it came from. The first
maps look-alike letters, wide and foreign digits to ASCII and drops invisible characters; the second maps
at/dot disguises and runs of spelled digits. The same detectors run on the source and on the rewritten
text; what only the rewritten text shows is mapped back to source characters and added.

Defined results: null and empty texts have no spans; repeated rows give repeated results; texts of any
length are read whole, in time in proportion to their length, each held once with its rewritten form; other
columns are kept, but for one named as the result is, which it replaces.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import of_texts

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base identifiers, written so that no text takes more than linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Identifiers as they stand, by kind and then start."""
    out = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# Greek, Cyrillic and odd Latin letters that look like ASCII ones.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρικτυγσЅІЈУӀԌԚԜѴѵԛԝϹϲϳıɡɑ",
        "ABEKMHOPCTXaeopcyxijsdhlABEZHIKMNOPTYXoavpiktuyoSIJYIGQWVvqwCcjiga",
        strict=True,
    )
)
INVISIBLE = set("\u00ad\u200b\u200c\u200d\u2060\ufeff")
SEPARATORS = {"\u3002": ".", "\u2024": ".", "\ufe52": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " "}
# Spelled digits, signs and dots in English, German, Spanish and French.
SPELLED = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve",
        "zéro un deux trois quatre cinq six sept huit neuf", "oh", "o", "_ _ zwo _ _ fuenf",
    )
    for i, w in enumerate(words.split())
    if w != "_"
}
PLUS = ("plus", "más", "mas")
DOTS = ("dot", "punkt", "punto", "point")

_DIGIT = f"(?:{'|'.join(sorted((w for w in SPELLED if w not in ('o', 'oh')), key=len, reverse=True))})"
_WORDED = "|".join(DOTS)
_PLUS = "|".join(PLUS)
_HOST = "[A-Za-z0-9-]+"
_DOT = rf"(?:\s*[\[({{<]\s*(?:{_WORDED}|\.)\s*[\])}}>]\s*|\s+dot\s+)"
#: Dots in words or among spaces that prose has too: they count within a disguised host only.
_OWN = r"\s+(?:punkt|punto|point|\.)\s+"
_ANY = rf"(?:{_DOT}|{_OWN}|\.)"
# Endings by which a host in words ("at mail dot example dot com") is told from prose; all country codes.
_COUNTRIES = (
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bl bm bn bo bq br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
    "de dj dk dm do dz ec ee eg eh er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it "
    "je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mf mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz "
    "om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz "
    "ua ug uk um us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).split()
_ENDING = f"(?:com|org|net|edu|gov|mil|int|info|biz|dev|app|example|test|invalid|{'|'.join(_COUNTRIES)})"
_HOSTS = rf"{_HOST}(?:{_ANY}{_HOST})*?{_ANY}{_ENDING}\b"
_RULES = re.compile(
    rf"(?P<at>(?<!\s)\s*[\[({{<]\s*(?:at|@|ät|arroba|arobase?)\s*[\])}}>]\s*(?=(?P<host1>{_HOSTS})?[A-Za-z0-9-])"
    rf"|(?<!\s)\s+(?:@|ät|arroba|arobase?)\s+(?=(?P<host2>{_HOSTS}))"
    rf"|(?<!\s)\s+at\s+(?=(?P<host3>{_HOST}(?:(?:{_DOT}|\s+(?:punkt|punto)\s+){_HOST})*?(?:{_DOT}|\s+(?:punkt|punto)\s+){_ENDING}\b)))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9]))"
    rf"|(?P<own>(?<=[A-Za-z0-9]){_OWN}(?=[A-Za-z0-9]))"
    rf"|(?P<digits>\b(?:(?:{_PLUS})[\s,-]+)?{_DIGIT}(?:[\s,-]+(?:{_DIGIT}|oh|{_WORDED}))*[\s,-]+{_DIGIT}\b)",
    re.I,
)
# One of these is in each lower-cased text that a rule changes: a disguise in brackets, an at in words or among spaces with a
# host behind it, a dot in words, or the last two words of a run of digits.
_BRACKETS = re.compile(rf"[\[({{<]\s*(?:at|@|ät|arroba|arobase?|{_WORDED}|\.)\s*[\])}}>]")
_LAST = re.compile(rf"\sdot\s|\s(?:@|ät|arroba|arobase?)\s|\sat\s+{_HOST}\s+(?:punkt|punto)\s|[\s,-](?:oh|{_WORDED})[\s,-]+{_DIGIT}\b|\b{_DIGIT}[\s,-]+{_DIGIT}\b")
_WORD = re.compile(r"[^\W\d_]+")


@cache
def letter(c: str) -> str:
    """The ASCII character that ``c`` stands for, nothing for an invisible one, or else ``c``."""
    if c < "\x80":
        return c
    if c in INVISIBLE:
        return ""
    new = LOOKALIKES.get(c) or SEPARATORS.get(c)
    if new is None:
        digit = unicodedata.digit(c, None)
        new = str(digit) if digit is not None and not unicodedata.category(c).startswith("No") else None
    if new is None:
        wide = unicodedata.normalize("NFKC", c)
        new = wide if len(wide) == 1 and wide < "\x80" else c
    return new


def letters(text: str) -> tuple[str, list[int]]:
    """First transducer: one ASCII character for each character that stands for one, and its place."""
    out, places = [], []
    for i, c in enumerate(text):
        if new := letter(c):
            out.append(new)
            places.append(i)
    return "".join(out), places


def words(text: str, places: list[int] | range, length: int) -> tuple[str, list[int], list[int]]:
    """Second transducer: disguises and spelled digits; the start and end in the source of each character."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def copy(a: int, b: int) -> None:
        out.append(text[a:b])
        starts.extend(places[a:b])
        ends.extend(p + 1 for p in places[a:b])

    def put(c: str, a: int, b: int) -> None:
        out.append(c)
        starts.append(places[a])
        ends.append(places[b - 1] + 1)

    done = host = 0
    for m in _RULES.finditer(text):
        if m["own"] is not None and m.start() >= host:
            continue  # prose
        copy(done, m.start())
        done = m.end()
        if m["at"] is not None:
            put("@", *m.span())
            host = max(m.end(x) for x in ("host1", "host2", "host3"))
        elif m["dot"] is not None or m["own"] is not None:
            put(".", *m.span())
        else:
            for w in _WORD.finditer(m[0]):
                word = w[0].lower()
                put("+" if word in PLUS else "." if word in DOTS else SPELLED[word], m.start() + w.start(), m.start() + w.end())
    copy(done, len(text))
    return "".join(out), starts, ends


def disguised(text: str) -> bool:
    """Whether a transducer changes the text; asks both, so that it is never narrower than they are."""
    if not text.isascii() and any(letter(c) != c for c in set(text)):
        return True
    low = text.lower()
    return (_BRACKETS.search(low) or _LAST.search(low)) is not None and _RULES.search(text) is not None


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans; those and the ones that only the rewritten text shows, in the same order."""
    base = base_spans(text)
    if not disguised(text):
        return base, base
    plain, places = letters(text)
    rewritten, starts, ends = words(plain, places, len(text))
    if rewritten == text:
        return base, base
    found = set(base)
    for kind, a, b in base_spans(rewritten):
        span = (kind, starts[a], ends[b - 1])
        if not any(k == kind and s < span[2] and span[1] < e for k, s, e in base):
            found.add(span)
    return base, sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def write(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


@F.pandas_udf(RESULT)
def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = RESULT.names
    for texts in batches:
        rows = []
        for text in texts:
            base, spans = all_spans(text or "")
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(write(base).encode()).hexdigest(), write(spans)))
        yield pd.DataFrame(rows, columns=names)


def redact_text(text: str) -> str:
    """Each span, or union of overlapping spans, as the upper-case name of its first kind."""
    merged: list[list] = []
    for kind, a, b in sorted(all_spans(text)[1], key=lambda x: (x[1], -x[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, done = [], 0
    for kind, a, b in merged:
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*out, text[done:]]) if merged else text


@F.pandas_udf(T.StringType())
def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else redact_text(t) for t in texts], dtype=object)


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``pii``: counts and digest of the base spans, and all spans."""
    return of_texts(docs).withColumn("pii", find(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return of_texts(docs).withColumn(text_col, redacted(F.col(text_col)))
