"""Harmonic packing of tokenised documents into fixed-capacity sequences.

Reciprocal-capacity classes: class k holds pieces of exactly ``capacity // k`` tokens, and a bin of
class k takes k of them. A document is cut into such pieces, largest first; what is left (shorter than
``capacity // MAX_CLASS``) belongs to the last class. Every worker fills its own bins, so there is no
shuffle and memory is bounded by one open bin for each class and one document's ids. When a worker has read its input, the
pieces of its open bins are laid end to end and cut at the capacity; the last, shorter stretch is cut
at powers of two, which need no padding.

Defined results: null and empty texts have only the end token; repeated rows are packed once each, as
rows of their own; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import of_texts, released

CAPACITY = 4096
END_ID = 2
#: Classes 1 to MAX_CLASS have pieces of one length each.
MAX_CLASS = 64
#: Distinct pieces whose ids a worker remembers, in two halves of some 10 MB each: when the younger is full it takes the older's place.
PIECE_CACHE = 100_000
#: Characters encoded together.
BATCH_CHARS = 1 << 18

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts, many texts at once.

    A text of Latin letters is split by arrays the way the tokenizer splits it (runs of letters, single
    digits, runs of other signs, English contractions); equal pieces get their ids once, from the
    tokenizer's model or from earlier batches. Any other text goes to the tokenizer whole. ``tests/llm``
    holds both ways against each other.
    """

    #: Code points beyond these make a text go to the tokenizer whole.
    OTHER = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
    LIMIT = 0x250
    SPACE, LETTER, DIGIT, SIGN = range(4)

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.kind = np.full(self.LIMIT, self.SIGN, dtype=np.uint8)
        for c in map(chr, range(self.LIMIT)):
            self.kind[ord(c)] = self.SPACE if c in " \t\n\v\f\r" else self.DIGIT if c in "0123456789" else self.LETTER if c.isalpha() else self.SIGN
        base = 0x9E3779B97F4A7C15
        self.powers = self._powers(base)
        self.inverses = self._powers(pow(base, -1, 1 << 64))
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in plain else next(rest)) for b in range(256)}

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(BATCH_CHARS + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def simple(self, text: str) -> bool:
        return (text.isascii() or not self.OTHER.search(text)) and not any(x in text for x in self.special)

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as bytes."""
        new = [x for x in pieces if x not in self.young]
        if len(self.young) + len(new) > PIECE_CACHE // 2:
            self.young, self.old = {}, self.young
            new = pieces
        young, old = self.young, self.old
        young.update((x, old[x]) for x in new if x in old)
        self.learn([x for x in new if x not in old])
        return [young[x] for x in pieces]

    def learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 2000):
            some = pieces[i : i + 2000]
            spelled = [x if x.isascii() and x.isalnum() else x.encode().decode("latin-1").translate(self.alphabet) for x in some]
            got = np.array(self.pieces.encode_batch_fast(["\n".join(spelled)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, until = got.tobytes(), ((np.flatnonzero(self.last[got]) + 1) * 4).tolist()  # each piece's last id is one that ends a word
            self.young.update((x, raw[a:b]) for x, a, b in zip(some, [0, *until[:-1]], until, strict=True))

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the pieces of a lower-cased simple text."""
        codes = np.frombuffer(text.encode("utf-16-le"), dtype=np.uint16)
        kind = self.kind[codes]
        change = np.empty(len(kind), dtype=bool)
        change[:1] = True
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)
        quotes = np.flatnonzero((codes == 39) & change)
        for i in quotes[quotes < len(codes) - 1]:
            two, three = text[i + 1], text[i + 1 : i + 3]
            n = 1 if two in "stmd" else 2 if three in ("re", "ve", "ll") else 0
            if n:
                change[i + 1] = False
                if i + 1 + n < len(codes):
                    change[i + 1 + n] = True
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(codes))
        real = kind[starts] != self.SPACE
        starts, ends = starts[real], ends[real]
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.powers[: len(codes)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverses[starts]
        return starts, ends, hashes ^ (hashes >> np.uint64(29))

    def encode_simple(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of simple texts of BATCH_CHARS characters together, line ends between them included."""
        text = "\n".join(texts).lower()
        starts, ends, hashes = self.split(text)
        if not len(starts):
            return [np.zeros(0, dtype="<u4")] * len(texts)
        code, unique = pd.factorize(hashes)
        first = np.empty(len(unique), dtype=np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        pieces = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        ids = self.known(pieces)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        own = sizes[code]
        until = np.cumsum(own)
        shift = (np.cumsum(sizes) - sizes)[code] - (until - own)
        stream = flat[np.repeat(shift, own) + np.arange(until[-1])]
        edges = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])[:-1])
        return np.split(stream, np.append(0, until)[edges])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, the end token included."""
        end = np.array([END_ID], dtype="<u4")
        waiting: list[str] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            for ids in self.encode_simple(waiting) if waiting else ():
                yield np.append(ids, end)
            waiting.clear()

        for text in texts:
            if not self.simple(text):
                yield from flush()
                size = 0
                yield np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], dtype="<u4")
            elif len(text) >= BATCH_CHARS:
                yield from flush()
                size = 0
                yield np.concatenate([*self.long(text), end])
            else:
                if size + len(text) + 1 > BATCH_CHARS:
                    yield from flush()
                    size = 0
                waiting.append(text)
                size += len(text) + 1
        yield from flush()

    def long(self, text: str) -> Iterator[np.ndarray]:
        """A text in stretches that end at white space."""
        at = 0
        while at < len(text):
            stop = at + BATCH_CHARS - 1
            if stop < len(text):
                space = max(text.rfind(c, at + 1, stop) for c in " \n\t")
                if space < 0:
                    yield np.array(self.tokenizer.encode(text[at:], add_special_tokens=False).ids, dtype="<u4")
                    return
                stop = space
            yield self.encode_simple([text[at:stop]])[0]
            at = stop


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process: later tasks find the pieces of earlier ones."""
    return Encoder(path)


def cut(length: int, capacity: int = CAPACITY, max_class: int = MAX_CLASS) -> list[tuple[int, int]]:
    """(class, tokens) of a document's pieces; class 0 is the last class, of shorter pieces."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest >= capacity // max_class and rest:
        k = -(-capacity // rest)
        while capacity // k > rest:
            k += 1
        out.append((k, capacity // k))
        rest -= capacity // k
    return out + [(0, rest)] * (rest > 0)


class Bins:
    """The open bins of one worker."""

    def __init__(self, first_sequence: int, capacity: int):
        self.sequence, self.capacity = first_sequence, capacity
        self.open: dict[int, list] = {}
        self.loose: list = []
        self.loose_size = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def add(self, kind: int, piece: tuple) -> None:
        if kind == 0:
            self.loose.append(piece)
            self.loose_size += len(piece[2])
            if self.loose_size >= self.capacity:
                self.lay(self.capacity)
            return
        pieces = self.open.setdefault(kind, [])
        pieces.append(piece)
        if len(pieces) == kind:
            self.close(self.open.pop(kind))

    def lay(self, size: int) -> None:
        """Close a sequence of exactly ``size`` tokens from the loose pieces, cutting the last."""
        taken, have = [], 0
        for i, (doc, start, ids, total) in enumerate(self.loose):
            if have + len(ids) <= size:
                taken.append((doc, start, ids, total))
                have += len(ids)
                rest = self.loose[i + 1 :]
            else:
                n = size - have
                taken += [(doc, start, ids[:n], total)] * (n > 0)
                rest = [(doc, start + n, ids[n:], total), *self.loose[i + 1 :]]
                have = size
            if have == size:
                break
        self.loose, self.loose_size = rest, self.loose_size - size
        self.close(taken)

    def finish(self) -> None:
        for kind in sorted(self.open):
            for piece in self.open.pop(kind):
                self.loose.append(piece)
                self.loose_size += len(piece[2])
        while self.loose_size >= self.capacity:
            self.lay(self.capacity)
        for bit in range(self.capacity.bit_length() - 1, -1, -1):
            if self.loose_size >> bit & 1:
                self.lay(1 << bit)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece, with its place in a sequence. A document may be cut into several pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = Bins(TaskContext.get().partitionId() << 33, capacity)

        def rows() -> pd.DataFrame:
            out = pd.DataFrame(bins.rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            bins.rows = []
            return out

        for batch in batches:
            for doc, tokens in zip(batch["doc_id"].tolist(), encoder(tokenizer_path).encode(batch["text"].tolist()), strict=True):
                start = 0
                for kind, n in cut(len(tokens), capacity):
                    bins.add(kind, (doc, start, tokens[start : start + n].copy(), len(tokens)))  # a view would keep the document's ids
                    start += n
            yield rows()
        bins.finish()
        yield rows()

    rows = of_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(released(run), SCHEMA)
