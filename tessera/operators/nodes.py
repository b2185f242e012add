"""XML documents as a table of nodes, and navigation as joins.

A node has a number in document order (``pre``, also its id within its document), the number after its
last descendant (``last``), its parent, its place among its siblings, kind, name, namespace, value and depth.
An axis is a semi-join on the document and a number: the parent's for children, siblings and attributes; for
descendants and ancestors a block of BLOCK numbers, within which a range is compared, so that a large document
is many keys; for what follows or precedes the outermost context of a document is all that matters.
Attributes are nodes of their own kind that only the attribute axis reaches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.written import written

COLUMNS = ["doc_id", "pre", "last", "parent", "sibling", "depth", "kind", "name", "ns", "value", "first_child", "last_child", "next_sibling", "prev_sibling"]
SCHEMA = "doc_id bigint, pre bigint, last bigint, parent bigint, sibling bigint, depth int, kind string, name string, ns string, value string, first_child bigint, last_child bigint, next_sibling bigint, prev_sibling bigint"


KINDS = ["element", "attribute", "text", "cdata", "comment", "pi"]
ELEMENT, ATTRIBUTE, TEXT, CDATA, COMMENT, PI = range(6)


class Shredder:
    """Nodes of documents, one after another; a document that is not well-formed leaves nothing.

    The parser's events leave kinds, names, values and parents; all other numbers follow from these for many documents at once.
    """

    def __init__(self) -> None:
        self.kinds, self.documents = bytearray(), []  # id and nodes of each document
        self.names: list[str | None] = []
        self.values: list[str | None] = []
        self.parents: list[int] = []
        self.opened: list[int] = []
        self.closed: list[int] = []
        self.stack, self.parts, self.declared = [-1], [], []
        self.handlers = self._handlers()

    def _handlers(self) -> dict[str, Callable]:
        """They refer to no parser, so that parsers go at once and not when cycles are looked for."""
        kinds, names, values, parents, opened, closed = self.kinds, self.names, self.values, self.parents, self.opened, self.closed
        stack, parts, declared = self.stack, self.parts, self.declared

        def leaf(kind: int, name: str | None, value: str) -> None:
            kinds.append(kind)
            names.append(name)
            values.append(value)
            parents.append(stack[-1])

        def flush(kind: int = TEXT) -> None:
            value = "".join(parts)
            parts.clear()
            if len(stack) > 1 and value and (kind == CDATA or not value.isspace()):
                leaf(kind, None, value)

        def start(name: str, attributes: list[str]) -> None:
            if parts:
                flush()
            here = len(kinds)
            kinds.append(ELEMENT)
            names.append(name)
            values.append(None)
            parents.append(stack[-1])
            stack.append(here)
            if declared:
                attributes = attributes + declared
                declared.clear()
            if attributes:
                names.extend(attributes[::2])
                values.extend(attributes[1::2])
                many = len(attributes) >> 1
                kinds.extend((ATTRIBUTE,) * many)
                parents.extend((here,) * many)

        def end(_: str) -> None:
            if parts:
                flush()
            opened.append(stack.pop())
            closed.append(len(kinds) - 1)

        def entity(*_: object) -> None:
            raise expat.ExpatError("entities declared by a document are not expanded")

        return {
            "StartElementHandler": start, "EndElementHandler": end, "CharacterDataHandler": parts.append, "EntityDeclHandler": entity,
            "CommentHandler": lambda value: (flush(), leaf(COMMENT, None, value)), "ProcessingInstructionHandler": lambda name, value: (flush(), leaf(PI, name, value)),
            "StartCdataSectionHandler": flush, "EndCdataSectionHandler": lambda: flush(CDATA),
            # declared prefixes are nodes of the namespace axis; a default namespace is its elements' own
            "StartNamespaceDeclHandler": lambda prefix, uri: declared.extend((f"xmlns\n{prefix}", uri or "")) if prefix else None,
        }

    def add(self, own: int | None, text: str) -> None:
        base, ended = len(self.kinds), len(self.opened)
        parser = expat.ParserCreate(namespace_separator="\n")
        parser.ordered_attributes = parser.buffer_text = True
        for name, handler in self.handlers.items():
            setattr(parser, name, handler)
        try:
            parser.Parse(text, True)
        except expat.ExpatError:
            for column in (self.kinds, self.names, self.values, self.parents):
                del column[base:]
            del self.opened[ended:], self.closed[ended:], self.stack[1:], self.parts[:], self.declared[:]
        self.documents.append((own, len(self.kinds) - base))

    def batch(self) -> pa.RecordBatch:
        kinds = np.frombuffer(bytes(self.kinds), dtype=np.uint8)
        sizes = np.array([n for _, n in self.documents], dtype=np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        last = np.arange(len(kinds))
        last[np.array(self.opened, dtype=np.int64)] = self.closed
        inner = kinds == ELEMENT
        depth = np.cumsum(inner) - inner - np.cumsum(np.bincount(last[inner] + 1, minlength=len(kinds) + 1))[: len(kinds)]
        names = pa.array(self.names, pa.string()).dictionary_encode()
        known = [x.rpartition("\n") for x in names.dictionary.to_pylist()]
        texts = {
            "kind": pa.array(KINDS).take(pa.array(kinds)), "name": pa.array([x[2] or None for x in known], pa.string()).take(names.indices),
            "ns": pa.array([x[0] or None for x in known], pa.string()).take(names.indices), "value": pa.array(self.values, pa.string()),
        }
        ids = pa.array([d for d, _ in self.documents], pa.int64()).take(pa.array(doc))
        return _batch(doc, ids, last, np.array(self.parents, dtype=np.int64), depth, kinds != ATTRIBUTE, texts)


def _batch(doc: np.ndarray, ids: pa.Array, last: np.ndarray, parent: np.ndarray, depth: np.ndarray, plain: np.ndarray, texts: dict[str, pa.Array]) -> pa.RecordBatch:
    """The node table of whole documents, whose numbers are still places in the batch (-1: none).

    ``doc`` is a document's place; siblings, neighbours and outer children follow from parents and order, without attributes and the like.
    """
    rows = np.flatnonzero(plain)
    family = np.where(parent[rows] < 0, -1 - doc[rows], parent[rows])
    order = np.argsort(family, kind="stable")
    rows, family = rows[order], family[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = family[1:] != family[:-1]
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(rows))[: len(first)]
    numbers = {c: np.full(len(doc), -1) for c in ("sibling", "first_child", "last_child", "next_sibling", "prev_sibling")}
    numbers["sibling"][rows] = np.arange(len(rows)) - np.repeat(first, ends - first) + 1
    numbers["prev_sibling"][rows[1:]] = np.where(new[1:], -1, rows[:-1])
    numbers["next_sibling"][rows[:-1]] = np.where(new[1:], -1, rows[1:])
    below = family[first] >= 0
    numbers["first_child"][family[first][below]] = rows[first[below]]
    numbers["last_child"][family[first][below]] = rows[ends[below] - 1]
    base = np.searchsorted(doc, doc)
    for c, v in {**numbers, "pre": np.arange(len(doc)), "last": last, "parent": parent}.items():
        numbers[c] = v if c == "sibling" else np.where(v < 0, -1, v - base)
    arrays = {c: pa.array(v, pa.int64(), mask=v < 0) for c, v in numbers.items()}
    out = arrays | texts | {"doc_id": ids, "depth": pa.array(depth, pa.int32())}
    return pa.RecordBatch.from_arrays([out[c] for c in COLUMNS], names=COLUMNS)


#: Documents, and characters of them, whose nodes are handed on together; a longer document is handed on by itself.
DOCUMENTS = 500
CHARACTERS = 1 << 19

#: What only the parser's events tell right: references, line ends to change, instructions, CDATA, a DTD, namespaces, a byte order mark.
EVENTFUL = "&|\r|<\\?|<!\\[|<!D|xml|\ufeff"
_HEAD = re.compile(r"([^ \t\n/]+)[ \t\n]*([^ \t\n/=]*)")


def _well_formed(text: bytes) -> bool:
    try:
        return bool(expat.ParserCreate("utf-8", "\n").Parse(text, True))
    except expat.ExpatError:
        return False


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Texts at rising places of UTF-8 bytes."""
    places = np.empty(2 * len(begin) + 1, dtype=np.int32)
    places[:-1:2], places[1::2], places[-1] = begin, end, end[-1] if len(end) else 0
    return pa.StringArray.from_buffers(2 * len(begin), pa.py_buffer(places), pa.py_buffer(data)).take(pa.array(np.arange(0, 2 * len(begin), 2)))


def _places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text array's bytes and where each text begins in them; the last place is their end."""
    texts = pa.concat_arrays([texts.fill_null(""), pa.array([], pa.string())])  # begins at 0 with a buffer of its own
    _, places, data = texts.buffers()
    at = np.frombuffer(places, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _irregular(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which well-formed documents have a < or > inside of a comment, text or attribute, or single quotes within a tag."""
    marks = np.flatnonzero((data == ord("<")) | (data == ord(">")))
    doc = np.searchsorted(at, marks, "right") - 1
    many = np.bincount(doc, minlength=len(at) - 1)
    closes = data[marks] == ord(">")
    bad = many % 2 == 1
    bad[doc[closes != ((np.arange(len(marks)) - (np.cumsum(many) - many)[doc]) % 2 == 1)]] = True
    fine = ~bad[doc]
    begin, end, doc = marks[fine & ~closes], marks[fine & closes], doc[fine & closes]
    comment = data[begin + 1] == ord("!")
    bad[doc[comment & ((end - begin < 6) | (data[end - 1] != ord("-")) | (data[end - 2] != ord("-")))]] = True
    single = np.flatnonzero(data == ord("'"))
    near = np.searchsorted(begin, single) - 1
    inside = (near >= 0) & (single < end[near]) & ~comment[near] if len(begin) else np.zeros(len(single), dtype=bool)
    bad[doc[near[inside]]] = True
    return bad


def _tokens(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The nodes of well-formed, regular documents, by the places of their < > and ", for all of them at once."""
    data, at = _places(texts)
    begin, end = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
    doc = np.searchsorted(at, begin, "right") - 1
    first = data[begin + 1]
    closing, comment = first == ord("/"), first == ord("!")
    element = ~closing & ~comment
    opening = element & (data[end - 1] != ord("/"))
    after = np.cumsum(opening.astype(np.int64) - closing)
    # attributes: pairs of quotes within tags
    quotes = np.flatnonzero(data == ord('"'))
    near = np.searchsorted(begin, quotes) - 1
    inside = (near >= 0) & (quotes < end[near]) & element[near]
    opened, closed, tag = quotes[inside][::2], quotes[inside][1::2], near[inside][::2]
    attributes = np.bincount(tag, minlength=len(begin))
    # texts: behind each tag or comment, up to the next; not beside the outermost element
    upto = np.append(begin[1:], len(data))
    follows = (after > 0) & (upto > end + 1)
    behind = _slices(data, end[follows] + 1, upto[follows])
    follows[follows] = ~pc.utf8_is_space(behind).to_numpy(zero_copy_only=False)
    # numbers of nodes
    many = np.where(closing, 0, 1 + attributes) + follows
    base = np.cumsum(many) - many
    total = int(many.sum())
    kinds, plain = np.full(total, TEXT, dtype=np.uint8), np.ones(total, dtype=bool)
    kinds[base[element]], kinds[base[comment]] = ELEMENT, COMMENT
    new = np.ones(len(tag), dtype=bool)
    new[1:] = tag[1:] != tag[:-1]
    place = np.arange(len(tag)) - np.maximum.accumulate(np.where(new, np.arange(len(tag)), 0)) if len(tag) else tag
    attribute = base[tag] + 1 + place
    kinds[attribute], plain[attribute] = ATTRIBUTE, False
    text = (base + many - 1)[follows]
    # an element's end is the next tag of its level that closes one; a node's parent is the last one opened on the level above
    level = np.where(opening, after, after + closing)  # of what a tag opens or closes
    paired = np.flatnonzero(opening | closing)
    paired = paired[np.argsort(level[paired], kind="stable")]
    last = np.arange(total)
    last[base[paired[::2]]] = base[paired[1::2]] - 1
    alone = element & ~opening
    last[base[alone]] = (base + attributes)[alone]
    depth, parent = np.zeros(total, dtype=np.int64), np.full(total, -1)
    depth[base[element | comment]] = (after - opening)[element | comment]
    depth[text] = after[follows]
    nodes = np.flatnonzero(plain)
    opener = base[opening]
    where_, levels = np.concatenate([opener, nodes]), np.concatenate([depth[opener] + 1, depth[nodes]])
    order = np.lexsort((np.arange(len(where_)) >= len(opener), where_, levels))
    # a node that opens a level stands before those within it; on its own level it comes after what holds it
    seen = np.maximum.accumulate(np.where(order < len(opener), np.arange(len(order)), -1))
    inner = (order >= len(opener)) & (levels[order] > 0)
    parent[where_[order[inner]]] = where_[order[seen[inner]]]
    parent[attribute], depth[attribute] = base[tag], (after - opening)[tag] + 1
    # names: the few heads of tags and what stands between attributes
    least = end.copy()
    least[tag[new]] = opened[new]
    heads = _slices(data, begin[element] + 1, least[element]).dictionary_encode()
    pairs = [_HEAD.match(x).groups() for x in heads.dictionary.to_pylist()]
    between = _slices(data, np.append(-1, closed[:-1])[~new] + 1, opened[~new]).dictionary_encode()
    known = [x for x, _ in pairs] + [y for _, y in pairs] + [x.strip(" \t\n=") for x in between.dictionary.to_pylist()]
    own = heads.indices.to_numpy()
    named = np.full(total, -1)
    named[base[element]] = own
    rank = np.cumsum(element) - 1
    named[attribute[new]] = len(pairs) + own[rank[tag[new]]]
    named[attribute[~new]] = 2 * len(pairs) + between.indices.to_numpy()
    names = pa.array(known, pa.string()).take(pa.array(named, pa.int64(), mask=named < 0))
    # values
    left, right = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
    left[base[comment]], right[base[comment]] = begin[comment] + 4, end[comment] - 2
    left[attribute], right[attribute] = opened + 1, closed
    left[text], right[text] = end[follows] + 1, upto[follows]
    valued = kinds != ELEMENT
    values = _slices(data, left[valued], right[valued])
    values = pc.if_else(pa.array(kinds[valued] == ATTRIBUTE), pc.replace_substring_regex(values, "[\t\n]", " "), values) if np.isin(data, (9, 10)).any() else values
    values = values.take(pa.array(np.cumsum(valued) - 1, pa.int64(), mask=~valued))
    owner = np.repeat(doc, many)
    columns = {"kind": pa.array(KINDS).take(pa.array(kinds)), "name": names, "ns": pa.nulls(total, pa.string()), "value": values}
    return _batch(owner, ids.take(pa.array(owner)), last, parent, depth, plain, columns)


def _shred(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The nodes of some documents. The parser checks every one; its events are needed only for those with what EVENTFUL or ``_irregular`` finds."""
    events = pc.fill_null(pc.match_substring_regex(texts, EVENTFUL), False).to_numpy(zero_copy_only=False)
    data, at = _places(texts)
    view = memoryview(data)
    sound = np.array([not e and _well_formed(view[a:b]) for e, a, b in zip(events, at[:-1].tolist(), at[1:].tolist(), strict=True)], dtype=bool)
    odd = _irregular(data, at) & sound
    plain = sound & ~odd
    if plain.any():
        yield _tokens(ids.filter(pa.array(plain)), texts.filter(pa.array(plain)))
    rest = events | odd
    if rest.any():
        out = Shredder()
        for own, text in zip(ids.filter(pa.array(rest)).to_pylist(), texts.filter(pa.array(rest)).to_pylist(), strict=True):
            out.add(own, text or "")
        yield out.batch()


def import_documents(docs: DataFrame, id_col: str, xml_col: str, columns: list[str] = COLUMNS) -> DataFrame:
    """The node table of a column of documents, or some columns of it: Spark can't see that others are not asked for."""
    schema = ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in columns)
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("xml").cast(pa.string())
            begun, chars = 0, 0
            for i, n in enumerate(pc.utf8_length(texts).fill_null(0).to_pylist()):
                chars += n
                if i > begun and (chars > CHARACTERS or i - begun == DOCUMENTS):
                    yield from (x.select(columns) for x in _shred(ids.slice(begun, i - begun), texts.slice(begun, i - begun)))
                    begun, chars = i, n
            yield from (x.select(columns) for x in _shred(ids.slice(begun), texts.slice(begun)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(xml_col).alias("xml")).mapInArrow(run, schema)


def rejected(docs: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """Documents that left no nodes: those not well-formed, or with entities of their own."""
    return docs.join(nodes.filter("depth = 0").select(F.col("doc_id").alias(id_col)), id_col, "left_anti")


AXES = (
    "self", "child", "parent", "descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "following-sibling",
    "preceding-sibling", "following", "preceding", "attribute", "namespace", "root",
)


#: Numbers of a document that make one key of a join by range.
BLOCK = 1 << 16
#: Axes on which positions count backwards.
REVERSE = {"parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling"}
MARKS = ("doc_id", "pre", "last", "parent", "sibling", "kind")


def _related(axis: str, c: Callable[[str], Column], n: Callable[[str], Column]) -> Column:
    """Whether node ``n`` is on the axis of context ``c``, both of one document; ``c`` and ``n`` name their columns."""
    plain = ~n("kind").isin("attribute", "annotation")
    above = (n("pre") < c("pre")) & (n("last") >= c("pre")) & (n("kind") == "element")
    return {
        "self": lambda: n("pre") == c("pre"),
        "child": lambda: (n("parent") == c("pre")) & plain,
        "parent": lambda: n("pre") == c("parent"),
        "descendant": lambda: n("pre").between(c("pre") + 1, c("last")) & plain,
        "descendant-or-self": lambda: n("pre").between(c("pre"), c("last")) & (plain | (n("pre") == c("pre"))),
        "ancestor": lambda: above,
        "ancestor-or-self": lambda: (n("pre") == c("pre")) | above,
        "following-sibling": lambda: n("parent").eqNullSafe(c("parent")) & (n("sibling") > c("sibling")),
        "preceding-sibling": lambda: n("parent").eqNullSafe(c("parent")) & (n("sibling") < c("sibling")),
        "following": lambda: (n("pre") > c("last")) & plain,
        "preceding": lambda: (n("last") < c("pre")) & plain,
        "attribute": lambda: (n("parent") == c("pre")) & (n("kind") == "attribute") & (F.coalesce(n("ns"), F.lit("")) != "xmlns"),
        "namespace": lambda: (n("parent") == c("pre")) & (n("kind") == "attribute") & (n("ns") == "xmlns"),
        "root": lambda: n("depth") == 0,
    }[axis]()


def _outermost(context: DataFrame, axis: str) -> DataFrame:
    """The contexts that matter on an axis where one of a document, or of a parent's children, reaches all that the others do."""
    if axis == "following":
        return context.groupBy("doc_id").agg(F.min("last").alias("last"))
    if axis == "preceding":
        return context.groupBy("doc_id").agg(F.max("pre").alias("pre"))
    if axis in ("following-sibling", "preceding-sibling"):
        return context.groupBy("doc_id", "parent").agg((F.min if axis == "following-sibling" else F.max)("sibling").alias("sibling"))
    return context.select("doc_id").distinct() if axis == "root" else context


def _blocks(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK)))


def _semi(rows: DataFrame, marks: DataFrame, related: Column, ranged: tuple[Column, Column, str] | None) -> DataFrame:
    """Rows with a related mark (its columns begin with m_). ``ranged``: first and last number of the wider side, which is ``rows`` or ``marks``."""
    same = F.col("m_doc_id") == F.col("doc_id")
    if ranged is None:
        return rows.join(marks, same & related, "left_semi")
    first, last, wide = ranged
    if wide == "marks":
        blocked = marks.withColumn("m_block", _blocks(first, last))
        return rows.withColumn("__block", F.floor(F.col("pre") / BLOCK)).join(blocked, same & (F.col("m_block") == F.col("__block")) & related, "left_semi").drop("__block")
    blocked = marks.withColumn("m_block", F.floor(F.col("m_pre") / BLOCK))
    some = rows.withColumn("__block", _blocks(first, last)).join(blocked, same & (F.col("m_block") == F.col("__block")) & related, "left_semi")
    return some.drop("__block").dropDuplicates(["doc_id", "pre"])  # a row appears once for each block that it reaches into


def step(context: DataFrame, nodes: DataFrame, axis: str, name: str | None = None, kind: str | None = None, occurrence: int | Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The nodes on an axis of each context node, each once.

    ``name`` and ``kind`` narrow them. ``occurrence`` takes the n-th of each context node in the axis's
    order, or those for whose position and number of positions a function gives true (``last_place``, say).
    """
    n = nodes
    if name is not None:
        n = n.filter(F.col("name") == name)
    if kind is not None:
        n = n.filter(F.col("kind") == kind)
    mark = lambda x: F.col(f"m_{x}")
    related = _related(axis, mark, F.col)
    if occurrence is None:
        marks = _outermost(context, axis)
        marks = marks.select(*[F.col(x).alias(f"m_{x}") for x in MARKS if x in marks.columns])
        ranged = {"descendant": (mark("pre"), mark("last"), "marks"), "ancestor": (F.col("pre"), F.col("last"), "rows")}.get(axis.removesuffix("-or-self"))
        if ranged and ranged[2] == "rows" and axis == "ancestor":
            n = n.filter("kind = 'element'")
        return _semi(n, marks, related, ranged).select(*nodes.columns)
    marks = context.select(*[F.col(x).alias(f"m_{x}") for x in MARKS]).distinct()
    found = marks.join(n, (F.col("m_doc_id") == F.col("doc_id")) & related)
    own = Window.partitionBy("m_doc_id", "m_pre")
    place = F.row_number().over(own.orderBy(F.col("pre").desc() if axis in REVERSE else F.col("pre").asc()))
    if isinstance(occurrence, int):
        found = found.withColumn("__place", place).filter(F.col("__place") == occurrence)
    else:
        found = found.withColumns({"__place": place, "__many": F.count("*").over(own)}).filter(occurrence(F.col("__place"), F.col("__many")))
    return found.select(*nodes.columns).dropDuplicates(["doc_id", "pre"])


def last_place(position: Column, last: Column) -> Column:
    return position == last


def where(context: DataFrame, found: DataFrame, axis: str = "child") -> DataFrame:
    """Context nodes with one of ``found`` on an axis: a nested condition, on any of AXES.

    Conditions on a node's own numbers and links are filters on its columns (``pre``, ``parent``, ``first_child``, ...).
    """
    marks = found.select(*[F.col(x).alias(f"m_{x}") for x in COLUMNS])
    related = _related(axis, F.col, lambda x: F.col(f"m_{x}"))
    ranged = {"descendant": (F.col("pre"), F.col("last"), "rows"), "ancestor": (F.col("m_pre"), F.col("m_last"), "marks")}.get(axis.removesuffix("-or-self"))
    return _semi(context, marks, related, ranged)


def ancestor_element(context: DataFrame, nodes: DataFrame, name: str | None = None) -> DataFrame:
    """Each context node's nearest ancestor of a name."""
    return step(context, nodes, "ancestor", name, "element", occurrence=1)


def child_element(context: DataFrame, nodes: DataFrame, name: str | None = None) -> DataFrame:
    return step(context, nodes, "child", name, "element", occurrence=1)


def descendant_element(context: DataFrame, nodes: DataFrame, name: str | None = None) -> DataFrame:
    return step(context, nodes, "descendant", name, "element", occurrence=1)


def sibling_element(context: DataFrame, nodes: DataFrame, name: str | None = None, forward: bool = True) -> DataFrame:
    """Each context node's nearest sibling of a name, after or before it."""
    return step(context, nodes, "following-sibling" if forward else "preceding-sibling", name, "element", occurrence=1)


def node_keys(nodes: DataFrame, path: list[str], attribute: str | None = None) -> DataFrame:
    """doc_id and ``keys``, the texts found at a chain of element names from a root (or of an attribute there), as a sort key of many values."""
    found = reduce(lambda at, name: step(at, nodes, "child", name, "element"), path[1:], roots(nodes).filter(F.col("name") == path[0]))
    if attribute is not None:
        values = step(found, nodes, "attribute", attribute).select("doc_id", F.col("value").alias("text"))
    else:
        values = string_value(nodes, found).select("doc_id", "text")
    return values.groupBy("doc_id").agg(F.array_sort(F.collect_set("text")).alias("keys"))


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter("depth = 0")


def string_value(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the text under each node: an element's texts in document order."""
    inside = nodes.filter(F.col("kind").isin("text", "cdata")).select(F.col("doc_id").alias("t_doc"), F.col("pre").alias("t_pre"), F.col("value").alias("t_value"))
    joined = found.select("doc_id", "pre", "last").join(inside, (F.col("t_doc") == F.col("doc_id")) & F.col("t_pre").between(F.col("pre"), F.col("last")))
    texts = joined.groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_pre", "t_value"))), lambda x: x["t_value"]), "").alias("text"))
    return found.join(texts, ["doc_id", "pre"], "left").withColumn("text", F.coalesce("text", "value", F.lit("")))


def number(text: Column, kind: str = "bigint") -> Column:
    """A text as a whole number, if it is one. Spark makes each text that is none by an exception, so those without a digit are told apart first."""
    return F.when(text.rlike("[0-9]"), text.try_cast(kind))


def statistics(nodes: DataFrame) -> DataFrame:
    """Nodes of each kind and name."""
    return nodes.groupBy("kind", "name").count()


def delete_subtrees(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Without some nodes and all below them. Numbers keep their order; neighbours of what went are set anew."""
    gone = found.select(F.col("doc_id").alias("g_doc"), F.col("pre").alias("g_pre"), F.col("last").alias("g_last")).distinct()
    left = nodes.join(gone, (F.col("g_doc") == F.col("doc_id")) & F.col("pre").between(F.col("g_pre"), F.col("g_last")), "left_anti")
    return relink(left)


def relink(nodes: DataFrame) -> DataFrame:
    """Siblings, neighbours and outer children from parents and order."""
    own = nodes.withColumn("__attribute", F.col("kind").isin("attribute", "annotation"))
    w = Window.partitionBy("doc_id", "parent", "__attribute").orderBy("pre")
    plain = ~F.col("__attribute")
    own = own.withColumns({"sibling": F.when(plain, F.row_number().over(w).cast("long")), "prev_sibling": F.when(plain, F.lag("pre").over(w)), "next_sibling": F.when(plain, F.lead("pre").over(w))})
    children = own.filter(plain & F.col("parent").isNotNull()).select(F.col("doc_id").alias("e_doc"), F.col("parent").alias("e_pre"), F.col("pre").alias("e_child"))
    ends = children.groupBy("e_doc", "e_pre").agg(F.min("e_child").alias("e_first"), F.max("e_child").alias("e_last"))
    joined = own.join(ends, (F.col("e_doc") == F.col("doc_id")) & (F.col("e_pre") == F.col("pre")), "left")
    return joined.withColumns({"first_child": F.col("e_first"), "last_child": F.col("e_last")}).select(*nodes.columns)


def set_value(nodes: DataFrame, found: DataFrame, value: Column) -> DataFrame:
    """Texts and attributes among ``found`` with a new value."""
    marks = found.select(F.col("doc_id").alias("m_doc"), F.col("pre").alias("m_pre"), value.cast("string").alias("m_value"))
    joined = nodes.join(marks, (F.col("m_doc") == F.col("doc_id")) & (F.col("m_pre") == F.col("pre")), "left")
    return joined.withColumn("value", F.when(F.col("m_pre").isNotNull(), F.col("m_value")).otherwise(F.col("value"))).select(*nodes.columns)


def _begins(ids: pa.Array) -> np.ndarray:
    """Whether a document begins at a row, in rows by document."""
    own, there = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
    out = np.ones(len(own), dtype=bool)
    out[1:] = (own[1:] != own[:-1]) | (there[1:] != there[:-1])
    return out


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows by document, dealt anew so that no document is parted."""
    waiting: list[pa.RecordBatch] = []  # the last document so far
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id")
        at = int(np.flatnonzero(_begins(ids))[-1])  # where the last document begins
        if at or waiting and ids[0] != waiting[-1].column("doc_id")[-1]:
            yield pa.Table.from_batches([*waiting, batch.slice(0, at)] if at else waiting)
            waiting = []
        waiting.append(batch.slice(at))
    if waiting:
        yield pa.Table.from_batches(waiting)


#: Nodes of a document as they are shuffled: one row, with the numbers of all side by side and the texts of all joined, which
#: takes a fraction of the disk that a row for each node does. ``small``: the numbers have 16 bits and not 64.
PACKED = "doc_id bigint, small boolean, numbers binary, kind binary, name binary, ns binary, value binary"
_TEXTS = ("kind", "name", "ns", "value")
_NUMBERS = 5 + len(_TEXTS)
#: Bytes of packed numbers that are unpacked together, or one document.
UNPACKED = 1 << 21


def _joined(data: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of the stretches of ``data`` that end there."""
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, turn, at, last, parent, depth and texts) to rows of PACKED, one for each run of a document's."""
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = _begins(batch.column("doc_id"))
        first = np.flatnonzero(begins)
        ends = np.append(first[1:], batch.num_rows)
        turn, at, last, parent, depth = (batch.column(c).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("turn", "at", "last", "parent", "depth"))
        texts = [batch.column(c).cast(pa.string()) for c in _TEXTS]
        steps = np.where(begins, at, at - np.append(0, at[:-1]))
        numbers = np.stack([turn, steps, last - at, at - parent, depth, *[pc.binary_length(x).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for x in texts]], axis=1)
        small = bool(np.abs(numbers).max() < 1 << 15)
        numbers = np.ascontiguousarray(numbers, dtype=np.int16 if small else np.int64)
        out = [batch.column("doc_id").take(pa.array(first)), pa.array([small] * len(first)), _joined(numbers, ends * numbers.strides[0], pa.binary())]
        for data, places in map(_places, texts):
            out.append(_joined(np.ascontiguousarray(data), places[ends], pa.binary()))
        yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in PACKED.split(", ")])


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of all of a column."""
    column = pa.concat_arrays([column, pa.array([], pa.binary())])
    _, places, data = column.buffers()
    places = np.frombuffer(places, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8)[places[0] : places[-1]]


def _unpack(packed: pa.Table) -> pa.Table:
    """The rows of whole documents in order of ``at``, ``turn`` and name."""
    packed = packed.combine_chunks()
    ids, small, data = (packed[c].combine_chunks() for c in ("doc_id", "small", "numbers"))
    small, size = small.to_numpy(zero_copy_only=False), pc.binary_length(data).to_numpy(zero_copy_only=False)
    many = size // np.where(small, 2 * _NUMBERS, 8 * _NUMBERS)
    if small.all():
        numbers = _bytes(data).view(np.int16)
    else:
        numbers = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int16 if s else np.int64).astype(np.int64) for x, s in zip(data, small.tolist(), strict=True)])
    turn, steps, last, parent, depth, *lengths = numbers.reshape(-1, _NUMBERS).T.astype(np.int64)
    sums = np.cumsum(steps)
    first = np.cumsum(many) - many
    at = sums - np.repeat(sums[first] - steps[first], many)
    doc = np.repeat(np.cumsum(_begins(ids)) - 1, many)
    texts = {}
    for c, length in zip(_TEXTS, lengths, strict=True):
        there = pa.py_buffer(np.packbits(length >= 0, bitorder="little"))
        places = np.append(0, np.cumsum(np.maximum(length, 0)))
        kind, width = (pa.string(), np.int32) if places[-1] < 1 << 31 else (pa.large_string(), np.int64)
        pieces = [_bytes(x) for x in packed[c].chunks] or [np.zeros(0, dtype=np.uint8)]
        texts[c] = pa.Array.from_buffers(kind, len(length), [there, pa.py_buffer(places.astype(width)), pa.py_buffer(np.concatenate(pieces))])
    order = np.lexsort((turn, at, doc))
    same = (np.diff(turn[order]) == 0) & (np.diff(at[order]) == 0) & (np.diff(doc[order]) == 0)
    if same.any():
        order = np.lexsort((pc.rank(texts["name"], null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64), turn, at, doc))
    out = {"doc_id": ids.take(pa.array(np.repeat(np.arange(len(ids)), many))), "turn": turn, "at": at, "last": last + at, "parent": at - parent, "depth": depth.astype(np.int32), **texts}
    out = pa.table({c: pa.array(x) if isinstance(x, np.ndarray) else x for c, x in out.items()})
    return out if (np.diff(order) == 1).all() else out.take(pa.array(order))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Packed rows by document to the rows of whole documents, some at a time."""

    def parts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(pc.binary_length(batch.column("numbers")).to_numpy(zero_copy_only=False).astype(np.int64)) // UNPACKED
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.slice(a, b - a)

    return map(_unpack, _whole_documents(parts()))


#: A row of this turn sets a node's value.
SET = 9


def _numbered(rows: pa.Table) -> pa.RecordBatch:
    """Nodes of whole documents, old (turn 1) and new, in order of ``at`` and ``turn``, with numbers from 0 and links."""
    rows = rows.combine_chunks()
    turn, at, last, parent = (rows[c].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False) for c in ("turn", "at", "last", "parent"))
    doc = np.cumsum(_begins(rows["doc_id"].combine_chunks())) - 1
    width = max(at.max(), last.max(), parent.max()) + 2
    key, node = doc * width + at, turn != SET
    set_key, set_value = key[~node], rows["value"].combine_chunks().filter(pa.array(~node))
    rows, key, turn, doc, last, parent = rows.filter(pa.array(node)), key[node], turn[node], doc[node], last[node], parent[node]
    old = np.flatnonzero(turn == 1)
    texts = {c: rows[c].combine_chunks() for c in ("kind", "name", "ns", "value")}
    if len(set_key):
        set_key, one = np.unique(set_key, return_index=True)
        hit = (turn == 1) & np.isin(key, set_key)
        texts["value"] = pc.replace_with_mask(texts["value"], pa.array(hit), set_value.take(pa.array(one[np.isin(set_key, key[hit])])))
    wanted = doc * width + parent
    near = np.minimum(np.searchsorted(key[old], wanted), len(old) - 1)
    up = np.where((parent >= 0) & (key[old][near] == wanted), old[near], -1) if len(old) else np.full(len(key), -1)
    end = np.where(turn == 1, np.searchsorted(key, doc * width + last, "right") - 1, np.arange(len(key)))
    plain = ~pc.is_in(texts["kind"], pa.array(["attribute", "annotation"])).to_numpy(zero_copy_only=False)
    return _batch(doc, rows["doc_id"].combine_chunks(), end, up, rows["depth"].to_numpy(), plain, texts)


def _with_new(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` and new ones, numbered anew, as a written table: change upon change would else be computed over and over.

    ``new`` has doc_id, the old number ``at`` and ``turn`` that say where each goes (turn 0: before the
    node with that number, 2: right after it; SET: it is that node's new value), parent, depth, kind, name, ns and value.
    The nodes are shuffled once, packed by document; as on export, a document meets in one task, and its links are made there.
    """
    old = nodes.select("doc_id", F.col("pre").alias("at"), F.lit(1).alias("turn"), "last", "parent", "depth", "kind", "name", "ns", "value")
    both = old.unionByName(new, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _unpacked(batches):
            yield _numbered(rows)

    return written(both.mapInArrow(_pack, PACKED).repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SCHEMA))


def _leaf(at: str, turn: int, parent: str, depth: Column, name: str | None, value: Column | str | None, kind: str, ns: str | None) -> list[Column]:
    """Columns of a new leaf beside or in a node."""
    text = value if isinstance(value, Column) else F.lit(value)
    fixed = [F.lit(x).cast("string").alias(c) for x, c in ((name, "name"), (kind, "kind"), (ns, "ns"))]
    return [F.col("doc_id"), F.col(at).alias("at"), F.lit(turn).alias("turn"), F.col(parent).alias("parent"), depth.alias("depth"), text.cast("string").alias("value"), *fixed]


def insert_before(nodes: DataFrame, found: DataFrame, name: str | None, value: Column | str | None = None, kind: str = "element", ns: str | None = None) -> DataFrame:
    """A new leaf before each node of ``found``, as its sibling."""
    return _with_new(nodes, found.select(*_leaf("pre", 0, "parent", F.col("depth"), name, value, kind, ns)))


def create_attribute(nodes: DataFrame, found: DataFrame, name: str, value: Column | str, ns: str | None = None) -> DataFrame:
    """An attribute of each element of ``found``; one that is there already gets the value."""
    there = nodes.filter((F.col("kind") == "attribute") & (F.col("name") == name) & (F.coalesce("ns", F.lit("")) != "xmlns")).select("doc_id", F.col("parent").alias("pre"), F.col("pre").alias("__there"))
    rows = found.join(there, ["doc_id", "pre"], "left").select("*", F.coalesce("__there", "pre").alias("__at"))
    leaves = rows.select(*_leaf("__at", 2, "pre", F.col("depth") + 1, name, value, "attribute", ns), "__there")
    return _with_new(nodes, leaves.withColumn("turn", F.when(F.col("__there").isNull(), F.col("turn")).otherwise(SET)).drop("__there"))


def create_annotation(nodes: DataFrame, found: DataFrame, value: Column | str) -> DataFrame:
    """A note on each node of ``found``: a node of its own kind, which no axis shows and no export writes."""
    return _with_new(nodes, found.select(*_leaf("pre", 2, "pre", F.col("depth") + 1, None, value, "annotation", None)))


#: Columns that an export reads.
EXPORTED = ["doc_id", "pre", "last", "kind", "name", "ns", "value"]
#: What escaping changes in a text, and in an attribute besides.
_ESCAPED = {"text": "[&<>]", "attribute": "[&<>\"\n\r\t]"}
_ESCAPABLE = np.isin(np.arange(256), np.frombuffer(b"&<>\"\n\r\t", dtype=np.uint8))


def _around(kind: str, name: str | None, ns: str | None) -> tuple[str, str, str]:
    """What stands before and after a node's value, and at an element's end."""
    if kind == "attribute":
        return f' {"xmlns:" if ns == "xmlns" else ""}{name}="', '"', ""
    if kind == "element":
        return f"<{name}" + (f" xmlns={quoteattr(ns)}" if ns else ""), "", f"</{name}>"
    return {"text": ("", "", ""), "cdata": ("<![CDATA[", "]]>", ""), "comment": ("<!--", "-->", ""), "pi": (f"<?{name} ", "?>", "")}[kind]


def _texts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The XML of whole documents, nodes in order: the pieces of all of them are put in one row, so that their bytes are the documents'."""
    col = {c: rows[c].combine_chunks() for c in rows.column_names}
    n, begins = rows.num_rows, _begins(col["doc_id"])
    doc = np.cumsum(begins) - 1
    pre, last = (col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pre", "last"))
    # what stands around values is told from the few different kinds, names and namespaces
    codes, known = [], []
    for c in ("kind", "name", "ns"):
        found = col[c].dictionary_encode()
        known.append([*found.dictionary.to_pylist(), None])
        codes.append(found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64))
    sorts, sort = np.unique((codes[0] * len(known[1]) + codes[1]) * len(known[2]) + codes[2], return_inverse=True)
    sorts = [(known[0][x // len(known[2]) // len(known[1])], known[1][x // len(known[2]) % len(known[1])], known[2][x % len(known[2])]) for x in sorts.tolist()]
    is_ = {k: np.array([x[0] == k for x in sorts])[sort] for k in ("element", "attribute", "text")}
    around = [_around(*x) for x in sorts]
    # where elements end, and whether anything but attributes is in them
    rows_ = np.arange(n)
    width = max(pre.max(), last.max()) + 2
    inner = np.flatnonzero(is_["element"])
    end = rows_.copy()
    end[inner] = np.searchsorted(doc * width + pre, (doc * width + last)[inner], "right") - 1
    plain = np.cumsum(~is_["attribute"])
    empty = plain[end[inner]] == plain[inner]
    # the first node in an element ends its tag
    before = np.append(-1, np.maximum.accumulate(np.where(is_["attribute"], -1, rows_))[:-1])
    ends_tag = ~is_["attribute"] & (before >= 0) & is_["element"][before] & (end[before] >= rows_)
    # values: escaped by themselves where there is need
    value = pa.concat_arrays([col["value"].fill_null(""), pa.array([], pa.string())])
    odd = np.zeros(n, dtype=bool)
    if _ESCAPABLE[_places(value)[0]].any():
        for kind, wanted in _ESCAPED.items():
            odd |= is_[kind] & pc.match_substring_regex(value, wanted).to_numpy(zero_copy_only=False)
        some = value.filter(pa.array(odd)).to_pylist()
        some = [escape(x) if t else quoteattr(x)[1:-1] for x, t in zip(some, is_["text"][odd].tolist(), strict=True)]
        value = pc.replace_with_mask(value, pa.array(odd), pa.array(some, pa.string()))
    head, tail = sort + len(sorts) * ends_tag, sort + 2 * len(sorts)
    pool = [x for x, _, _ in around] + [">" + x for x, _, _ in around] + [x for _, x, _ in around] + [x for _, _, x in around] + ["/>"]
    # attributes with a prefix of their own or between single quotes
    single = is_["attribute"] & odd
    if single.any():
        single[single] = [not x.startswith('"') for x in map(quoteattr, col["value"].filter(pa.array(single)).to_pylist())]
    own = is_["attribute"] & np.array([x[2] not in (None, "", "xmlns") for x in sorts])[sort]
    for i in np.flatnonzero(own | single).tolist():
        _, name, ns = sorts[sort[i]]
        quote = "'" if single[i] else '"'
        head[i], tail[i] = len(pool), len(pool) + 1
        pool += [f" xmlns:n{pre[i]}={quoteattr(ns)} n{pre[i]}:{name}={quote}" if own[i] else around[sort[i]][0][:-1] + quote, quote]
    # each node's pieces, and those of the elements that end with it, innermost first
    size = np.array([len(x) for x in pool])
    has = np.stack([size[head] > 0, ~is_["element"], ~is_["element"] & (size[tail] > 0)])
    order = np.lexsort((-inner, end[inner]))
    many = has.sum(axis=0)
    ended = np.bincount(end[inner], minlength=n)
    at = np.cumsum(many + ended) - many - ended
    piece = np.empty(int(many.sum()) + len(inner), dtype=np.int64)
    for which, here in zip((head, len(pool) + rows_, tail), has, strict=True):
        piece[at[here]] = which[here]
        at = at + here
    closes = np.where(empty, 4 * len(sorts), sort[inner] + 3 * len(sorts))[order]
    piece[at[end[inner][order]] + np.arange(len(inner)) - (np.cumsum(ended) - ended)[end[inner][order]]] = closes
    pieces = pa.concat_arrays([pa.array(pool, pa.large_string()), value.cast(pa.large_string())]).take(pa.array(piece))
    _, places, data = pieces.buffers()
    first = np.flatnonzero(begins)
    places = np.frombuffer(places, dtype=np.int64)[: len(pieces) + 1][np.append((np.cumsum(many + ended) - many - ended)[first], len(piece))]
    ids, step = col["doc_id"].take(pa.array(first)), len(first) if places[-1] < 1 << 31 else 1
    for i in range(0, len(first), step):
        upto = (places[i : i + step + 1] - places[i]).astype(np.int32)
        xml = pa.StringArray.from_buffers(len(upto) - 1, pa.py_buffer(upto), data.slice(places[i], places[min(i + step, len(first))] - places[i]))
        yield pa.RecordBatch.from_arrays([ids.slice(i, step), xml], names=["doc_id", "xml"])


def _indented(indent: int, head: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Streams the nodes of documents in order to texts with lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, out, stack = None, [], []

        def close(upto: int) -> None:
            while stack and stack[-1][0] < upto:
                _, tag, state = stack.pop()
                if state[1]:
                    out.append("\n" + " " * (indent * len(stack)))
                out.append("/>" if state[0] else f"</{tag}>")

        def content(kind: str) -> None:
            if not stack:
                if out:
                    out.append("\n")
                return
            state = stack[-1][2]
            if state[0]:
                out.append(">")
                state[0] = False
            state[2] |= kind in ("text", "cdata")  # beside texts, white space would count
            state[1] = not state[2]
            if state[1]:
                out.append("\n" + " " * (indent * len(stack)))

        for batch in batches:
            rows = []
            for doc, pre, last, kind, name, ns, value in zip(*[batch[c] for c in ("doc_id", "pre", "last", "kind", "name", "ns", "value")], strict=True):
                if at is not None and doc != at:
                    close(1 << 62)
                    rows.append((at, head + "".join(out)))
                    out.clear()
                at = doc
                close(pre)
                if kind == "attribute":
                    if ns == "xmlns":
                        name = f"xmlns:{name}"
                    elif ns:  # a prefix of its own
                        prefix = f"n{pre}"
                        out.append(f" xmlns:{prefix}={quoteattr(ns)}")
                        name = f"{prefix}:{name}"
                    out.append(f" {name}={quoteattr(value or '')}")
                    continue
                content(kind)
                if kind == "element":
                    out.append(_around(kind, name, ns)[0])
                    stack.append((last, name, [True, False, False]))  # still empty; ends on a line of its own; has texts
                else:
                    out.append({"text": lambda v: escape(v), "cdata": lambda v: f"<![CDATA[{v}]]>", "comment": lambda v: f"<!--{v}-->", "pi": lambda v: f"<?{name} {v}?>"}[kind](value or ""))
            yield pd.DataFrame(rows, columns=["doc_id", "xml"])
        if at is not None:
            close(1 << 62)
            yield pd.DataFrame([(at, head + "".join(out))], columns=["doc_id", "xml"])

    return run


def export_documents(nodes: DataFrame, indent: int | None = None, declaration: bool = False, whole: bool = False) -> DataFrame:
    """doc_id and XML text; a document's nodes meet in one task.

    With ``indent`` each element and the like begins a line, so many spaces deeper than its parent, unless
    it follows a text. ``declaration`` puts the XML declaration first. ``whole`` says that nodes come as ``import_documents``
    leaves them, each document's together and in order; a table that was written or shuffled may have parted them.
    """
    nodes = nodes.filter("kind <> 'annotation'").select(*EXPORTED)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n' if declaration else ""
    if indent is not None:
        ordered = nodes if whole else nodes.repartition("doc_id").sortWithinPartitions("doc_id", "pre")
        return ordered.mapInPandas(_indented(indent, head), "doc_id bigint, xml string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_documents(batches) if whole else _unpacked(batches):
            for out in _texts(rows if whole else rows.rename_columns({"at": "pre"})):
                yield out if not head else pa.RecordBatch.from_arrays([out["doc_id"], pc.binary_join_element_wise(head, out["xml"], "")], names=["doc_id", "xml"])

    if not whole:
        unused = [F.lit(0).alias("turn"), F.col("pre").alias("parent"), F.lit(0).alias("depth")]
        nodes = nodes.select("doc_id", F.col("pre").alias("at"), "last", *_TEXTS, *unused).mapInArrow(_pack, PACKED).repartition("doc_id").sortWithinPartitions("doc_id")
    return nodes.mapInArrow(run, "doc_id bigint, xml string")
