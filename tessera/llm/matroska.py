"""Media columns in Matroska: binary columns are written as tracks and parsed into packet tables.

``media_column`` stores bytes losslessly as an 8-bit PCM track (8 kHz, frames of 64 samples, laced
blocks, cues). ``packet_table`` walks the variable-length EBML elements of any Matroska column and
gives a row for each packet: its track, timestamp, place and size in the file, cluster, lacing, and
whether a cue points at its cluster. ``read_back`` joins the packets of a track to the stored bytes.

Defined results: a null or empty payload is stored as 64 bytes 0; null or foreign media give no
packets and null features; a file that is cut off gives the packets that are whole; repeated rows give
repeated packets; other columns are kept by ``media_column`` and left out of ``packet_table``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import of_texts

# Element ids of the published Matroska and EBML specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION = 0x4282, 0x4287
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

SAMPLE_RATE = 8000
FRAME = 64
FRAME_NS = FRAME * 1_000_000_000 // SAMPLE_RATE
FRAMES_PER_BLOCK = 128
BLOCKS_PER_CLUSTER = 16


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    position: int
    size: int
    cluster: int
    lacing: int
    keyframe: bool


class Packets(NamedTuple):
    """A file's packets as columns, its cues as (time in ns, track, byte place of a cluster), and where clusters' bodies and elements start."""

    table: dict[str, np.ndarray]
    cues: list[tuple[int, int, int]]
    clusters: list[int]
    heads: list[int]


# ---------------------------------------------------------------- writing


def vint(n: int, width: int = 0) -> bytes:
    width = width or max(1, -(-(n + 1).bit_length() // 7))
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], how: int) -> bytes:
    """The body of a block after its flags."""
    if how == NO_LACING:
        return frames[0]
    sizes, head = [len(x) for x in frames], bytes([len(frames) - 1])
    if how == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif how == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(kind: int, track: int, ticks: int, body: bytes, how: int, keyframe: bool = True) -> bytes:
    return element(kind, vint(track) + struct.pack(">hB", ticks, (0x80 if keyframe else 0) | how << 1) + body)


def mux(payload: bytes) -> bytes:
    """A Matroska file of one PCM track; the payload is a positive multiple of FRAME bytes."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME_NS)
    track += element(AUDIO, element(RATE, struct.pack(">d", float(SAMPLE_RATE))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    parts = [element(INFO, number(TIMESTAMP_SCALE, 1_000_000)), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues, size, step = sum(map(len, parts)), [], FRAME * FRAMES_PER_BLOCK, FRAME * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for i in range(0, len(payload), step):
        start = i // FRAME * FRAME_NS // 1_000_000
        blocks = [number(CLUSTER_TIMESTAMP, start)]
        for j in range(i, min(i + step, len(payload)), size):
            body = payload[j : min(j + size, i + step)]
            ticks = j // FRAME * FRAME_NS // 1_000_000 - start
            blocks.append(block(SIMPLE_BLOCK, 1, ticks, bytes([len(body) // FRAME - 1]) + body, FIXED))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# ---------------------------------------------------------------- reading


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """The number at a place and the place after it; −1 for an unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("no variable-length number here")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


#: Elements that end a cluster or segment of unknown size.
TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, EBML}


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start and end of the body, start of the element) of the elements in a stretch."""
    while at < end:
        start = at
        try:
            kind, at = read_vint(data, at, True)
            size, body = read_vint(data, at)
        except (ValueError, IndexError):
            return
        stop = end if size < 0 else min(end, body + size)
        if size < 0 and kind == CLUSTER:
            stop = body
            for child, a, b, _ in elements(data, body, end):
                if child in TOP:
                    break
                stop = b
        yield kind, body, stop, start
        at = stop


def unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def unlace(data: bytes, at: int, end: int, how: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and sizes of a block's frames; frames beyond a file that was cut off are left out."""
    if how == NO_LACING:
        return np.array([at]), np.array([end - at])
    n, at = data[at] + 1, at + 1
    if how == FIXED:
        size = (end - at) // n
        return at + size * np.arange(n), np.full(n, size)
    sizes = []
    if how == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(n - 1):
            value, after = read_vint(data, at)
            width = after - at
            sizes.append(value if i == 0 else sizes[-1] + (value if value >= 0 else (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1))
            at = after
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laces longer than their block")
    sizes_ = np.array(sizes)
    return at + np.cumsum(sizes_) - sizes_, sizes_


def parse(data: bytes) -> Packets:
    """The packet table of a file."""
    scale, durations, cues, clusters, heads, parts = 1_000_000, {}, [], [], [], []
    for kind, a, b, _ in elements(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        for top, c, d, head in elements(data, a, b):
            if top == INFO:
                scale = next((unsigned(data, x, y) for k, x, y, _ in elements(data, c, d) if k == TIMESTAMP_SCALE), scale)
            elif top == TRACKS:
                for k, x, y, _ in elements(data, c, d):
                    if k == TRACK_ENTRY:
                        own = {k2: unsigned(data, p, q) for k2, p, q, _ in elements(data, x, y) if k2 in (TRACK_NUMBER, DEFAULT_DURATION)}
                        durations[own.get(TRACK_NUMBER, 0)] = own.get(DEFAULT_DURATION, 0)
            elif top == CUES:
                for k, x, y, _ in elements(data, c, d):
                    if k == CUE_POINT:
                        inner = list(elements(data, x, y))
                        time = next((unsigned(data, p, q) for k2, p, q, _ in inner if k2 == CUE_TIME), 0)
                        for k2, p, q, _ in inner:
                            if k2 == CUE_POSITIONS:
                                own = {k3: unsigned(data, r, s) for k3, r, s, _ in elements(data, p, q)}
                                cues.append((time * scale, own.get(CUE_TRACK, 0), a + own.get(CUE_CLUSTER, 0)))
            elif top == CLUSTER:
                clusters.append(c)
                heads.append(head)
                start = 0
                for k, x, y, _ in elements(data, c, d):
                    if k == CLUSTER_TIMESTAMP:
                        start = unsigned(data, x, y)
                        continue
                    blocks = [(x, y)] if k == SIMPLE_BLOCK else [(p, q) for k2, p, q, _ in elements(data, x, y) if k2 == BLOCK] if k == BLOCK_GROUP else []
                    for p, q in blocks:
                        try:
                            track, at = read_vint(data, p)
                            ticks, flags = struct.unpack(">hB", data[at : at + 3])
                            places, sizes = unlace(data, at + 3, q, flags >> 1 & 3)
                        except (ValueError, IndexError, struct.error):
                            continue
                        n = len(places)
                        times = (start + ticks) * scale + durations.get(track, 0) * np.arange(n)
                        parts.append((np.full(n, track), times, places, sizes, np.full(n, len(clusters) - 1), np.full(n, flags >> 1 & 3), np.full(n, k == BLOCK_GROUP or bool(flags & 0x80))))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * 7
    return Packets(dict(zip(Packet._fields, columns, strict=True)), cues, clusters, heads)


def track_bytes(data: bytes, packets: Packets, track: int) -> bytes:
    """The packets' bytes of a track in order of time; contiguous packets are copied together."""
    table = packets.table
    own = np.flatnonzero(table["track"] == track)
    own = own[np.argsort(table["timestamp_ns"][own], kind="stable")]
    places, sizes = table["position"][own], table["size"][own]
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1] + sizes[:-1])) if len(own) else []
    last = np.append(first[1:], len(own)) - 1 if len(own) else []
    return b"".join(data[places[i] : places[j] + sizes[j]] for i, j in zip(first, last, strict=True))


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % FRAME if payload else FRAME)


@F.pandas_udf(T.BinaryType())
def to_matroska(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([mux(padded((t or "").encode("utf-8", "replace"))) for t in texts], dtype=object)


FEATURES = T.StructType()
for _name, _type in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
    FEATURES = FEATURES.add(_name, T.LongType() if _type == "long" else T.StringType())


def describe(media: bytes | None) -> tuple:
    """FEATURES of a file's first track, from the bytes read back."""
    if media is None:
        return (None,) * 6
    packets = parse(media)
    payload = track_bytes(media, packets, int(packets.table["track"][0])) if len(packets.table["track"]) else b""
    samples = np.frombuffer(payload, dtype=np.uint8)
    n, times = len(samples), packets.table["timestamp_ns"]
    counts = np.bincount(samples, minlength=256)
    mean = float(counts @ np.arange(256)) / max(n, 1)
    rms = (float(counts @ (np.arange(256) - 128.0) ** 2) / max(n, 1)) ** 0.5
    crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    share = counts[counts > 0] / max(n, 1)
    entropy = float(-(share * np.log2(share)).sum())
    end_ms = (int(times.max()) + FRAME_NS) // 1_000_000 if len(times) else 0
    feature = f"packets={len(times)};clusters={len(packets.clusters)};cues={len(packets.cues)};ms={end_ms};mean={mean:.4f};rms={rms:.4f};crossings={crossings};entropy={entropy:.4f}"
    return n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


@F.pandas_udf(FEATURES)
def read_back(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = FEATURES.names
    for files in batches:
        yield pd.DataFrame([describe(x) for x in files], columns=names)


def media_column(df: DataFrame, text_col: str = "text", name: str = "media") -> DataFrame:
    """``df`` with each text stored in a Matroska file of its own."""
    return of_texts(df).withColumn(name, to_matroska(F.col(text_col)))


def features(media: Column | str) -> Column:
    return read_back(F.col(media) if isinstance(media, str) else media)


def packet_table(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """A row for each packet of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, media in zip(batch["own"], batch["media"], strict=True):
                if media is None:
                    continue
                packets = parse(media)
                out = pd.DataFrame(packets.table)
                cued = {c[2] for c in packets.cues}
                out["cued"] = [packets.heads[c] in cued for c in out["cluster"]]
                out.insert(0, id_col, own)
                yield out

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, track long, timestamp_ns long, position long, size long, cluster long, lacing long, keyframe boolean, cued boolean"
    return df.select(F.col(id_col).alias("own"), F.col(media_col).alias("media")).mapInPandas(run, schema)
