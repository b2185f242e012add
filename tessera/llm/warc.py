"""WARC archives and their capture index, built by an external merge.

``write_archive`` writes records through Spark's own writer: responses with their payload and, for
payloads seen elsewhere, revisits that refer to the response with the largest id. ``read_archive`` reads
the files back as streams. ``capture_history`` has each task sort its captures by URL key and time into a
run, which is written with the run's number and each capture's place in it. The runs are dealt out by
ranges of the key; a range's task puts each run's slice in order by place, without comparing keys, and
merges the slices with a loser tree, so that the ranges together are one globally ordered history. A range
holds at most about RANGE_ROWS rows, whatever the number of captures of one URL, as the record id is part
of the key. Offsets and lengths count bytes of an archive file's uncompressed stream.

Defined results: null payloads are empty, and empty payloads are payloads like any other; rows without
an id are written and read with a null id and count as smaller than any; equal payloads whose row holds the largest id are all
responses, so repeated rows are; a null URL gives a record without a target and an empty key; a very long
payload is one record, held once by the task that reads it; an empty table gives an archive without
records and an empty history; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import join_lookup, materialize, released, shared_dir

RANGE_ROWS = 200_000
SEPARATOR = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digest: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits, from groups of 20 bits."""

    def letters(h: Column) -> Column:
        twenty = lambda i: F.conv(F.substring(h, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
        letter = lambda i: F.substring(F.lit(BASE32), (F.floor(twenty(i) / F.pow(F.lit(2.0), 15 - 5 * (i % 4))).cast("int").bitwiseAND(31) + 1), F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")

    return F.transform(F.array(digest), letters)[0]  # as an element the digest is computed once, not for each letter


def url_key(url: Column) -> Column:
    """The host's labels from the last to the first, then the path and query, in lower case."""
    whole = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)"
    host, rest = F.lower(F.regexp_extract(url, whole, 1)), F.lower(F.regexp_extract(url, whole, 2))
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\.")), ",")
    return F.coalesce(F.when(host == "", F.lower(url)).otherwise(F.concat(labels, F.lit(")"), F.when(rest == "", "/").otherwise(rest))), F.lit(""))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, least: int = 0) -> DataFrame:
    """Each row's record, and which other it revisits. Without ``time_col`` the id counts seconds."""
    seconds = F.col(time_col).cast("timestamp").cast("long") if time_col else F.coalesce(F.col(id_col).cast("long"), F.lit(0)) + 1_704_067_200
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.col(url_col), r"[\r\n]", "%0A").alias("url"),
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumns({"n": F.octet_length("payload"), "sha1": F.sha1("payload")})
    first = rows.filter(F.col("n") >= least).groupBy("sha1").agg(F.max("id").alias("response"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    return join_lookup(rows, materialize(first), ["sha1"]).withColumn("revisits", F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")))


def write_archive(recs: DataFrame, path: str) -> None:
    """One .gz file of records for each task."""
    head = lambda kind, length: F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: "), F.col("time"),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url"))),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")), F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"),
    )
    response = F.concat(head("response", F.col("n") + len(HTTP_HEAD)), F.lit(SEPARATOR + HTTP_HEAD), F.col("payload"))
    profile = "\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"
    revisit = F.concat(head("revisit", F.lit(len(HTTP_HEAD))), F.lit(profile), F.col("response").cast("string"), F.lit(">" + SEPARATOR + HTTP_HEAD))
    recs.select(F.when(F.col("revisits"), revisit).otherwise(response).alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def captures(stream: Iterator[bytes]) -> Iterator[tuple]:
    """(offset, length, headers, payload) of the records of one file, given in stretches of any length."""
    data, offset, over = b"", 0, False
    while True:
        while not over and b"\r\n\r\n" not in data:
            piece = next(stream, None)
            over = piece is None
            data += piece or b""
        end = data.find(b"\r\n\r\n")
        if end < 0:
            return
        lines = data[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length", 0))
        parts, have = [data[end + 4 :]], len(data) - end - 4
        while have < size and (piece := next(stream, None)) is not None:
            parts.append(piece)
            have += len(piece)
        content = b"".join(parts)
        if len(content) < size:
            return  # broken off
        yield offset, end + 4 + size, headers, content[:size].partition(b"\r\n\r\n")[2]
        data = content[size:]
        while not over and len(data) < 4:
            piece = next(stream, None)
            over = piece is None
            data += piece or b""
        offset += end + 4 + size + 4
        data = data[4:]


CAPTURE = "file string, offset long, length long, record_type string, id long, url string, time string, payload_bytes long, payload_digest string, refers_to long"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; a response's digest and length are taken from the bytes read."""
    between = SEPARATOR + "WARC/1.0\r\n"  # only where Spark's reader cuts; records end where their length says
    lines = spark.read.option("lineSep", between).text(path).select(F.col("_metadata.file_path").alias("file"), F.encode("value", "utf-8").alias("value"))

    def number(x: str | None) -> int | None:
        found = (x or "").rpartition(":")[2].strip("<>")
        return int(found) if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = ((f, v) for b in batches for f, v in zip(b["file"], b["value"], strict=True))
        for file, own in groupby(pieces, key=lambda x: x[0]):
            stream = ((between.encode() if i else b"") + v for i, (_, v) in enumerate(own))
            rows = []
            for offset, length, h, payload in captures(stream):
                kind = h.get("warc-type", "")
                if kind == "revisit":
                    n, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                else:
                    n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rows.append((file, offset, length, kind, number(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-date"), n, digest, number(h.get("warc-refers-to"))))
                if len(rows) == 5000:
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in CAPTURE.split(", ")]).astype({"id": "Int64", "refers_to": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CAPTURE.split(", ")]).astype({"id": "Int64", "refers_to": "Int64"})

    return lines.mapInPandas(run, CAPTURE)


class LoserTree:
    """Merges sorted runs; a step compares with one loser on each level. An ended run's key is None."""

    def __init__(self, runs: list[Iterator[tuple[Any, Any]]]):
        self.runs = runs
        self.heads: list[tuple[Any, Any] | None] = [next(r, None) for r in runs]
        k = len(runs)
        self.losers = [-1] * max(k, 1)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self) -> Iterator[Any]:
        while self.runs and (head := self.heads[self.winner]) is not None:
            yield head[1]
            best = self.winner
            self.heads[best] = next(self.runs[best], None)
            node = (best + len(self.runs)) // 2
            while node:
                if self.before(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def capture_history(found: DataFrame) -> DataFrame:
    """The captures in global order of URL key, time and id: by partition, and within each."""
    spark = found.sparkSession
    order = ["url_key", "time", "id"]
    keyed = found.withColumn("url_key", url_key(F.col("url")))
    # the number counts on within a task and tells tasks apart by its upper bits: run and place in one
    runs = materialize(keyed.sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    columns = keyed.columns

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.iloc[np.argsort(rows["__place"].to_numpy())]
        ids = rows["id"].fillna(-(2**63)).astype("int64").tolist()
        keys = list(zip(rows["url_key"].tolist(), rows["time"].tolist(), ids, strict=True))
        starts = np.flatnonzero(np.diff(rows["__place"].to_numpy() >> 33, prepend=-1))
        slices = [range(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True)]
        tree = LoserTree([((keys[i], i) for i in own) for own in slices])
        yield rows.iloc[list(tree)][columns]

    dealt = runs.repartitionByRange(ranges, *order)
    return dealt.mapInPandas(released(merge), keyed.schema)


def archive_and_index(pages: DataFrame, path: str | None = None, **columns: Any) -> DataFrame:
    """Write the archive (to a new shared folder by default), read it back, and index it."""
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    write_archive(records(pages, **columns), path)
    return capture_history(read_archive(spark, path))
