"""Exact top-k by no-random-access aggregation over sorted lists.

Each block of candidates keeps one sorted list for each dimension, read from the end that a query's
component favours. The heads of the lists are read first and the candidates seen there resolved: their
k-th best score is a bound that the result must reach. A list's value at a depth bounds what any
candidate not seen by then may have there, so the sum of these over the lists bounds every outsider's
score. The lists are read to the first of a row of doubling depths at which outsiders cannot qualify.
What was read gives each candidate seen a lower bound (an unread component counts as its list's last
value) and an upper bound (it counts as the value at the depth); those whose upper bound does not reach
the k-th best lower bound go, the others get their final scores. Where the lists would have to be read so
far that most candidates are seen anyway, they are read to their ends, as one matrix product. All bounds
are without error, as the components are whole numbers in a float that holds every sum of products.

Blocks of both sides have a bounded number of values; each pair of blocks is one group, whose best k rows
for each query are merged by a window with a group limit. No group grows with the input.

Defined results: rows with a null id, a null vector, or null or non-finite components take no part, as
candidates or queries; vectors of different lengths don't meet; a row that repeats another is a candidate
of its own, but repeated queries are one; a query's own id is no candidate of its own; ties go to smaller
ids; scores beyond 64 bits are ranked as they are and shown as the nearest that fits; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize

#: Numbers of a block (rows times components), and its least rows where there are tasks to spare.
BLOCK_VALUES, LEAST_ROWS = 1 << 20, 1024
#: Queries whose scores are held at once.
TOGETHER = 256
#: Entries of each list's two ends that are read first.
HEAD = 4
#: Part of a block's rows up to which list entries are read one by one; beyond it lists are read to their ends.
SPARSE = 1 / 8


class Lists:
    """The sorted lists of a block: for each dimension the rows' places from the least value to the greatest."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids, self.n = rows, ids, len(rows)
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(rows, self.order, axis=0)
        self.depths = np.unique(np.minimum(2 ** np.arange(self.n.bit_length() + 1), self.n))

    def outsiders(self, q: np.ndarray) -> np.ndarray:
        """The most that a candidate not seen may score (queries by depths)."""
        high, low = self.values[self.n - self.depths], self.values[self.depths - 1]
        return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T

    def heads(self) -> np.ndarray:
        return np.unique(np.concatenate([self.order[:HEAD].ravel(), self.order[-HEAD:].ravel()]))

    def read(self, q: np.ndarray, depth: int, floor: float, k: int, own: int) -> np.ndarray:
        """Candidates that may be among the best k, from the lists' entries down to a depth; ``own`` is left out."""
        up, used = q > 0, q != 0
        places = np.where(up, self.order[self.n - depth :], self.order[:depth])[:, used].ravel()
        values = np.where(up, self.values[self.n - depth :], self.values[:depth])[:, used]
        q, up = q[used], up[used]
        at_depth = q * np.where(up, self.values[self.n - depth, used], self.values[depth - 1, used])
        at_end = q * np.where(up, self.values[0, used], self.values[-1, used])
        seen, where = np.unique(places, return_inverse=True)
        sums = lambda x: np.bincount(where, np.broadcast_to(x, values.shape).ravel(), len(seen))
        got = sums((q * values).astype(float))
        upper = got + (at_depth.sum() - sums(at_depth.astype(float)))
        lower = got + (at_end.sum() - sums(at_end.astype(float)))
        other = self.ids[seen] != own
        seen, upper, lower = seen[other], upper[other], lower[other]
        if len(lower) >= k:
            floor = max(floor, np.partition(lower, len(lower) - k)[len(lower) - k])
        return seen[upper >= floor]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def no_random_access(q: np.ndarray, q_ids: np.ndarray, lists: Lists, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query number, candidate number, score) of each query's best k of a block, and the list entries read."""
    rows, ids, n = lists.rows, lists.ids, lists.n
    out, entries = [], 0
    heads = lists.heads()
    first = np.where(q_ids[:, None] == ids[heads][None, :], -np.inf, q @ rows[heads].T)
    # the k-th best of what the heads show
    floor = np.partition(first, len(heads) - k, axis=1)[:, len(heads) - k] if len(heads) > k else np.full(len(q), -np.inf)
    closed = lists.outsiders(q) < floor[:, None]
    stop = np.where(closed.any(1), lists.depths[closed.argmax(1)], n)
    used = np.count_nonzero(q, axis=1)
    sparse = (used > 0) & (stop * used <= SPARSE * n)
    for i in np.flatnonzero(sparse):
        some = lists.read(q[i], int(stop[i]), floor[i], k, q_ids[i])
        scores = rows[some] @ q[i]
        top = best(scores, ids[some], k)
        out.append((np.full(len(top), i), some[top], scores[top]))
        entries += int(stop[i] * used[i])
    rest = np.flatnonzero(~sparse)
    scores = q[rest] @ rows.T
    scores[q_ids[rest][:, None] == ids[None, :]] = -np.inf
    entries += len(rest) * rows.size
    for i, own in zip(rest, scores, strict=True):
        top = best(own, ids, k)
        top = top[own[top] > -np.inf]
        out.append((np.full(len(top), i), top, own[top]))
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), entries)


def number_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The narrowest float in which all sums of products are without error; whole numbers of any size if none is."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def sortable(score: int) -> tuple[int, bytes | None, int]:
    """A score of any size as three parts that sort as it does: signed bit length and digits if beyond 2**62, and the nearest long."""
    size = score.bit_length()
    if size <= 62:
        return 0, None, score
    digits = abs(score).to_bytes(size // 8 + 1, "big")
    nearest = min(max(score, -(2**63)), 2**63 - 1)
    return (size, digits, nearest) if score > 0 else (-size, bytes(255 - x for x in digits), nearest)


def widest(q: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """Rows of a block pair whose sums are beyond a float's whole numbers: all lists are read to their ends."""
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object)
    scores, out = whole(q) @ whole(rows).T, []
    for i in range(len(q)):
        own = sorted((-s, ids[j], j) for j, s in enumerate(scores[i]) if ids[j] != q_ids[i])[:k]
        out += [(q_ids[i], ids[j], *sortable(-s)) for s, _, j in own]
    return out


FOUND = "query_id long, vec_id long, size int, digits binary, score long"


def block_pair(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    names = [x.split()[0] for x in FOUND.split(", ")]
    if not len(candidates) or not len(queries):
        return pd.DataFrame(columns=names)
    ids, q_ids = candidates["id"].to_numpy(), queries["id"].to_numpy()
    rows, q = np.stack(candidates["vector"].to_numpy()).astype(float), np.stack(queries["vector"].to_numpy()).astype(float)
    kind = number_kind(rows, q)
    if kind is object:
        return pd.DataFrame([r for i in range(0, len(q), TOGETHER) for r in widest(q[i : i + TOGETHER], q_ids[i : i + TOGETHER], rows, ids, k)], columns=names)
    q, lists, parts = q.astype(kind), Lists(rows.astype(kind), ids), []
    for i in range(0, len(q), TOGETHER):
        a, b, s, _ = no_random_access(q[i : i + TOGETHER], q_ids[i : i + TOGETHER], lists, k)
        parts.append((q_ids[i + a], ids[b], s.astype(np.int64)))
    query, found, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pd.DataFrame({"query_id": query, "vec_id": found, "size": 0, "digits": None, "score": score})


def whole_numbers(vector: Column, scale: float = 64.0) -> Column:
    """The components times ``scale``, rounded down; one of 2**53 or more is whole already, and beyond a long's range at times."""
    one = lambda y: F.when(F.abs(y) < float(2**53), F.floor(y).cast("double")).otherwise(y)
    return F.transform(vector, lambda x: one(x.cast("double") * scale))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank from 1, vec_id and score of each query's k best rows."""
    spark = rows.sparkSession
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    known = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine & (F.size(vector_col) > 0))
    # a row's spot is drawn, so that many rows of one id are dealt out like any others
    spot = F.xxhash64(F.monotonically_increasing_id()).alias("spot")
    known = materialize(known.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"), spot))
    counts = known.agg(F.count("*").alias("n"), F.count_if("query").alias("q"), F.max(F.size("vector")).alias("d")).first()
    most = max(1, BLOCK_VALUES // (counts["d"] or 1))
    spare = min(spark.sparkContext.defaultParallelism, -(-counts["n"] // LEAST_ROWS))
    blocks, query_blocks = max(1, spare, -(-counts["n"] // most)), max(1, -(-counts["q"] // most))
    place = lambda n: F.pmod("spot", F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    length = F.size("vector").alias("d")
    queries = known.filter("query").groupBy("id", "vector").agg(F.min("spot").alias("spot"))
    left = known.select("id", "vector", length, place(blocks).alias("c"), every(query_blocks).alias("b"))
    right = queries.select("id", "vector", length, every(blocks).alias("c"), place(query_blocks).alias("b"))
    keys = ["d", "c", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: block_pair(a, b, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("digits"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
