"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (ORDERS, lower-cased text, hashed to 2**BITS) of the
whole text. Training: document frequencies by class are counted in a grouped aggregation over the
labelled training rows; each feature gets r = log of the ratio of its smoothed class frequencies; those
whose frequencies differ by more than chance, in either direction, are kept, however many they are; a
logistic regression is then fitted on them, each scaled by its r. Only training looks at labels, on about
``train_rows`` rows (those of each class whose hashed ids fall below a threshold, half of them of each), a
documented bound. Scoring reads every text in one pass without a shuffle and sends the model with the
task (BITS bound its size).

Defined results: a null or empty text gets the score of a text without features; a very long one is
hashed in stretches that overlap, so that it has the features it has as a whole; rows without a label,
with null ids or labels never train; an id with several labels is toxic if one of them is; repeated rows
are scored one by one; if one class or all labels are missing the score is the smoothed share of toxic
rows; other columns are kept, but for one of the name that the score is given, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_lookup, materialize, of_texts, released

BITS = 20
ORDERS = (3, 4, 5, 6)
TRAIN_ROWS = 8_000
#: Rows that have a kept feature at least, and standard errors by which its frequencies in the two classes differ:
#: so many that of 2**BITS features without any relation to the labels less than one is kept.
LEAST_ROWS, EVIDENCE = 3, 5.0
THRESHOLD = 0.3
HASHES = 1 << 40
#: Characters hashed at once, so that memory doesn't grow with a text.
CHUNK = 1 << 18


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Grams:
    """Distinct hashed n-grams of a text."""

    def __init__(self, bits: int = BITS, orders: tuple[int, ...] = ORDERS):
        self.bits, self.orders = bits, orders
        self.last = np.zeros(1 << bits, dtype=np.int32)

    def hashed(self, text: str) -> np.ndarray:
        """A hash for each place and order of a stretch of text, repeats included."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        out, h = [], codes * np.uint32(0x9E3779B1)
        for n in range(2, max(self.orders) + 1):
            if len(codes) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :]
            if n in self.orders:
                g = h * np.uint32(0xC2B2AE35)
                out.append((g ^ (g >> np.uint32(13))) >> np.uint32(32 - self.bits))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def of(self, text: str, among: np.ndarray | None = None) -> np.ndarray:
        """Distinct features; only those that ``among`` marks."""
        whole, lap = f" {text.lower()} ", max(self.orders) - 1
        found = []
        for i in range(0, max(1, len(whole) - lap), CHUNK):  # a stretch's last grams reach into the next
            h = self.hashed(whole[i : i + CHUNK + lap])
            found.append(self.distinct(h if among is None else h[among[h]]))
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))

    def distinct(self, h: np.ndarray) -> np.ndarray:
        places = np.arange(len(h), dtype=np.int32)
        self.last[h] = places
        return h[self.last[h] == places]


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, width: int, ratios: np.ndarray, l2: float = 3.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights of sparse 0/1 rows, each feature scaled by its ratio; full-batch Adam."""
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    feature = np.concatenate(rows) if len(at) else np.zeros(0, dtype=np.int32)
    value = ratios[feature].astype(np.float32)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(at, value * w[feature], len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(feature, value * err[at], width) + l2 * w / len(y), err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def kept(counted: DataFrame, n0: int, n1: int) -> DataFrame:
    """Adds the log-count ratio ``r`` and its evidence ``z`` to features (f, n0, n1: rows of each class that have it), and keeps the evident ones."""
    ratio = F.log((F.col("n1") + 1.0) / (n1 + 2.0)) - F.log((F.col("n0") + 1.0) / (n0 + 2.0))
    common = (F.col("n0") + F.col("n1") + 1.0) / (n0 + n1 + 2.0)
    z = (F.col("n1") / float(n1) - F.col("n0") / float(n0)) / F.sqrt(common * (1 - common) * (1 / n1 + 1 / n0))
    return counted.withColumns({"r": ratio, "z": z}).filter((F.col("n0") + F.col("n1") >= LEAST_ROWS) & (F.abs("z") > EVIDENCE))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> dict:
    """A model: kept feature numbers, their weights and the bias."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = known.filter(~held_out(F.col("id")))
    all_rows = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    # below the threshold lie about half of train_rows of each class: no sort, and nothing is collected
    share = {y: min(1.0, train_rows / 2 / n) for y, n in all_rows.items()}
    below = F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * float(HASHES)
    chosen = materialize(known.filter(F.pmod(F.xxhash64("id"), F.lit(HASHES)) < below))
    n1, n0 = (chosen.filter(F.col("y") == y).count() for y in (1, 0))
    if not n1 or not n0:
        return {"ids": np.zeros(0, dtype=np.int64), "weights": np.zeros(0), "bias": float(np.log((n1 + 1) / (n0 + 1)))}
    rows = of_texts(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = join_lookup(rows, chosen, ["id"], "inner")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, counts = Grams(), np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                counts[y, grams.of(text)] += 1
        some = np.flatnonzero(counts.sum(0))
        yield pd.DataFrame({"f": some, "n0": counts[0, some], "n1": counts[1, some]})

    counted = rows.mapInPandas(released(count), "f int, n0 int, n1 int").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = kept(counted, n0, n1).select("f", "r").toPandas().sort_values("f")
    ids, ratios = best["f"].to_numpy(), best["r"].to_numpy()
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[ids] = np.arange(len(ids))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, among = Grams(), number >= 0
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "f": [number[grams.of(t, among)].astype("<i4").tobytes() for t in batch["text"]]})

    got = rows.mapInPandas(released(keep), "id long, y int, f binary").toPandas().sort_values("id")
    w, b = fit_logistic([np.frombuffer(x, dtype="<i4") for x in got["f"]], got["y"].to_numpy().astype(float), len(ids), ratios)
    # the sample holds more toxic rows than the labels do: shift the odds back
    shift = np.log(all_rows[1] / all_rows[0]) - np.log(n1 / n0)
    return {"ids": ids, "weights": w * ratios, "bias": b + float(shift)}


def score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows of ``docs`` with a column ``name`` from 0 to 1."""
    ids, weights, bias = model["ids"], model["weights"], model["bias"]

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, among, of = Grams(), np.zeros(1 << BITS, dtype=bool), np.zeros(1 << BITS)
        among[ids], of[ids] = True, weights
        for texts in batches:
            z = np.array([of[grams.of(t or "", among)].sum() + bias for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return of_texts(docs).withColumn(name, toxic(F.col(text_col)))
