"""Quality by hierarchical empirical Bayes over documents, hosts and paths.

A logistic classifier on surface features of a whole text gives each document's evidence. Grouped
aggregations sum the evidence (the label itself for labelled training rows) by path and by host. A
host's posterior is its mean shrunk toward the global mean, a path's is its mean shrunk toward its host's
posterior; how strongly is estimated from the spread of the groups (method of moments), so sparse sites
rest on their prior. A document's final odds are its own, moved by the odds of its path's posterior
(without the document itself) over the global odds.

Labels are used only from rows outside ``held_out``, about ``train_rows`` of them for the fit (those whose
hashed ids fall below a threshold). Everything else covers all rows.

Defined results: a null or empty text has the features of no words; a very long one is gone through once
and held whole; rows that repeat an id train together or not at all; null hosts and paths are groups like
others; without labels the evidence is 0.5 throughout; repeated rows are judged and counted one by one;
an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import join_lookup, materialize, of_texts
from tessera.llm.toxicity import HASHES, held_out

TRAIN_ROWS = 20_000
THRESHOLD = 0.5
FEATURES = 10
#: Bounds of the estimated prior strengths, in documents.
STRENGTHS = (2.0, 10_000.0)

_CLASS = np.zeros(1 << 16, dtype=np.uint8)  # 0 letter, 1 upper case, 2 digit, 3 space, 4 sign
for _i in range(1 << 16):
    _c = chr(_i)
    _CLASS[_i] = 3 if _c.isspace() else 2 if _c.isdigit() else 1 if _c.isupper() else 0 if _c.isalpha() else 4


def surface(text: str) -> list[float]:
    """FEATURES numbers of a text."""
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-16-le", "replace"), dtype=np.uint16)], minlength=5)
    n = max(len(text), 1)
    words, lines = text.split(), text.split("\n")
    many, distinct = max(len(words), 1), len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        float(np.log1p(len(words))), kinds[4] / n, kinds[1] / n, kinds[2] / n, kinds[3] / n, distinct / many,
        float(np.log1p(distinct)) / float(np.log1p(many)), repeats / many, len(set(lines)) / len(lines), text.count("|") / many,
    ]


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias last), means and spreads of a logistic regression on features and their squares, by Newton steps."""
    x = np.hstack([x, x**2])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), l2 * np.append(np.ones(z.shape[1] - 1), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step / max(1.0, np.abs(step).max() / 5)
    return w, mean, spread


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, prior: Column) -> float:
    """How many documents a group's prior is worth, from the spread of group means about it beyond chance."""
    mean = F.col("s") / F.col("n")
    row = groups.agg(F.sum(F.col("n") * (mean - prior) ** 2).alias("between"), F.sum(prior * (1 - prior)).alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * prior * (1 - prior)).alias("within")).first()
    if not row["n"] or not row["within"]:
        return STRENGTHS[0]
    spread = (row["between"] - row["chance"]) / row["n"]
    return float(np.clip(row["within"] / row["n"] / spread - 1, *STRENGTHS)) if spread > 0 else STRENGTHS[1]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, evidence, host_posterior, path_posterior, score and predicted (1: good) of each row."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([surface(t or "") for t in texts])

    rows = of_texts(docs).select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), features(text_col).alias("x"))
    rows = materialize(rows)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    known = materialize(known.filter(~held_out(F.col("id"))))
    rows = materialize(join_lookup(rows, known, ["id"]))
    labelled = rows.filter("label is not null")
    share = min(1.0, train_rows / max(labelled.count(), 1))  # by a threshold of hashes: no sort
    sample = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(HASHES)) < share * HASHES).select("id", "x", "label").toPandas().sort_values("id", kind="stable")
    y = sample["label"].to_numpy(dtype=float)
    if len(set(y)) == 2:
        weights, mean, spread = fit(np.array(sample["x"].tolist(), dtype=float), y)
        z = F.lit(float(weights[-1]))
        for i in range(FEATURES):
            f = F.col("x")[i]
            z = z + (f - float(mean[i])) / float(spread[i]) * float(weights[i])
            z = z + (f * f - float(mean[FEATURES + i])) / float(spread[FEATURES + i]) * float(weights[FEATURES + i])
        evidence = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    else:
        evidence = F.lit(0.5)
    scored = rows.select("id", "host", "path", evidence.alias("evidence"), "label").withColumn("e", F.coalesce(F.col("label").cast("double"), "evidence"))

    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("e").alias("s")))
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    of_host = strength(hosts, F.lit(prior))
    hosts = materialize(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((of_host * prior + F.col("s")) / (of_host + F.col("n"))).alias("host_posterior")))
    paths = join_lookup(paths, hosts, ["host"])
    of_path = strength(paths, F.col("host_posterior"))
    paths = materialize(paths.withColumn("path_posterior", (of_path * F.col("host_posterior") + F.col("s")) / (of_path + F.col("n"))))
    out = join_lookup(scored, paths, ["host", "path"])
    host_rest = (of_host * prior + F.col("host_s") - F.col("e")) / (of_host + F.col("host_n") - 1)
    path_rest = (of_path * host_rest + F.col("s") - F.col("e")) / (of_path + F.col("n") - 1)
    score = 1 / (1 + F.exp(-(logit(F.col("evidence")) + logit(path_rest) - logit(F.lit(prior)))))
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "evidence", "host_posterior", "path_posterior", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
