"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL.

Words are cut at ASCII white space and hashed with their neighbours (one to ``order`` words)
into a fixed number of coordinates; two n-grams stand for any word that follows itself, at
once or after one other word.  A text is the vector of its counts, scaled to length 1.  The
bias is the log-odds of label 1 among the rows trained on, so that texts of unknown words
score as the average text does.
Training takes a bounded sample of labelled texts in one task; scoring is a sparse dot
product with the weights, which have a fixed size and are sent to every executor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathval.llm.common import give_back, raw
from pathval.llm.ftrl import Leader


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that training reads; scoring reads all rows."""

    bits: int = 18
    order: int = 2
    sample: int = 10_000
    epochs: int = 6
    rate: float = 4.0
    l1: float = 0.01
    l2: float = 0.001


def features(text: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The distinct coordinates of a text and their values; none for a text without words."""
    at, n = counted(text, s)
    return at, scaled(n)


def scaled(counts: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32)
    return x / np.sqrt((x * x).sum()) if len(x) else x


def counted(text: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The distinct coordinates of a text and how often each occurs."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    parts, gram = [h], h
    for n in range(2, s.order + 1):
        gram = gram[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :]
        parts.append(gram)
    for gap in (1, 2):
        parts.append(np.full(np.count_nonzero(h[gap:] == h[:-gap]), gap, np.uint64))
    mixed = np.concatenate(parts) * np.uint64(0xD6E8FEB86659FD93)
    at, n = np.unique((mixed >> np.uint64(64 - s.bits)).astype(np.int32), return_counts=True)
    return at, n.astype(np.int32)


def learned(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights and bias after ``s.epochs`` passes over the rows (coordinates, counts, label) in their order."""
    model = Leader(1 << s.bits, 1, rate=s.rate, l1=s.l1, l2=s.l2)
    good = sum(int(label) for *_, label in rows)
    bias = np.log((good + 1) / (len(rows) - good + 1))
    for _ in range(s.epochs):
        for at, n, label in rows:
            model.learn(at, scaled(n), np.array([float(label)]), bias)
    return np.concatenate([model.weights()[:, 0], [bias]]).astype(np.float32)


def fit(labelled: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Weights from ``labelled`` (text, label 0 or 1); the last entry is the bias.

    ``labelled`` must be bounded already (see :func:`sampled`).  Without rows all weights are
    zero and every score is one half.
    """

    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [counted(raw(t), s) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([x[k].tobytes() for x in rows], pa.binary()) for k in (0, 1)], names=["at", "n"])
        give_back()

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn", kind="stable")
        read = lambda x: np.frombuffer(x, np.int32)
        weights = learned([(read(at), read(n), y) for at, n, y in zip(rows["at"], rows["n"], rows["label"], strict=True)], s)
        return pd.DataFrame({"weights": [weights.tobytes()]})

    vectors = F.arrow_udf(hashed, "at binary, n binary")
    found = (
        labelled.select(F.xxhash64("text", "label").alias("turn"), "label", vectors("text").alias("v"))
        .select("turn", "label", "v.at", "v.n")
        .groupBy(F.lit(0).alias("all"))
        .applyInPandas(lambda rows: train(rows), "weights binary")
        .first()
    )
    return np.frombuffer(found[0], np.float32) if found else np.zeros((1 << s.bits) + 1, np.float32)


def sampled(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Texts of at most ``s.sample`` rows of ``labels`` (doc_id, label), chosen by a hash of the id.

    Rows with a null id or label are left out.  The chosen ids are bounded by the setting, so
    they are sent to every executor and the texts are not shuffled.
    """
    chosen = labels.dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(s.sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def score(text: Column, weights: np.ndarray, spark, s: Settings = Settings()) -> Column:
    """The probability of label 1 for each text, from 0 to 1; texts without words get the bias alone."""
    sent = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = sent.value
        for texts in batches:
            out = np.empty(len(texts))
            for k, t in enumerate(texts):
                at, x = features(raw(t), s)
                out[k] = float(w[-1]) + float(w[at] @ x)
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -60, 60))))
        give_back()

    return scored(text)
