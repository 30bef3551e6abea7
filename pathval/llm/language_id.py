"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased code points; n-grams of one to ``order`` of them are hashed into a
fixed number of coordinates.  Training counts document frequencies over all rows, reads a
bounded sample, weighs its counts by inverse document frequency, runs follow-the-regularised-leader with L1 and L2 (elastic net), then
fits one temperature on rows it held back.  Scoring is linear in a text's length and uses
weights of a fixed size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathval.llm.ftrl import Leader, activate

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows that the fit reads for each language, in expectation, and
    ``most``, dealt evenly, those of all languages; ``held_back`` of every ten rows serve the temperature."""

    bits: int = 14
    order: int = 3
    sample: int = 1_500
    most: int = 20_000
    held_back: int = 2
    epochs: int = 2
    rate: float = 1.0
    l1: float = 0.002
    l2: float = 0.002


@dataclass(frozen=True)
class Model:
    """``weights`` has a row for each coordinate, inverse document frequencies multiplied in later."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def counts(text: str, s: Settings) -> np.ndarray:
    """How often each coordinate occurs in the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    gram = points + np.uint32(1)
    total = np.zeros(1 << s.bits, np.int64)
    for n in range(1, s.order + 1):
        if n > 1:
            gram = gram[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
        if len(gram):
            total += np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - s.bits), minlength=1 << s.bits)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sublinear TF-IDF of length 1, without its zeros."""
    c = counts(text, s)
    at = np.flatnonzero(c)
    x = (1 + np.log(c[at])) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / (norm or 1)


def frequencies(texts: list[str], s: Settings) -> np.ndarray:
    """In how many of the texts each coordinate occurs, and behind these the number of texts."""
    seen = np.zeros((1 << s.bits) + 1, np.int64)
    for t in texts:
        seen[:-1] += counts(t, s) > 0
    seen[-1] = len(texts)
    return seen


def train(texts: list[str], langs: list[str], s: Settings = Settings(), seen: np.ndarray | None = None) -> Model:
    """A model of the languages found, with the frequencies ``seen`` or those of ``texts``.  Rows are taken in the order given."""
    languages = tuple(sorted(set(langs)))
    seen = frequencies(texts, s) if seen is None else seen
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    number = {x: k for k, x in enumerate(languages)}
    wanted = np.eye(len(languages))
    rows = [(*vector(t, idf, s), wanted[number[x]]) for t, x in zip(texts, langs, strict=True)]
    back = [r for k, r in enumerate(rows) if k % 10 < s.held_back]
    use = [r for k, r in enumerate(rows) if k % 10 >= s.held_back] or rows
    bias = np.zeros(len(languages))
    leader = Leader(1 << s.bits, max(2, len(languages)), s.rate, 1.0, s.l1, s.l2)
    if len(languages) > 1:
        for _ in range(s.epochs):
            for at, x, y in use:
                leader.learn(at, x, y)
    weights = leader.weights()[:, : len(languages)]
    best = (np.inf, 1.0)
    if back and len(languages) > 1:
        raw = np.array([x @ weights[at] for at, x, _ in back])
        truth = np.array([y for *_, y in back])
        for t in np.geomspace(0.05, 20, 241):
            loss = -np.log(np.maximum(1e-12, (activate(raw / t) * truth).sum(axis=1))).mean()
            best = min(best, (loss, float(t)))
    return Model(languages, idf, weights, bias, best[1])


def document_frequencies(known: DataFrame, s: Settings) -> np.ndarray:
    """:func:`frequencies` of all rows with a letter: counted by partition, summed by coordinate."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((1 << s.bits) + 1, np.int64)
        for rows in batches:
            seen += frequencies([t for t in rows["text"] if has_letter(t)], s)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": at, "n": seen[at]})

    seen = np.zeros((1 << s.bits) + 1, np.int64)
    for at, n in known.select("text").mapInPandas(counted, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        seen[at] = n
    return seen


def sampled(known: DataFrame, s: Settings) -> DataFrame:
    """``text``, ``lang``, ``turn`` of about ``s.sample`` rows a language, fewer where ``s.most`` dealt evenly is less.

    A row is taken if a hash of its text, its language and chance falls under the language's
    share, so that no language meets in one task before it is bounded, all languages
    keep their share and copies of a text don't come in together.
    """
    sizes = known.groupBy("lang").count()
    languages = max(1, sizes.count())
    share = F.least(F.lit(1.0), min(s.sample, s.most / languages) / F.col("count"))
    turn = F.xxhash64("text", "lang", F.monotonically_increasing_id())
    part = F.pmod(F.col("turn"), F.lit(1 << 30)) / (1 << 30)
    return known.withColumn("turn", turn).join(F.broadcast(sizes), "lang").where(part < share).select("text", "lang", "turn")


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from ``docs`` (text, lang); rows with a null in either, or no letter, are left out."""
    known = docs.select("text", "lang").dropna()
    seen = document_frequencies(known, s)
    chosen = sampled(known, s)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "lang", "text"], kind="stable")
        rows = rows[[has_letter(t) for t in rows["text"]]]
        m = train(rows["text"].tolist(), rows["lang"].tolist(), s, seen)
        packed = (json.dumps(m.languages), m.idf.astype(np.float32).tobytes(), m.weights.astype(np.float32).tobytes(), m.temperature)
        return pd.DataFrame([packed], columns=["languages", "idf", "weights", "temperature"])

    schema = "languages string, idf binary, weights binary, temperature double"
    row = chosen.groupBy(F.lit(0).alias("all")).applyInPandas(lambda rows: learn(rows), schema).first()
    if row is None:
        return train([], [], s)
    languages = tuple(json.loads(row[0]))
    weights = np.frombuffer(row[2], np.float32).reshape(1 << s.bits, len(languages))
    return Model(languages, np.frombuffer(row[1], np.float32), weights, np.zeros(len(languages)), row[3])


def predict(text: str | None, m: Model, s: Settings = Settings()) -> tuple[str, float]:
    """Language and its calibrated probability; ``und`` and 0 for null, no letter or no model."""
    if not m.languages or not has_letter(text):
        return UNKNOWN, 0.0
    at, x = vector(text, m.idf, s)
    p = activate((x @ m.weights[at] + m.bias) / m.temperature) if len(m.languages) > 1 else np.ones(1)
    k = int(np.argmax(p))
    return m.languages[k], float(p[k])


def language(text: Column, m: Model, spark: SparkSession, s: Settings = Settings()) -> Column:
    """A struct ``lang_pred``, ``score`` for each whole text."""
    sent = spark.sparkContext.broadcast(m)

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, sent.value, s) for t in texts], columns=["lang_pred", "score"])

    return told(text)
