"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from roleledger.llm.labelled import fold, sample
from roleledger.llm.words import mixed

# Runs of letters and digits, and runs of signs, are the words.
WORD = re.compile(r"\w+|[^\w\s]+")
BITS = 20
# Hash of a pair of equal words.
TWICE = np.uint64(0x5851F42D4C957F2D)
# Added to the number of features when they are scaled.
FEW = 100
MAX_TRAINING_ROWS = 12_000
CUT = 0.7


@dataclass(frozen=True)
class Settings:
    """Of the FTRL-proximal learner: step size, its smoothing, and the two penalties."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.01
    passes: int = 4


class _Seen(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 50_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_SEEN = _Seen()


def features(text: str | None) -> np.ndarray:
    """Hashed indices of the distinct words and word pairs of a text; a word after itself is one feature for all words."""
    words = WORD.findall((text or "").lower())
    hashes = np.fromiter(map(_SEEN.__getitem__, words), np.uint64, len(words))
    pairs = np.where(hashes[:-1] == hashes[1:], TWICE, mixed(hashes[:-1] + np.uint64(1)) ^ hashes[1:])
    found = np.concatenate([hashes, pairs]) % np.uint64((1 << BITS) - 1) + np.uint64(1)
    return np.unique(found).astype(np.int32)


def _strength(found: np.ndarray) -> float:
    """Value of each feature of a text: long texts are about of length one, short ones say less."""
    return 1.0 / np.sqrt(len(found) + FEW)


def _sigmoid(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))))


def probability(weights: np.ndarray, found: np.ndarray) -> float:
    """Index 0 of the weights is the bias: the log odds of the label before any word is seen."""
    return _sigmoid(weights[0] + weights[found].sum() * _strength(found))


def train(examples: list[tuple[np.ndarray, int]], settings: Settings) -> np.ndarray:
    """Weights by FTRL-proximal over the examples in the order given.

    The bias is fixed at the log odds of the labels, so that a text too short to tell is judged by them.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    good = sum(label for _, label in examples)
    bias = np.log((good + 0.5) / (len(examples) - good + 0.5))

    def lazily(found: np.ndarray) -> np.ndarray:
        own = z[found]
        scale = (settings.beta + np.sqrt(n[found])) / settings.alpha + settings.l2
        return np.where(np.abs(own) <= settings.l1, 0.0, (np.sign(own) * settings.l1 - own) / scale)

    for _ in range(settings.passes):
        for found, label in examples:
            strength, now = _strength(found), lazily(found)
            step = (_sigmoid(bias + now.sum() * strength) - label) * strength
            sigma = (np.sqrt(n[found] + step * step) - np.sqrt(n[found])) / settings.alpha
            z[found] += step - sigma * now
            n[found] += step * step
    weights = lazily(np.arange(1 << BITS))
    weights[0] = bias
    return weights


def fit(examples: DataFrame, settings: Settings | None = None) -> np.ndarray:
    """Weights from ``doc_id``, ``text``, ``label``: a bounded sample, read in the order of its ids.

    Features are made where the texts are; the learner, which has to see one example after the other,
    runs in one task on the sample's feature numbers. The weights are at most 2**20 numbers.
    Without examples all weights are zero, so every score is one half.
    """
    settings = settings or Settings()

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "found", "label"]
            )

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            (row["doc_id"], row["found"], row["label"]) for batch in batches for row in batch.to_pylist()
        )
        rows.sort(key=lambda row: xxhash.xxh3_64_intdigest(str(row[0])))
        weights = train([(np.frombuffer(found, np.int32), label) for _, found, label in rows], settings)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(weights[used])], ["i", "w"])

    wide = examples.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(
        indexed, "doc_id long, found binary, label int"
    )
    table = wide.repartition(1).mapInArrow(learnt, "i long, w double").toPandas()
    weights = np.zeros(1 << BITS)
    weights[table["i"].to_numpy()] = table["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """Probability of good quality for every text: a sparse dot product; null and empty texts have the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: probability(held.value, features(value)))

    return scored(F.coalesce(F.col(text), F.lit("")))


def quality(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Learns the label ``quality`` from at most ``most`` rows whose crc32(doc_id) mod 4 is not 2. Only the
    text is an input of a score. Null and empty texts have the score of an empty text; a row without
    doc_id is scored too and never held out; repeated rows give a row each.
    """
    weights = fit(sample(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2, most))
    out = docs.select("doc_id", "text").withColumn("score", score(docs, weights))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
