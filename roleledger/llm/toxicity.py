"""Toxicity: a support vector machine on words under a gapped subsequence string kernel, with Nyström landmarks.

The kernel of two words sums, over every subsequence of three characters that both hold within
``SPAN`` characters, the decay to the power of the spans taken up in both; it is divided by what a word
of that length could reach with itself. Inserted and left-out characters so cost decay, not the match.
Landmark words give the machine its features; as both the kernel and the Nyström map are linear in the
subsequences, the trained machine folds into one weight per subsequence, and a word is scored by lookups.
A text's margin is the one of its strongest word, and a logistic curve makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from roleledger.llm.labelled import fold, sample
from roleledger.llm.tables import bounded, staged

SPAN = 5
DECAY = 0.7
# Characters fall into so many classes; class 0 is white space.
CLASSES = 64
CODES = CLASSES**3
GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
MAX_TRAINING_ROWS = 12_000
MAX_WORDS = 4_000
LANDMARKS = 192
CUT = 0.5
# Characters scored at a time inside a task.
BLOCK = 1 << 18


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000: letters of their own up to U+00FF, the rest by remainder."""
    table = np.zeros(0x3000, np.uint8)
    for code in range(len(table)):
        letter = chr(code).lower()
        if not chr(code).isspace():
            first = ord(letter[0])
            table[code] = 1 + first - 97 if 97 <= first <= 122 else 27 + first % (CLASSES - 27)
    return table


CLASS_OF = _classes()


def characters(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return CLASS_OF[np.minimum(points, len(CLASS_OF) - 1)].astype(np.int32)


def _reach(length: np.ndarray) -> np.ndarray:
    """Square root of the kernel of a word with itself, were its subsequences all different."""
    total = np.zeros(len(length))
    for _, last in GAPS:
        total += np.maximum(length - last, 0) * DECAY ** (2 * (last + 1))
    return np.sqrt(np.maximum(total, DECAY ** (2 * SPAN)))


def _words(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of an array of classes begin and how long they are."""
    inside = np.concatenate([[0], (found > 0).view(np.int8), [0]])
    edges = np.diff(inside)
    starts = np.flatnonzero(edges == 1)
    return starts, np.flatnonzero(edges == -1) - starts


def _sequences(found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: where a subsequence inside a word begins, its code, and its weight."""
    starts, lengths = _words(found)
    left = np.zeros(len(found), np.int32)
    left[np.repeat(starts, lengths) + _ramp(lengths)] = np.repeat(lengths, lengths) - _ramp(lengths)
    for second, last in GAPS:
        at = np.flatnonzero(left > last)
        yield at, (found[at] * CLASSES + found[at + second]) * CLASSES + found[at + last], DECAY ** (last + 1)


def _ramp(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def subsequences(words: list[str]) -> np.ndarray:
    """The kernel's feature vector of each word, one row a word; for bounded numbers of words."""
    codes: dict[int, int] = {}
    rows = []
    for word in words:
        found = characters("".join(word.split()))
        reach = float(_reach(np.array([len(found)]))[0])
        rows.append(
            [(codes.setdefault(int(c), len(codes)), w / reach) for _, cs, w in _sequences(found) for c in cs]
        )
    out = np.zeros((len(words), len(codes)))
    for i, row in enumerate(rows):
        for j, weight in row:
            out[i, j] += weight
    return out, np.array(list(codes), np.int64)


@dataclass(frozen=True)
class Machine:
    """A weight per subsequence code, the bias, and the curve from margin to probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, text: str | None) -> float:
        """The margin of the strongest word; the bias for texts without words."""
        best = self.bias
        for block in blocks(text or ""):
            found = characters(block)
            starts, lengths = _words(found)
            if not len(starts):
                continue
            sums = np.zeros(len(found))
            for at, codes, weight in _sequences(found):
                sums[at] += weight * self.weights[codes]
            reached = np.add.reduceat(sums, starts) / _reach(lengths)
            best = max(best, float(reached.max()) + self.bias)
        return best

    def probability(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35))))


def blocks(text: str) -> Iterator[str]:
    """A long text in pieces that end at white space."""
    start = 0
    while len(text) - start > BLOCK and (cut := text.find(" ", start + BLOCK)) >= 0:
        yield text[start:cut]
        start = cut
    yield text[start:]


def _support_vectors(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the examples inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        xs, c = x[inside], cost * weight[inside]
        new = np.linalg.solve(ridge + xs.T @ (xs * c[:, None]), xs.T @ (c * y[inside]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def train(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS) -> Machine:
    """The machine, without its curve, from words; landmarks are the first words of either list."""
    words = toxic + clean
    if not toxic or not clean:
        return Machine(np.zeros(CODES), 0.0)
    vectors, codes = subsequences(words)
    chosen = np.r_[: min(landmarks // 2, len(toxic)), len(toxic) : len(toxic) + min(landmarks // 2, len(clean))]
    base = vectors[chosen]
    values, axes = np.linalg.eigh(base @ base.T)
    kept = values > 1e-6 * values.max()
    whiten = axes[:, kept] / np.sqrt(values[kept])
    z = vectors @ base.T @ whiten
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    weight = np.where(y > 0, 0.5 * len(y) / len(toxic), 0.5 * len(y) / len(clean))
    w, bias = _support_vectors(z, y, weight / weight.mean())
    weights = np.zeros(CODES)
    weights[codes] = base.T @ whiten @ w
    return Machine(weights, bias)


def _margins(docs: DataFrame, machine: Machine, *kept: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        return texts.map(held.value.margin)

    return docs.select(*kept, margin(F.coalesce("text", F.lit(""))).alias("margin"))


def fit(examples: DataFrame, most_words: int = MAX_WORDS) -> Machine:
    """A machine from ``doc_id``, ``text``, ``label``.

    Sentences bear the label of their text, and the words of a toxic text that speak most for the label
    stand for it. At most ``most_words`` words of each kind, and one margin per example, come to the
    driver. Without examples of both labels every score is one half.
    """
    sentence = F.explode(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+"))
    sentences = examples.select("doc_id", "label", sentence.alias("sentence"))
    word = F.explode(F.array_distinct(F.split(F.lower("sentence"), r"\s+")))
    held = staged(sentences.select("doc_id", "label", word.alias("word")).where("length(word) > 2").distinct(), "held")
    counts = held.groupBy("word").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    size = held.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()
    total = {row["label"]: row["n"] for row in size}
    if len(total) < 2:
        return Machine(np.zeros(CODES), 0.0)
    odds = F.log((F.col("bad") + 0.5) / total[1]) - F.log((F.col("good") + 0.5) / total[0])
    strength = staged(counts.withColumn("strength", odds * F.sqrt("bad")).where("bad > 1 and strength > 0"), "strength")
    witness = held.where("label = 1").join(strength, "word").groupBy("doc_id").agg(
        F.max(F.struct("strength", "word"))["word"].alias("word"), F.max("strength").alias("strength")
    )
    witness = witness.groupBy("word").agg(F.count("*").alias("texts"), F.max("strength").alias("strength"))
    toxic = witness.orderBy(F.desc("strength"), "word").limit(most_words).toPandas()
    # A word that stands for its texts only because copies of one text repeat it is weaker than the real ones.
    toxic = toxic[toxic["strength"] >= 0.05 * toxic["strength"].max()]["word"].tolist() if len(toxic) else []
    order = F.xxhash64("word")
    clean = [row["word"] for row in counts.where("bad = 0 or good > 20").orderBy(order, "word").limit(most_words).collect()]
    machine = train(toxic, clean)
    # Clean words that come close to the margin are learnt from in a second round.
    close = _margins(counts.where("good > 0 and bad <= good").withColumnRenamed("word", "text"), machine, "text")
    close = [row["text"] for row in close.orderBy(F.desc("margin"), "text").limit(most_words // 4).collect()]
    machine = train(toxic, clean + [w for w in close if w not in set(clean)])
    seen = _margins(examples, machine, "label").toPandas()
    return _with_curve(machine, seen["margin"].to_numpy(), seen["label"].to_numpy())


def _with_curve(machine: Machine, margins: np.ndarray, labels: np.ndarray) -> Machine:
    """Fit slope and offset of the logistic curve by Newton steps with a small ridge."""
    x = np.column_stack([margins, np.ones(len(margins))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (labels - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Machine(machine.weights, machine.bias, float(w[0]), float(w[1]))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> Column:
    """Probability of toxicity of every whole text; null and empty texts have the margin of no word."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: held.value.probability(held.value.margin(value)))

    return scored(F.coalesce(F.col(text), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Learns the label ``toxic`` from at most ``most`` rows whose crc32(doc_id) mod 5 is not 0. Only the
    text is an input of a score. Null and empty texts have the score of a text without words; a row
    without doc_id is scored too and never held out; repeated rows give a row each.
    """
    machine = fit(sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, most))
    out = docs.select("doc_id", "text").withColumn("score", score(docs, machine))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
