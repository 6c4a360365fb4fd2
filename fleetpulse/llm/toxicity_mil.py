"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences. A sentence's score is a logistic function of its words; a
document is toxic if at least one sentence is: ``1 - prod(1 - score)``. Only document labels
are needed to train it, and the sentence scores then show where the offence is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from fleetpulse.llm.common import Cache, columns_as
from fleetpulse.session import stage

#: At most so many labelled rows of either class are learned from, taken by a hash of doc_id.
SAMPLE = {0: 3000, 1: 1500}
#: A word or beginning is a feature if at least this share of them holds it, and so many.
LEAST_SHARE, LEAST_DOCUMENTS = 0.003, 4
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 5)
#: Steps of the fit, their rate, and the weight of the squared weights in what is minimised.
ROUNDS, RATE, SHRINK = 240, 0.1, 1e-4
#: The score of a sentence without known words starts from this logit.
START = -7.0
#: Sentences end at these; one of more words than this is taken in pieces of as many.
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
PIECE = 60


def _lowered(text: str) -> str:
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, stop, words) of each sentence with a word; places are code points."""
    found = []
    for match in _SENTENCE.finditer(_lowered(text)):
        words = _WORD.findall(match.group())
        if len(words) <= PIECE:
            if words:
                found.append((match.start(), match.end(), words))
            continue
        spans = [w.span() for w in _WORD.finditer(match.group())]
        for i in range(0, len(words), PIECE):
            last = min(i + PIECE, len(words)) - 1
            place = match.start()
            found.append((place + spans[i][0], place + spans[last][1], words[i : last + 1]))
    return found


def features(word: str) -> list[str]:
    """A word counts as itself and by its beginnings, so that endings never seen count too."""
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]


@dataclass(frozen=True)
class Model:
    """Logit of a sentence: ``bias`` plus the weights of its distinct words' features."""

    bias: float
    weights: dict[str, float]

    def word(self, word: str) -> float:
        return sum([self.weights.get(f, 0.0) for f in features(word)])


class Scorer:
    """A model with a bounded memo of its words' weights."""

    def __init__(self, model: Model):
        self._bias, self._words = model.bias, Cache(model.word)

    def logits(self, bag: list[tuple[int, int, list[str]]]) -> np.ndarray:
        weight = self._words.__getitem__
        return np.array([self._bias + sum(map(weight, set(words))) for _, _, words in bag])

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        return float(-np.expm1(-_softplus(self.logits(sentences(text))).sum()))

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Places and scores of the sentences that score ``least`` or more."""
        bag = sentences(text or "")
        scores = 1 / (1 + np.exp(-self.logits(bag)))
        return [(s, e, float(p)) for (s, e, _), p in zip(bag, scores, strict=True) if p >= least]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Full-batch Adam on the noisy-or likelihood, each class weighing the same per row."""
    # Read twice, so that only the places of kept features are held, not every word.
    holders: dict[str, int] = {}
    for text in texts:
        for name in {f for _, _, words in sentences(text) for w in words for f in features(w)}:
            holders[name] = holders.get(name, 0) + 1
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * len(texts))
    names = sorted(name for name, n in holders.items() if n >= least)
    del holders
    place = {name: i for i, name in enumerate(names)}
    # One flat list of word places per sentence; slot len(names) stands for the bias.
    bias, lists, counts = len(names), [], []
    for text in texts:
        bag = sentences(text)
        counts.append(len(bag))
        for _, _, words in bag:
            known = [place[f] for w in set(words) for f in features(w) if f in place]
            lists.append(np.array([bias, *known], np.int32))
    document = np.repeat(np.arange(len(texts)), counts)
    theta = np.zeros(bias + 1)
    theta[bias] = START
    if lists and len(set(labels)) == 2:
        flat = np.concatenate(lists)
        sizes = np.array([len(x) for x in lists])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        toxic = np.array(labels)[document] == 1
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, ROUNDS + 1):
            z = np.add.reduceat(theta[flat], starts)
            clean = np.bincount(document, _softplus(z), len(texts))  # -log of P(clean)
            odds = 1 / np.maximum(np.expm1(np.minimum(clean, 50)), 1e-9)
            slope = 1 / (1 + np.exp(-z)) * np.where(toxic, -odds[document], 1.0)
            gradient = np.bincount(flat, np.repeat(slope, sizes), bias + 1) / len(texts)
            gradient[:bias] += SHRINK * theta[:bias]
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient**2
            rate = RATE / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
            theta -= rate * mean / (np.sqrt(square) + 1e-8)
    return Model(
        float(theta[bias]), {w: float(t) for w, t in zip(names, theta, strict=False) if abs(t) > 0.02}
    )


def is_held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; false for null ids."""
    left = F.crc32(doc_id.cast("string").cast("binary")) % parts
    return F.coalesce(left == part, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Learn from at most ``SAMPLE`` labelled rows that are not held out.

    Labels without a text, null labels, null ids and null texts teach nothing; an id with several labels counts as
    toxic if one of them says so. Of rows that share an id, the first text in order teaches.
    """
    known = (
        columns_as(labels, doc_id="doc_id", toxic="toxic")
        .where(F.col("toxic").isin(*SAMPLE) & F.col("doc_id").isNotNull())
        .where(~is_held_out(F.col("doc_id"), 5, 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = columns_as(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())
    known = stage(known.join(texts.select("doc_id"), "doc_id", "left_semi"), "known-labels")
    order = F.xxhash64("doc_id")
    rows = []
    for label, most in SAMPLE.items():
        chosen = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(most)
        found = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic")
        rows += found.agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda row: (row.doc_id, row.text))
    return fit([row.text for row in rows], [row.toxic for row in rows])


def score_column(model: Model, text: Column) -> Column:
    """Toxicity of each whole text: 0 for null and empty ones."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(text) for text in texts], dtype="float64")

    return score(text)


def offence_column(model: Model, text: Column) -> Column:
    """The offending sentences of each text: an array of (start, stop, score)."""
    kind = ArrayType(
        StructType(
            [
                StructField("start", IntegerType()),
                StructField("stop", IntegerType()),
                StructField("score", DoubleType()),
            ]
        )
    )

    scorer = Scorer(model)

    @F.udf(kind, useArrow=True)
    def offences(value):
        return scorer.offending(value)

    return offences(text)


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: held_out, score and predicted. Repeated rows, null ids and other
    columns need no care: each row is scored by its text alone."""
    rows = columns_as(docs, doc_id="doc_id", text="text")
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        is_held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        score_column(model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score under 0.5, with all their columns."""
    return docs.where(score_column(model, docs["text"]) < 0.5)
