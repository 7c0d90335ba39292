"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the bag has a label. A sentence's probability is the
logistic of a bias and the weights of its distinct terms (words and word beginnings); a document
is toxic unless none of its sentences is: noisy-or, 1 - prod(1 - p). The weights maximise the
likelihood of the document labels, so blame settles on the sentences that tell toxic documents
apart; ``locate`` then returns those sentences.

Bounds of the fit, both parameters: ``max_train_docs`` labelled documents, those with the least
hash of their id, and ``max_terms`` terms, those with the largest chi-square against the label.
Scoring takes every row and every word.

A null text counts as empty; a text without words has one empty sentence and so a low score.
Rows without a label, or with a null one, aren't learnt from. Without labels, or with one class
only, the score is constant: the share of positive labels, 0 without any.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, texts
from .quality import labelled

ENDS = re.compile(r"[.!?\n]+")
EDGES = "\"'()[]{}<>|#$%&*,;:-_=+/\\~`^"
PREFIXES = (3, 4, 5, 7, 9)
#: Words whose weight a worker remembers before it starts anew.
REMEMBERED = 200_000


def terms(word: str) -> list[str]:
    """The word, and its beginnings marked as such."""
    word = word.strip(EDGES)
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) >= n)] if word else []


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence with a character other than white space."""
    at = 0
    for m in ENDS.finditer(text):
        if text[at : m.start()].strip():
            yield at, m.start()
        at = m.end()
    if text[at:].strip():
        yield at, len(text)


@dataclass
class BagModel:
    """``constant`` stands for the whole model if nothing could be learnt."""

    bias: float = -8.0
    weights: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def word(self, chunk: str) -> float:
        return sum(self.weights.get(t, 0.0) for t in terms(chunk))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Scorer:
    """Scores texts; remembers the weight of each word it has met."""

    def __init__(self, model: BagModel):
        self.model, self.known = model, {}

    def _sentence(self, sentence: str) -> float:
        known, z = self.known, self.model.bias
        for chunk in set(sentence.split()):
            w = known.get(chunk)
            if w is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                w = known[chunk] = self.model.word(chunk)
            z += w
        return z

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case; places must hold
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        return [(a, b, float(_sigmoid(self._sentence(low[a:b])))) for a, b in sentences(low)]

    def scores(self, batch: list[str]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(batch), self.model.constant)
        logits, owner = [], []
        for i, text in enumerate(batch):
            found = [self._sentence(s) for s in ENDS.split(text.lower()) if s and not s.isspace()] or [self.model.bias]
            logits += found
            owner += [i] * len(found)
        clean = np.bincount(owner, np.log1p(-_sigmoid(np.array(logits)) * (1 - 1e-12)), len(batch))
        return -np.expm1(clean)


def learn(bags: list[list[list[int]]], y: np.ndarray, n_terms: int, rounds: int = 400, step: float = 0.1, l2: float = 0.005):
    """Bias and weights by gradient ascent (Adam) on the noisy-or likelihood."""
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat = [s for b in bags for s in b]
    row = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    col = np.fromiter((t for s in flat for t in s), np.int64, len(row))
    theta = np.zeros(n_terms + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        p = _sigmoid(theta[-1] + np.bincount(row, theta[col], len(flat)))
        none = np.exp(np.bincount(bag, np.log1p(-p * (1 - 1e-9)), len(bags)))
        odds = np.clip(none / np.maximum(1 - none, 1e-9), 0, 1e3)
        slope = p * np.where(y > 0.5, odds, -1.0)[bag]
        grad = np.append(np.bincount(col, slope[row], n_terms) - l2 * theta[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[-1], theta[:-1]


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train_docs: int = 12_000, max_terms: int = 600
) -> BagModel:
    """``docs`` as of ``texts``. Rows whose crc32 of the id leaves 0 by 5 are held out."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, label, 5, 0, max_train_docs).select("doc_id", "y", "text")

    def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tally = {0.0: Counter(), 1.0: Counter()}
            for y, text in zip(batch["y"], batch["text"]):
                words = {w for s in ENDS.split(text.lower()) for w in s.split()}
                tally[y].update({t for w in words for t in terms(w)})
            every = list(tally[0.0].keys() | tally[1.0].keys())
            yield pd.DataFrame({"term": every, "n0": [tally[0.0][t] for t in every], "n1": [tally[1.0][t] for t in every]})

    classes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = classes.get(0.0, 0), classes.get(1.0, 0)
    if not n0 or not n1:
        return BagModel(constant=float(bool(n1)))
    a, b = F.col("n1"), F.col("n0")
    n, seen = F.lit(float(n0 + n1)), F.col("n1") + F.col("n0")
    strength = (a * n0 - b * n1) ** 2 * n / (seen * (n - seen + 1) * float(n0) * float(n1))
    vocabulary = (
        rows.mapInPandas(count_terms, "term string, n0 long, n1 long")
        .groupBy("term")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .filter((a >= 4) & (a * n0 > 2 * b * n1))
        .orderBy(strength.desc(), "term")
        .limit(max_terms)
    )
    names = [r["term"] for r in vocabulary.collect()]
    place = {t: i for i, t in enumerate(names)}

    @F.pandas_udf("array<array<int>>")
    def bags(column: pd.Series) -> pd.Series:
        found = []
        for text in column:
            sets = [
                sorted({place[t] for w in s.split() for t in terms(w) if t in place})
                for s in ENDS.split(text.lower())
                if s and not s.isspace()
            ]
            found.append(sets or [[]])
        return pd.Series(found)

    got = rows.select("doc_id", "y", bags("text").alias("bag")).orderBy("doc_id", "y").limit(max_train_docs).collect()
    bias, weights = learn([r["bag"] for r in got], np.array([r["y"] for r in got]), len(names))
    return BagModel(float(bias), {t: float(w) for t, w in zip(names, weights) if abs(w) > 1e-3})


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.5,
    max_train_docs: int = 12_000,
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    rows = texts(docs, doc_id, text)
    model = train(rows, labels, max_train_docs=max_train_docs)

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for column in columns:
            yield pd.Series(scorer.scores(column.tolist()))

    return rows.select("doc_id", held_out(5, 0).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def locate(docs: DataFrame, model: BagModel, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, start, end and score of each sentence that is toxic by itself; offsets in code points."""
    small_batches(docs.sparkSession)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            found = [(d, *s) for d, t in zip(batch["doc_id"], batch["text"]) for s in scorer.spans(t) if s[2] >= least]
            yield pd.DataFrame(found, columns=["doc_id", "start", "end", "score"])

    rows = texts(docs, doc_id, text)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(find, f"doc_id {kind}, start long, end long, score double")
