"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers (``FEATURES``), each number a bin. Shallow trees, boosted in a
cycle over the features with a small step, add up to one lookup table per feature; then the
same goes on, over the strongest pairs of features, for tables of two. A score is the logistic
of the sum of the entries, read for a whole batch at a time.

The model is fitted on the driver, on the numbers (not the texts) of at most ``max_train_rows``
labelled rows, those with the least hash of their id: a documented bound. Scoring takes every row.

Null texts count as empty; empty texts have features and a score too. Rows without a label, or
with a null one, aren't learnt from; a text id labelled twice has the mean of its labels, rounded.
If no labelled row is left, or all have one label, the model is that constant (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, texts

FEATURES = (
    "log_bytes log_words word_bytes upper digit symbol bang stop_mark comma high_byte line_words dup_lines "
    "distinct_words same_as_last same_as_any_two short_words long_words bracket pipe_words"
).split()
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
BRACKETS = np.frombuffer(b"()[]{}\"'=/\\_", np.uint8)


def features(batch: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(batch), len(FEATURES)))
    for i, text in enumerate(batch):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n, chars = max(1, len(words)), max(1, len(raw))
        seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        distinct = len(set(words))
        pairs = len(set(zip(words, words[1:])))
        out[i] = (
            np.log1p(len(raw)),
            np.log1p(len(words)),
            sizes.sum() / n,
            seen[65:91].sum() / chars,
            seen[48:58].sum() / chars,
            seen[SYMBOLS].sum() / n,
            seen[33] / n,
            seen[46] / n,
            seen[44] / n,
            seen[128:].sum() / chars,
            np.log1p(n / max(1, len(lines))),
            (len(lines) - len(set(lines))) / max(1, len(lines)),
            distinct / n,
            sum(map(bytes.__eq__, words, words[1:])) / n,
            max(0, len(words) - 1 - pairs) / n,
            (sizes <= 3).sum() / n,
            (sizes >= 15).sum() / n,
            seen[BRACKETS].sum() / n,
            words.count(b"|") / n,
        )
    return out


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; small, so it travels with the tasks."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        if self.tables:
            bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
            for j, table in enumerate(self.tables):
                z += table[bins[j]]
            for j, k, table in self.pairs:
                z += table[self.coarse[j][bins[j]], self.coarse[k][bins[k]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Best place to split a row of bins in two, by the gain in the second-order loss."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2)
    best = int(np.argmax(gain))
    return float(gain[best] - g.sum() ** 2 / (h.sum() + l2)), best + 1


def _tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """A tree of depth two over the bins: a value for each."""
    value = np.empty(len(g))
    _, middle = _cut(g, h, l2)
    for part in (slice(0, middle), slice(middle, len(g))) if middle else (slice(0, len(g)),):
        gp, hp = g[part], h[part]
        gain, at = _cut(gp, hp, l2)
        at = at if gain > 1e-9 else len(gp)
        inner = np.empty(len(gp))
        inner[:at] = gp[:at].sum() / (hp[:at].sum() + l2)
        if at < len(gp):
            inner[at:] = gp[at:].sum() / (hp[at:].sum() + l2)
        value[part] = inner
    return value


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """One cut on one axis, then one on the other in each half; the better order of the two."""
    best, table = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, a.shape[0]):
            value, gain = np.empty_like(a), 0.0
            for part in (slice(0, at), slice(at, a.shape[0])):
                gp, hp = a[part].sum(0), b[part].sum(0)
                _, c = _cut(gp, hp, l2)
                for inner in (slice(0, c), slice(c, a.shape[1])):
                    s, t = gp[inner].sum(), hp[inner].sum() + l2
                    value[part, inner] = s / t
                    gain += s * s / t
            if gain > best:
                best, table = gain, value.T.copy() if turn else value
    return best - g.sum() ** 2 / (h.sum() + l2), table


def fit(
    x: np.ndarray, y: np.ndarray, cycles: int = 150, step: float = 0.15, bins: int = 32, n_pairs: int = 6, l2: float = 5.0
) -> AdditiveModel:
    """Boosts the tables: ``cycles`` over all features, then a third as many over the best pairs."""
    if not len(y):
        return AdditiveModel(0.0)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = AdditiveModel(float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [np.arange(len(e) + 1) * 8 // (len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            add = step * _tree(np.bincount(binned[j], g, len(table)), np.bincount(binned[j], h, len(table)), l2)
            table += add
            z += add[binned[j]]
    g, h = slopes()
    small = [c[b] for c, b in zip(model.coarse, binned)]

    def grid(j: int, k: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(small[j] * 8 + small[k], v, 64).reshape(8, 8)

    gains = sorted(
        ((_grid_tree(grid(j, k, g), grid(j, k, h), l2)[0], j, k) for j in range(len(small)) for k in range(j)), reverse=True
    )
    model.pairs = [(j, k, np.zeros((8, 8))) for _, j, k in gains[:n_pairs]]
    for _ in range(cycles // 3):
        for j, k, table in model.pairs:
            g, h = slopes()
            add = step * _grid_tree(grid(j, k, g), grid(j, k, h), l2)[1]
            table += add
            z += add[small[j], small[k]]
    # Center each table: the intercept then is the mean log odds, a table the effect of its feature.
    for table, b in zip(model.tables, binned):
        mean = table[b].mean()
        table -= mean
        model.intercept += mean
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, max_rows: int) -> DataFrame:
    """doc_id, text, y of the ``max_rows`` learnable rows with the least hash of their id.

    The ids are picked from the labels alone, so at most ``max_rows`` small rows are broadcast.
    """
    ids = docs.select("doc_id").distinct()
    picked = (
        labels.select("doc_id", F.col(label).cast("double").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus, rest))
        .groupBy("doc_id")
        .agg(F.round(F.avg("y")).alias("y"))
        .join(ids, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id")
        .limit(max_rows)
    )
    return docs.join(F.broadcast(picked), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train_rows: int = 16_000) -> AdditiveModel:
    """``docs`` as of ``texts``. Rows whose crc32 of the id leaves 2 by 4 are held out."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def numbers(column: pd.Series) -> pd.Series:
        return pd.Series(list(features(column.tolist())))

    rows = (
        labelled(docs, labels, label, 4, 2, max_train_rows)
        .select("doc_id", "y", numbers("text").alias("x"))
        .orderBy("doc_id", "y", "x")
        .limit(max_train_rows)
        .toPandas()
    )
    if rows.empty:
        return AdditiveModel(0.0)
    return fit(np.vstack(rows["x"].to_list()), rows["y"].to_numpy(float))


def scored(df: DataFrame, model: AdditiveModel, text: str, out: str) -> DataFrame:
    """All columns and the score."""
    small_batches(df.sparkSession)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(column.tolist())))

    return df.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.7,
    max_train_rows: int = 16_000,
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    rows = texts(docs, doc_id, text)
    model = train(rows, labels, max_train_rows=max_train_rows)
    return scored(rows, model, "text", "score").select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
