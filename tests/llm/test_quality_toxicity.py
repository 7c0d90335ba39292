from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_tables import documents  # noqa: F401 - a fixture

from paycadence.llm import quality, queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=240):
    """Good prose, shouting junk, and insults in some good texts."""
    random.seed(4)
    words = ["alder", "brook", "cedar", "dune", "ember", "fjord", "grove", "heath", "islet", "knoll", "lagoon", "meadow"]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(random.choices(words, k=8)).capitalize() + "." for _ in range(6)]
        good, toxic = i % 4 != 0, i % 3 == 0
        if toxic:
            sentences[3] = "You vile " + sentences[3].lower()
        text = " ".join(sentences)
        docs.append((i, text if good else text.upper().replace(" ", "!! ") + " $$$ ###"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


ODD = [(None, "Alder brook. Cedar dune."), (9001, None), (9002, ""), (9003, "word " * 30_000), (7, "Brook!"), (7, "Brook!"), (9004, "\n\t \x0b")]


def test_classifiers_learn_and_score_every_row(spark, documents):
    docs, labels = corpus()
    table, marks = documents(docs + ODD), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (5, 1, 0), (5, 1, 0)], LABELS)
    for module, label, modulus, rest, threshold in ((quality, 1, 4, 2, 0.7), (toxicity, 2, 5, 0, 0.5)):
        rows = module.classify(table, marks).collect()
        assert sorted(r.doc_id is None for r in rows) == sorted(d[0] is None for d in docs + ODD) and len(rows) == len(docs) + len(ODD)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
        truth = {x[0]: x[label] for x in labels}
        judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth and r.doc_id != 7]
        assert len(judged) > 20 and np.mean([p == t for p, t in judged]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark, documents):
    docs, labels = corpus(80)
    turned = [(i, *((1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (q, t))) for i, q, t in labels]
    a, b = (
        {r.doc_id: r.score for r in quality.classify(documents(docs), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned)
    )
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (3, 1, 0)]])
def test_without_both_classes_scores_are_constant(spark, documents, labels):
    table, marks = documents([(1, "a b"), (3, None), (4, "c")]), spark.createDataFrame(labels, LABELS)
    for module in (quality, toxicity):
        assert len({r.score for r in module.classify(table, marks).collect()}) == 1
        assert module.classify(documents([]), marks).count() == 0


def test_boosting_finds_a_pairwise_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000], n_pairs=1)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.8
    # A score is the intercept and one entry of each table.
    bins = [int(np.searchsorted(e, v, side="right")) for e, v in zip(model.edges, x[0])]
    z = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
    z += sum(t[model.coarse[j][bins[j]], model.coarse[k][bins[k]]] for j, k, t in model.pairs)
    assert np.isclose(model.score(x[:1])[0], 1 / (1 + np.exp(-z)))


def test_noisy_or_and_the_sentences_to_blame(spark, documents):
    docs, labels = corpus()
    model = toxicity.train(documents(docs).select("doc_id", "text"), spark.createDataFrame(labels, LABELS))
    scorer = toxicity.Scorer(model)
    text = "Alder brook cedar. You vile ember dune! Fjord grove heath"
    spans = scorer.spans(text)
    assert [text[a:b].strip() for a, b, p in spans if p >= 0.5] == ["You vile ember dune"]
    assert np.isclose(scorer.scores([text])[0], 1 - np.prod([1 - p for _, _, p in spans]))
    found = toxicity.locate(documents([(1, text), (2, None), (3, "İ " + text)]), model).collect()
    assert sorted((r.doc_id, {1: text, 3: "İ " + text}[r.doc_id][r.start : r.end].strip()) for r in found) == [
        (1, "You vile ember dune"), (3, "You vile ember dune"),
    ]


def test_noisy_or_gradient_by_differences():
    """The likelihood at the learnt weights is higher than around them."""
    bags = [[[0], [1, 2], []], [[2], [1]], [[1]], [[0, 1], [2]], [[2], []], [[1], [1, 2]]] * 5
    y = np.array([1, 0, 0, 1, 0, 1] * 5)
    bias, w = toxicity.learn(bags, y, 3, l2=0.05, rounds=3000, step=0.02)

    def likelihood(b, v):
        total = -0.025 * float(np.dot(v, v))
        for bag, label in zip(bags, y):
            none = np.prod([1 - 1 / (1 + np.exp(-(b + sum(v[t] for t in s)))) for s in bag])
            total += np.log(1 - none) if label else np.log(none)
        return total

    top = likelihood(bias, w)
    for k, d in itertools.product(range(3), (-0.2, 0.2)):
        near = w.copy()
        near[k] += d
        assert likelihood(bias, near) < top
    assert likelihood(bias - 0.2, w) < top and likelihood(bias + 0.2, w) < top


def test_registered_queries(spark, tables):
    for query, modulus, rest in ((queries.op1_quality_additive, 4, 2), (queries.op5_toxicity_bags, 5, 0)):
        df = query(spark, tables)
        assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
        assert df.count() == spark.read.parquet(f"{tables}/documents.parquet").count()
        assert df.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest)).count() == 0
