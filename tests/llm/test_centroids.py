from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paycadence.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, x string, n long"


def plain_clusters(rows, dims, k=8, rounds=10, scale=1024):
    """Every distance of every round, in Python integers."""
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e):
            kept.append((vec_id, [math.floor(scale * v) for v in e]))
    hashed = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [x for _, x in sorted(kept, key=lambda r: (*hashed(r[0]), r[1]))[:k]]

    def assigned():
        out = []
        for _, x in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centres)))
        return out

    for _ in range(rounds):
        best = assigned()
        for i in range(len(centres)):
            mine = [x for (_, x), (_, c) in zip(kept, best) if c == i]
            if mine:
                centres[i] = [sum(v) // len(mine) for v in zip(*mine)]
    best = assigned()
    inertia = [sum(d for d, c in best if c == i) for i in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    fits = lambda v: v if v < 2**63 else None
    whole = None if any(d >= 2**63 for d, _ in best) else fits(sum(inertia))
    some = [None if any(d >= 2**63 for d, c in best if c == i) else fits(inertia[i]) for i in range(len(centres))]
    return [(i, c, fits(d), some[c], whole, digest[c]) for (i, _), (d, c) in zip(kept, best)]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def compare(spark, rows, dims, **options):
    table = spark.createDataFrame([(i, e, 0, 3, "x", 9) for i, e in rows], SCHEMA).repartition(3)
    out, state = centroids.cluster(table, dims=dims, axes=min(dims, 4), **options)
    assert out.columns == COLUMNS
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain_clusters(rows, dims, options.get("k", 8), options.get("rounds", 10))))
    return state


def blobs(seed, n, dims):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (6, dims))
    return [(i, (middle[i % 6] + rng.normal(0, 0.2, dims)).tolist()) for i in range(n)]


def test_clusters_equal_every_distance(spark):
    rows = blobs(1, 400, 10)
    state = compare(spark, rows, 10)
    assert state.vectors == 400 and len(state.verified) == 11
    # The filter leaves fewer than half of the distances to be computed.
    assert sum(state.verified[1:]) < 0.5 * 10 * 400 * 8


def test_ties_repeats_and_unsound_vectors(spark):
    random.seed(2)
    points = [[float(a), float(b)] for a in (0, 1, 2) for b in (0, 1)]
    rows = [(i, random.choice(points)) for i in range(80)] + [(3, [0.0, 0.0])] * 4 + [(None, [2.0, 1.0]), (None, [-0.0005, 0.0])]
    rows += [(500, None), (501, []), (502, [1.0]), (503, [1.0, 2.0, 3.0]), (504, [None, 1.0]), (505, [math.nan, 1.0]), (506, [math.inf, 0.0])]
    compare(spark, rows, 2)


def test_one_hot_vector_and_empty_clusters(spark):
    compare(spark, [(i, [0.25, 0.5, -1.0]) for i in range(120)] + [(1000, [5.0, 5.0, 5.0])], 3)
    compare(spark, [(4, [1.0, 2.0]), (5, [3.0, 2.0])], 2)
    compare(spark, [(None, [1.0, 2.0])], 2)


@pytest.mark.parametrize("size", [1e5, 1e6, 1e13])
def test_large_numbers_stay_exact(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.choice([1.0, size], 3) * rng.normal(0, 1, 3)).tolist()) for i in range(40)]
    compare(spark, rows, 3, k=4, rounds=3)


def test_beyond_longs_and_empty_tables(spark):
    table = spark.createDataFrame([(1, [1e300, 0.0], 0, 0, "", 0)], SCHEMA)
    assert centroids.cluster(table, dims=2)[0].count() == 0
    out, _ = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert out.columns == COLUMNS and out.count() == 0


@given(st.integers(0, 10**6), st.integers(1, 5), st.sampled_from([1, 40, 10**5]))
@settings(max_examples=60, deadline=None)
def test_bounds_never_hide_the_nearest(seed, axes, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (50, 5))
    centres = x[rng.integers(0, 50, 6)] if seed % 2 else rng.integers(-spread, spread + 1, (6, 5))
    mean = x.mean(axis=0)
    rotation = centroids.Rotation.fit(mean, np.cov(x.T), axes)
    y, r = rotation.turned(x)
    assert np.allclose(rotation.basis @ rotation.basis.T, np.eye(axes))
    best, least, _ = centroids.nearest(x, y, r, centres, rotation)
    every = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
