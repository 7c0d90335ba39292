"""Centroid clustering in whole numbers with a filter in PCA-rotated coordinates.

Vectors become whole numbers, floor(scale * x). Their covariance gives an orthonormal basis; each
vector is stored with its first ``axes`` rotated coordinates and the norm of the rest. For a vector
and a centroid the squared distance of these coordinates plus the squared difference of the two
norms is never more than their squared distance. So a round takes the exact distance to the centroid
of the least bound, and computes exact distances to those others only whose bound (less a margin for
rounding) isn't above it. Everything decided is decided in whole numbers: the basis, and the order
in which floats were added, change how much is computed, not what comes out.

A round is one pass over the stored vectors: every task adds up its own vectors, and one row for each
cluster and task is combined before it is shuffled. Only ``k`` centroids reach the driver, and only
they are sent out. No rows meet by vector or by cluster, so equal vectors make no hot task.

Left out: vectors of another length or with null, NaN or infinite components, and null vectors; also
those with a component of 2 ** 62 / scale or more, whose whole numbers fit no long. Numbers beyond 2 ** 27
are worked on as Python integers, so they stay exact; a distance or a sum that fits no long is null.
Starting centroids are the vectors with the least SHA-256 of ``seed:id``, equal ids in the order of
their components and null ids last; with fewer vectors than ``k`` there are as many centroids as
vectors. Repeated rows are vectors of their own. No vectors give no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, ship

DIMS, SCALE, AXES = 64, 1024, 16
#: Whole numbers up to here have squared distances that fit a long.
LIMIT = 1 << 27
LONGEST = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """vec_id and x, the whole numbers of the vectors that are kept."""
    e = F.col(embedding)
    sound = (F.size(e) == dims) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < 2.0**62 / scale))
    x = F.transform(e, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def moments(numbers: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of all vectors; each task sends ``dims`` rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(float)
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        if n:
            rows = np.column_stack([total, square])
            yield pa.RecordBatch.from_pydict({"i": list(range(dims)), "n": [n] * dims, "s": list(rows)}, pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]))

    sums = numbers.select("x").mapInArrow(partial, "i int, n long, s array<double>").groupBy("i")
    rows = sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(dims + 1)]).alias("s")).collect()
    if not rows:
        return 0, np.zeros(dims), np.eye(dims)
    table = np.array([r["s"] for r in sorted(rows, key=lambda r: r["i"])])
    n = rows[0]["n"]
    mean = table[:, 0] / n
    return n, mean, table[:, 1:] / n - np.outer(mean, mean)


@dataclass
class Rotation:
    """A basis of ``axes`` orthonormal rows and the point that is its origin."""

    mean: np.ndarray
    basis: np.ndarray

    @classmethod
    def fit(cls, mean: np.ndarray, covariance: np.ndarray, axes: int) -> "Rotation":
        return cls(mean, np.linalg.eigh(covariance)[1][:, ::-1][:, :axes].T.copy())

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of what they leave (from the rest itself, not by subtraction of norms)."""
        centred = x.astype(float) - self.mean
        y = centred @ self.basis.T
        return y, np.linalg.norm(centred - y @ self.basis, axis=1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, y: np.ndarray, r: np.ndarray, centres: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and exact squared distance of each vector, and how many distances were computed.

    ``x`` and ``centres`` hold Python integers where longs could run over.
    """
    cy, cr = rotation.turned(centres)
    bound = ((y[:, None, :] - cy[None, :, :]) ** 2).sum(axis=2) + (r[:, None] - cr[None, :]) ** 2
    margin = 1.0 + 1e-9 * (((y**2).sum(axis=1) + r**2)[:, None] + ((cy**2).sum(axis=1) + cr**2)[None, :])
    best = bound.argmin(axis=1)
    least = squared(x, centres[best])
    done = len(x)
    open_ = bound - margin <= least.astype(float)[:, None] * (1 + 1e-12)
    open_[np.arange(len(x)), best] = False
    for c in np.flatnonzero(open_.any(axis=0)).tolist():
        rows = np.flatnonzero(open_[:, c])
        d = squared(x[rows], centres[c])
        done += len(rows)
        nearer = ((d < least[rows]) | ((d == least[rows]) & (c < best[rows]))).astype(bool)
        least[rows[nearer]], best[rows[nearer]] = d[nearer], c
    return best, least, done


def _exact(x: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Both as longs, or as Python integers if squares could run over."""
    c = np.array(centres, dtype=object)
    wide = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max())) > LIMIT
    return (x.astype(object), c) if wide else (x, c.astype(np.int64))


@dataclass
class Clustering:
    """Final centroids; ``verified`` counts the exact distances of each pass, of ``vectors * k``."""

    rotation: Rotation
    vectors: int
    centres: list[list[int]]
    verified: list[int] = field(default_factory=list)


def _passes(stored: DataFrame, state: Clustering, dims: int):
    """One pass: rows of cluster, n, distance, over (distances that fit no long), done and the sums of components."""
    centres, rotation = state.centres, state.rotation
    k = len(centres)
    money = pa.decimal128(38, 0)
    schema = pa.schema([("c", pa.int32()), ("n", pa.int64()), ("d", money), ("over", pa.int64()), ("done", pa.int64()), ("s", pa.list_(money))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, over, done = [0] * k, [0] * k, 0
        d, s = [0] * k, np.zeros((k, dims), object)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            y, r = _matrix(batch.column(1), rotation.basis.shape[0]), batch.column(2).to_numpy()
            exact, c = _exact(x, centres)
            best, least, computed = nearest(exact, y, r, c, rotation)
            done += computed
            for i in range(k):
                mine = best == i
                n[i] += int(mine.sum())
                s[i] += exact[mine].sum(axis=0).astype(object)
                for part in np.array_split(least[mine], max(1, mine.sum() >> 10)):
                    fits = part if part.dtype != object else np.array([v for v in part if v <= LONGEST], object)
                    over[i] += len(part) - len(fits)
                    d[i] += sum(map(int, fits))
        rows = {"c": list(range(k)), "n": n, "d": [Decimal(v) for v in d], "over": over, "done": [done, *[0] * (k - 1)]}
        rows["s"] = [[Decimal(int(v)) for v in row] for row in s]
        yield pa.RecordBatch.from_pydict(rows, schema)

    partials = stored.select("x", "y", "r").mapInArrow(partial, "c int, n long, d decimal(38,0), over long, done long, s array<decimal(38,0)>")
    sums = [F.sum(F.col("s")[j]) for j in range(dims)]
    out = partials.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("n", "d", "over", "done")], F.array(*sums).alias("s")).collect()
    state.verified.append(sum(r["done"] for r in out))
    return sorted(out, key=lambda r: r["c"])


def _lookup(values: list, kind: str) -> Column:
    """The value of a row's cluster."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: str = "3",
    dims: int = DIMS,
    scale: int = SCALE,
    axes: int = AXES,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> tuple[DataFrame, Clustering]:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector, and the clustering.

    The stored vectors are Parquet in the checkpoint folder; every pass reads them again.
    """
    session = vectors.sparkSession
    ship(session)
    numbers = whole_numbers(vectors, vec_id, embedding, dims, scale)
    kind = numbers.schema["vec_id"].dataType.simpleString()
    n, mean, covariance = moments(numbers, dims)
    state = Clustering(Rotation.fit(mean, covariance, axes), n, [])
    if not n:
        empty = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return session.createDataFrame([], empty), state
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = numbers.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    state.centres = [list(r["x"]) for r in first]
    rotation = state.rotation

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, r = rotation.turned(_matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(y), pa.list_(pa.float64())), pa.array(r)], ["vec_id", "x", "y", "r"]
            )

    folder = f"{checkpoint_dir(session)}/vectors-{uuid.uuid4().hex}"
    numbers.mapInArrow(rotate, f"vec_id {kind}, x array<long>, y array<double>, r double").write.parquet(folder)
    stored = session.read.parquet(folder)
    for _ in range(rounds):
        for row in _passes(stored, state, dims):
            if row["n"]:
                state.centres[row["c"]] = [int(v) // row["n"] for v in row["s"]]
    last = _passes(stored, state, dims)
    fits = lambda total, over: None if over or total > LONGEST else int(total)
    inertias = [fits(r["d"], r["over"]) for r in last]
    inertia = fits(sum(r["d"] for r in last), sum(r["over"] for r in last))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in state.centres]
    centres = [list(c) for c in state.centres]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            exact, c = _exact(x, centres)
            best, least, _ = nearest(exact, _matrix(batch.column(2), rotation.basis.shape[0]), batch.column(3).to_numpy(), c, rotation)
            distance = pa.array([int(v) if v <= LONGEST else None for v in least] if least.dtype == object else least, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), distance], ["vec_id", "cluster", "distance"])

    found = stored.select("vec_id", "x", "y", "r").mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")
    return (
        found.withColumn("cluster_inertia", _lookup(inertias, "long"))
        .withColumn("inertia", F.lit(inertia).cast("long"))
        .withColumn("centroid_sha256", _lookup(digests, "string")),
        state,
    )
