"""Mixes sources to target weights by Pfair scheduling.

Each source's documents, in a pseudo-random order, form blocks of ``block_docs``. A slot takes one
block. Block j of a source of weight w is released at floor(j / w) and due at ceil((j + 1) / w);
in each slot the earliest deadline among released blocks goes first. As the weights add up to
one, no block is late, so at any slot a source has had its share to within less than one block.

Weights are rounded to multiples of 1 / ``period`` (largest remainders, at least one each). The
schedule then repeats after ``period`` slots, and so one period of it, of a size that doesn't
depend on the documents, gives every block's slot by division: documents are never walked in one
place. When a source runs out, its slots stay empty and the others go on in their proportions.

Every row gets a place; nothing is dropped or repeated. A null source is a source of its own.
Without weights, a source's target is the square root of its count of rows, so that small sources
come earlier than in proportion. Sources without a weight get the least; weights of sources
without rows are dropped. Rows with equal ids are placed one by one. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordinals

PERIOD = 4096


def shares(weights: Mapping[str | None, float], period: int) -> dict[str | None, int]:
    """Weights as whole numbers that add up to ``period``, at least 1 each."""
    total = sum(weights.values())
    if not weights or total <= 0:
        raise ValueError("weights must be positive")
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    free = period - len(names)
    if free < 0:
        raise ValueError("the period is shorter than the number of sources")
    exact = {s: weights[s] / total * free for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: int(exact[s]) - exact[s])[: period - sum(out.values())]:
        out[s] += 1
    return out


def schedule(parts: Mapping[str | None, int], period: int) -> list[tuple[str | None, int, int, int, int]]:
    """One period by earliest deadline first: source, its block, slot, release and deadline."""
    names = list(parts)
    waiting = [(0, -(-period // parts[s]), i, 0) for i, s in enumerate(names)]  # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []  # by deadline
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, due, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, j, release))
        due, i, j, release = heapq.heappop(ready)
        out.append((names[i], j, slot, release, due))
        j, part = j + 1, parts[names[i]]
        if j < part:
            heapq.heappush(waiting, (j * period // part, -(-(j + 1) * period // part), i, j))
    return out


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    block_docs: int = 8,
    period: int = PERIOD,
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """All columns of ``docs`` and __block, __slot, __release, __deadline and __position (unique, ascending in the mix)."""
    session = docs.sparkSession
    # One row for each source; sources are few, and the period bounds what is planned for them.
    found = docs.groupBy(F.col(source).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not found:
        none = [F.lit(0).cast("long").alias(f"__{c}") for c in ("block", "slot", "release", "deadline", "position")]
        return docs.select("*", *none)
    period = max(period, 64 * len(found))
    if weights is None:
        target = {r["s"]: r["n"] ** 0.5 for r in found}
    else:
        target = {r["s"]: max(0.0, weights.get(r["s"], 0.0)) for r in found}
        target = target if sum(target.values()) > 0 else dict.fromkeys(target, 1.0)
    parts = shares(target, period)
    kind = docs.schema[source].dataType.simpleString()
    plan = session.createDataFrame(
        [(*x, parts[x[0]]) for x in schedule(parts, period)], f"__s {kind}, __j long, __at long, __from long, __due long, __part long"
    )
    sizes = session.createDataFrame([(s, p) for s, p in parts.items()], f"__s {kind}, __size long")
    rows = ordinals(docs, [source], [F.xxhash64(F.col(doc_id)), F.col(doc_id)], "__ordinal")
    rows = rows.join(F.broadcast(sizes), F.col(source).eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("__block", F.expr(f"__ordinal div {block_docs}")).withColumn("__turn", F.expr("__block div __size"))
    same = F.col(source).eqNullSafe(F.col("__s")) & (F.col("__block") % F.col("__size") == F.col("__j"))
    base = F.col("__turn") * period
    return (
        rows.join(F.broadcast(plan), same)
        .withColumn("__slot", base + F.col("__at"))
        .withColumn("__release", base + F.col("__from"))
        .withColumn("__deadline", base + F.col("__due"))
        .withColumn("__position", F.col("__slot") * block_docs + F.col("__ordinal") % block_docs)
        .drop("__s", "__j", "__at", "__from", "__due", "__part", "__size", "__turn", "__ordinal")
    )
