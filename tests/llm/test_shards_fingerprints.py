from __future__ import annotations

import collections
import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_tables import documents  # noqa: F401 - a fixture

from paycadence.llm import fingerprints, queries, sharding


def smallest_capacity(sizes, n):
    def fits(capacity):
        shards, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                shards, room = shards + 1, capacity
            room -= s
        return shards <= n

    low, high = 0, sum(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_capacity_of_whole_cells(sizes, n):
    cells = [sharding.Cell(i, i + 1, s, True) for i, s in enumerate(sizes)]
    assert sharding.least(cells, n, False) == sharding.least(cells, n, True) == smallest_capacity(sizes, n)


def test_boundaries_are_those_of_single_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    random.seed(6)
    for n, hot in ((8, 1), (3, 400), (8, 4000), (5, 1)):
        # Hashes crowd in a few places, so that cells are opened many times over.
        groups = {random.choice([-5, 0, 1 << 62]) + random.randrange(1 << random.choice([3, 20, 61])): random.randint(1, 30) for _ in range(300)}
        groups[next(iter(groups))] = hot
        order = sorted(groups, key=lambda h: h % (1 << 64))
        cuts = sharding.boundaries(spark.createDataFrame([(h, s) for h, s in groups.items()], "h long, size long"), n)
        sums = collections.Counter()
        for h in order:
            sums[sum(h % (1 << 64) >= c for c in cuts)] += groups[h]
        assert len(sums) <= n and max(sums.values()) == smallest_capacity([groups[h] for h in order], n)
    assert sharding.boundaries(spark.createDataFrame([], "h long, size long"), 8) == []


ROWS = [(i, f"text {i % 90} " * (i % 9 + 1)) for i in range(400)] + [(500 + i, "hot copy") for i in range(250)]
ROWS += [(None, None), (None, "é"), (800, None), (801, ""), (802, "long " * 40_000), (803, "ties"), (803, "ties")]


def test_every_row_in_a_shard(spark, documents):
    out = sharding.shard(documents(ROWS), rows_a_task=60).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ROWS)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots = collections.defaultdict(list)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shards = collections.defaultdict(set)
    for r in out:
        shards[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    assert sharding.shard(documents([])).count() == 0


def edited(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        yield d, t, t[: len(t) - k] + after[:k], after


def test_edits_of_every_row(spark, documents):
    random.seed(9)
    rows = [(i * 7, "".join(random.choices("aé. \n", k=random.randint(0, 60)))) for i in range(150)]
    rows += [(None, "first"), (None, None), (1, None), (2, ""), (3, "x" * 50_000), (14, "twice"), (14, "twice"), (14, "thrice")]
    for size in (10, 10_000):
        out = fingerprints.edits(documents(rows), rows_a_bucket=size).collect()
        want = collections.Counter((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in edited(rows))
        assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert fingerprints.edits(documents([])).count() == 0
    (only,) = fingerprints.edits(documents([(1, "abcd. efgh")])).collect()
    assert (only.near_next, only.edited_sha256) == (1.0, hashlib.sha256(b"abcd. efab").hexdigest())


def test_fingerprints_are_of_multisets(spark, documents):
    rows = [(1, "a\nb\nc"), (2, "c\n\n b\na "), (3, "a\nb"), (4, "a\nb\nc\nc"), (5, None), (6, " \n"), (7, "A. B! C"), (8, "C\nA.\nB!")]
    f = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(documents(rows)).collect()}
    assert f[1] == f[2] and f[5] == f[6] and f[7] == f[8] and len({f[i] for i in (1, 3, 4, 5, 7)}) == 5


def test_paragraphs_are_put_in_and_taken_out(spark, documents):
    rows = [(1, "one\ntwo\nthree"), (2, "three"), (3, "one\ntwo")]
    split = documents(rows).select("doc_id", fingerprints.paragraphs(F.col("text")).alias("p"))
    words = {r.doc_id: r.words for r in fingerprints.summed(split, ["doc_id"], "p").collect()}
    pair = spark.createDataFrame([(words[1], words[2], words[3])], "a array<long>, b array<long>, c array<long>")
    row = pair.select(fingerprints.combine(F.col("a"), F.col("b"), -1).alias("less"), fingerprints.combine(F.col("c"), F.col("b")).alias("more")).first()
    assert row.less == words[3] and row.more == words[1]


def test_likeness_follows_shared_paragraphs(spark, documents):
    lines = [f"paragraph number {i}" for i in range(80)]
    rows = [(0, "\n".join(lines[:60])), (1, "\n".join(lines[:45] + lines[65:])), (2, "\n".join(f"other {i}" for i in range(60)))]
    split = documents(rows).select("doc_id", fingerprints.paragraphs(F.col("text")).alias("p"))
    s = fingerprints.summed(split, ["doc_id"], "p")
    a, b = s.select(F.col("doc_id").alias("i"), F.col("n").alias("m"), F.col("words").alias("v")), s
    near = fingerprints.likeness(F.col("v"), F.col("m"), F.col("words"), F.col("n"))
    got = {(r.i, r.doc_id): r.x for r in a.join(b, F.col("i") < F.col("doc_id")).select("i", "doc_id", near.alias("x")).collect()}
    assert abs(got[0, 1] - 0.75) < 0.2 and got[0, 2] < 0.35 and got[1, 2] < 0.35


def test_registered_queries(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op8_multiset_fingerprints(spark, tables).collect()}
    near = collections.Counter()
    for d, t, e, _ in edited(docs):
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        near["edited"] += got[d].near_edited
        near["next"] += got[d].near_next
    assert near["edited"] > 3 * near["next"]
    shards = queries.op7_minimax_shards(spark, tables).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(shards) == 8 and sum(r.n for r in shards) == sum(len((t or "").encode()) + 1 for _, t in docs)
