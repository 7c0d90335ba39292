from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_tables import documents  # noqa: F401 - a fixture

from paycadence.llm import mixing, packing, queries
from paycadence.llm.common import ordinals


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=12), st.integers(12, 300))
@settings(max_examples=150, deadline=None)
def test_no_source_is_a_block_off_its_share(weights, period):
    parts = mixing.shares({str(i): float(w) for i, w in enumerate(weights)}, period)
    assert sum(parts.values()) == period and min(parts.values()) >= 1
    done = collections.Counter()
    for source, j, slot, release, due in mixing.schedule(parts, period):
        assert j == done[source] and release <= slot < due
        assert release == j * period // parts[source] and due == -(-(j + 1) * period // parts[source])
        done[source] += 1
        assert all(-period < (slot + 1) * p - done[s] * period < period for s, p in parts.items())
    assert done == parts


def test_every_row_has_its_place_in_the_mix(spark, documents):
    rows = [(i, "t", "hot" if i % 3 else f"s{i % 7}") for i in range(900)] + [(None, None, None), (None, "", None), (5, "t", "hot"), (5, "t", "hot")]
    weights = {"hot": 1.0, "s0": 2.0, "absent": 5.0}
    names = {f"__{c}": c for c in ("block", "slot", "release", "deadline", "position")}
    out = mixing.mix(documents(rows), weights, block_docs=4, period=64).withColumnsRenamed(names).collect()
    assert len(out) == len(rows) == len({r.position for r in out})
    parts = mixing.shares({s: weights.get(s, 0.0) for s in {r.source for r in out}}, 64 * len({r.source for r in out}))
    blocks = collections.defaultdict(set)
    for r in out:
        assert r.release <= r.slot < r.deadline and r.position // 4 == r.slot
        blocks[r.source].add((r.block, r.slot))
    slots = [s for b in blocks.values() for _, s in b]
    assert len(slots) == len(set(slots))
    # As long as every source has blocks, prefixes hold the target shares to within a block.
    left = min(max(s for _, s in b) for b in blocks.values())
    total = sum(parts.values())
    for upto in range(1, left):
        for source, b in blocks.items():
            assert abs(sum(s < upto for _, s in b) - upto * parts[source] / total) < 1
    for b in blocks.values():
        assert sorted(x for x, _ in b) == list(range(len(b)))
    assert mixing.mix(documents([])).count() == 0


def test_ordinals_have_no_gaps(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "a").alias("g"), (F.col("id") % 1000).alias("x"))
    out = ordinals(df, ["g"], [F.col("x")], "n", rows_a_task=300).groupBy("g").agg(F.min("n"), F.max("n"), F.count_distinct("n"), F.count("*"))
    assert {tuple(r) for r in out.collect()} == {(None, 0, 1666, 1667, 1667), ("a", 0, 3332, 3333, 3333)}


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return queries.vocabulary()


ODD = [
    "", "  a\tb\n\nc's <|endoftext|> x", "naïve İstanbul ǅ ﬁ é é  x y it's 12.5 don't!! AB'S", "日本語 text\r\nfoo\x0bbar\x1cbaz",
    "ª º µ ß ẞ Σας ΟΔΟΣ \x85 z", "a" * 5000, " " * 100 + "x.,!?;:|", "word, Word. (word) #word", "́a b́ ́",
]


@given(st.lists(st.text("aAé'’s dt.,!1 \n\t\x1ćßΣ#", max_size=60), max_size=8))
@settings(max_examples=300, deadline=None)
def test_remembered_ids_equal_the_tokenizer(vocabulary, batch):
    t = packing.tokenizer(vocabulary)
    assert t.encode(batch) == [t.one(x) for x in batch]


def test_odd_texts_and_full_memory(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    t = packing.WordTokenizer(vocabulary)
    for _ in range(2):
        assert t.encode(ODD) == [t.one(x) for x in ODD]


def plain_sum_of_squares(lengths, size):
    """Tries every open sequence; compares the sums of squares themselves."""
    free, where = [], []
    for s in lengths:
        def score(f, new):
            counts = collections.Counter(x for x in free if 0 < x < size)
            if not new:
                counts[f] -= 1
            if 0 < f - s < size:
                counts[f - s] += 1
            return sum(v * v for v in counts.values())

        options = [(score(f, False), f) for f in sorted({f for f in free if f >= s})] + [(score(size, True), size)]
        best = min(options)
        if best[1] == size:
            free.append(size - s)
            where.append(len(free) - 1)
        else:
            at = max(i for i, f in enumerate(free) if f == best[1])
            free[at] -= s
            where.append(at)
    return collections.Counter(free), where


@given(st.lists(st.integers(1, 20), max_size=60))
@settings(max_examples=200, deadline=None)
def test_placement_equals_the_rule(lengths):
    where, offset = packing.sum_of_squares(np.array(lengths, np.int64), 20)
    free, _ = plain_sum_of_squares(lengths, 20)
    filled = collections.Counter()
    for w, o, s in zip(where.tolist(), offset.tolist(), lengths):
        assert o == filled[w]
        filled[w] += s
    assert collections.Counter(20 - v for v in filled.values()) == free


def test_packing_of_odd_rows(spark, documents, vocabulary):
    random.seed(8)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (50, None), (51, "the cat " * 3000), (52, "x"), (52, "x")]
    rows += [(100 + i, " ".join(random.choices(["alder", "zyx", "9", "b."], k=random.randint(0, 900)))) for i in range(60)]
    out = packing.pack(documents(rows), vocabulary, pieces_a_task=30).collect()
    t = packing.tokenizer(vocabulary)
    want = collections.Counter()
    for d, text in rows:
        raw = t.one(text or "") + b"\0\0\0\0"
        for k, a in enumerate(range(0, len(raw) // 4, 2048)):
            want[(d, k, a, min(2048, len(raw) // 4 - a), zlib.crc32(raw[4 * a : 4 * a + 8192]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(documents([]), vocabulary).count() == 0
    whole = packing.pack(documents(rows), vocabulary).groupBy("sequence_id").count().count()
    assert whole <= -(-sum(r.length for r in out) // 2048) + 1


def test_registered_queries(spark, tables):
    n = spark.read.parquet(f"{tables}/documents.parquet").count()
    mixed = queries.op4_pfair_mix(spark, tables)
    assert mixed.count() == n == mixed.select("position").distinct().count()
    pieces = queries.op6_sum_of_squares_packing(spark, tables)
    assert pieces.select("doc_id").distinct().count() == n
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_ranges_of_files_in_order(spark, documents, tmp_path):
    """Ranges follow from the pieces before each block, over many files; each is packed by itself."""
    rows = [(i, "w " * (i * 37 % 90)) for i in range(400)] + [(1007, None), (None, "x"), (1007, None)]
    folder = f"file://{tmp_path}/ordered"
    documents(rows).repartition(7, "doc_id").write.parquet(folder)
    stored = spark.read.parquet(folder)
    out = packing.pack_in_order(stored, queries.vocabulary(), size=64, pieces_a_range=50, rows_a_block=10).collect()
    stood = stored.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    stood.sort(key=lambda r: (int(re.search(r"part-(\d+)", r.file_name)[1]), r.row_index))
    count = collections.Counter(r.doc_id for r in out)
    twice = collections.Counter(r.doc_id for r in stood)
    blocks = collections.defaultdict(list)
    for r in stood:
        blocks[r.file_name, r.row_index // 10].append(r.doc_id)
    want, before = collections.Counter(), 0
    for ids in blocks.values():
        want.update((d, before // 50) for d in ids for _ in range(count[d] // twice[d]))
        before += sum(count[d] // twice[d] for d in ids)
    assert before == len(out) and want == collections.Counter((r.doc_id, r.sequence_id >> 32) for r in out)
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
