from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_tables import documents  # noqa: F401 - a fixture

from paycadence.llm import first_fit, queries


@given(st.lists(st.integers(1, 20), max_size=60))
@settings(max_examples=200, deadline=None)
def test_the_tree_finds_the_first_sequence_with_room(lengths):
    room, want = [], []
    for s in lengths:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        room += [20] if at == len(room) else []
        room[at] -= s
        want.append(at)
    assert first_fit.first_fit(lengths, 20) == want


@given(st.lists(st.integers(1, 31), max_size=60))
@settings(max_examples=200, deadline=None)
def test_rests_lie_once_and_no_sequence_is_padded(lengths):
    lengths = sorted(lengths, reverse=True)
    laid = first_fit.pack_rests(lengths, 32)
    places = collections.defaultdict(list)
    for sequence in laid:
        n = sum(m for _, _, m in sequence)
        assert n & (n - 1) == 0 and 0 < n <= 32
        for i, a, m in sequence:
            assert m > 0
            places[i].append((a, m))
    for i, n in enumerate(lengths):
        at = 0
        for a, m in sorted(places[i]):
            assert a == at
            at += m
        assert at == n
    # Sequences that first-fit filled are left as they are.
    where = first_fit.first_fit(lengths, 32)
    load = collections.Counter()
    for i, at in enumerate(where):
        load[at] += lengths[i]
    for i, at in enumerate(where):
        assert load[at] < 32 or len(places[i]) == 1


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return queries.vocabulary("byte_bpe_50k.json")


ODD = [
    "", "  a\tb\n\nc's <|endoftext|> x", "naïve İstanbul ǅ ﬁ é é  x y it's 12.5 don't!! AB'S", "日本語 text\r\nfoo\x0bbar\x1cbaz \x00",
    "ª º µ ß ẞ Σας ΟΔΟΣ \x85 z", "a" * 9000, " " * 9000 + "x.,!?;:|", "1" * 5000, "!" * 5000, "😀 \U0010ffff ab́",
]


def ids(t, text):
    return np.frombuffer(t.encode(text), t.width).tolist()


@given(st.lists(st.text("aAé'’s dt.,!1 \n\t\x1cćßΣ#😀", max_size=80), max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_tokenizer(vocabulary, batch):
    t = first_fit.tokenizer(vocabulary)
    assert [ids(t, x) for x in batch] == [t.one(x) for x in batch]


def test_ids_of_odd_texts_and_of_documents(spark, tables, vocabulary):
    t = first_fit.tokenizer(vocabulary)
    assert t.same and t.width == "<u2"
    some = [r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    for text in ODD + some:
        assert ids(t, text) == t.one(text)


def test_a_full_memory_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(first_fit, "REMEMBERED", 3)
    t = first_fit.ByteTokenizer(vocabulary)
    for _ in range(2):
        assert [ids(t, x) for x in ODD] == [t.one(x) for x in ODD]


def test_pieces_of_odd_rows(spark, documents, vocabulary):
    random.seed(8)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "x"), (50, None), (51, "the cat " * 3000), (52, "x"), (52, "x"), (53, "a " * 1023)]
    rows += [(100 + i, " ".join(random.choices(["alder", "zyx", "9", "b."], k=random.randint(0, 900)))) for i in range(80)]
    t = first_fit.tokenizer(vocabulary)
    for a_group in (20, 4096):
        out = first_fit.pack(documents(rows), vocabulary, docs_a_group=a_group).collect()
        check(out, rows, t, 1024)
    assert first_fit.pack(documents([]), vocabulary).count() == 0


def check(out, rows, t, size):
    """The pieces of each document join to its ids, and sequences have no gap and no padding."""
    of = collections.defaultdict(list)
    for d, text in rows:
        of[d].append(np.array([*t.one(text or ""), 0], "<u4"))
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == {(d, len(ids)) for d, x in of.items() for ids in x}
    for (d, n), found in pieces.items():
        same = [ids for ids in of[d] if len(ids) == n]
        # Rows of one id and one length: every id is covered as often as there are rows.
        cover = np.zeros(n, int)
        for a, m, crc in found:
            cover[a : a + m] += 1
            assert crc in {zlib.crc32(ids[a : a + m].tobytes()) for ids in same}
        assert (cover == len(same)).all()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size and at & (at - 1) == 0


def test_registered_query(spark, tables, vocabulary):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    out = queries.op12_first_fit_tournament(spark, tables).collect()
    check(out, [(r.doc_id, r.text) for r in docs], first_fit.tokenizer(vocabulary), 1024)
    assert len(out) < sum(r.length for r in out) / 1024 + 2 * len(docs)
