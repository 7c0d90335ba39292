from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_tables import documents  # noqa: F401 - a fixture

import corpus_pipeline
from paycadence.llm import neardup, packing, pii, quality, queries, repeats
from paycadence.llm.common import components, table, texts


def test_registers_agree_as_often_as_multisets_are_alike():
    rng = np.random.default_rng(3)
    for _ in range(4):
        a = rng.choice([1, 1, 2, 5, 17], 300)
        b = np.where(rng.random(300) < 0.3, rng.choice([0, 1, 3, 9], 300), a)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        shingle = neardup.mixed(np.tile(rng.integers(0, 1 << 62, 300).astype(np.uint64), 2))
        doc, count = np.repeat([0, 1], 300), np.concatenate([a, b])
        s = neardup.signatures(2, doc[count > 0], shingle[count > 0], count[count > 0], 4096)
        assert abs((s[0] == s[1]).mean() - true) < 0.035


def test_signatures_do_not_depend_on_the_batch():
    batch = ["a b c d e f g", "a", "", "x y " * 200]
    shingler = neardup.Shingler()
    together = neardup.signatures(4, *shingler.bags(batch), 40)
    for i, text in enumerate(batch):
        alone = neardup.signatures(1, *neardup.Shingler().bags([text]), 40)
        assert (together[i] == alone[0]).all()


def bag(text):
    words = (text or "").split()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def plain_classes(rows, similarity=0.8):
    """Classes by comparing all texts with an id; equal texts always belong together."""
    first = {}
    for d, t in rows:
        t = t or ""
        if t not in first or first[t] is None or (d is not None and d < first[t]):
            first[t] = d if d is not None else first.get(t)
    ids = {t: d for t, d in first.items() if d is not None}
    bags = {d: bag(t) for t, d in ids.items()}
    root = {d: d for d in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                shared = sum((bags[a] & bags[b]).values())
                if shared >= similarity * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return [(d, None if first[t or ""] is None else find(first[t or ""])) for d, t in rows]


def near_copies():
    random.seed(11)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [random.choices(words, k=random.choice([3, 12, 80, 300])) for _ in range(25)]
    for i in range(160):
        copy = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 4])):
            copy[random.randrange(len(copy))] = random.choice(words)
        rows.append((1000 - i, " ".join(copy)))
    rows += [(2000 + i, "hot copy of a text with some words") for i in range(90)]
    rows += [(None, rows[0][1]), (None, "alone without an id"), (None, None), (1, None), (2, ""), (3, " \n"), (4, "a " * 3000), (5, "a " * 2900), (6, "twice"), (6, "twice")]
    return rows


def test_classes_against_all_pairs(spark, documents):
    rows = near_copies()
    got = neardup.classes(documents(rows)).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == collections.Counter(plain_classes(rows))
    kept = neardup.deduplicate(documents(rows))
    assert kept.columns == documents([]).columns
    texts_kept = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    want = {c for _, c in plain_classes(rows) if c is not None}
    assert {d for d, _ in texts_kept if d is not None} == want and sum(texts_kept.values()) == len(want) + 1
    assert neardup.classes(documents([])).count() == neardup.deduplicate(documents([])).count() == 0


def test_large_buckets_yield_two_links_a_row(spark):
    bands = spark.createDataFrame([(i, k) for i in range(900) for k in (1, 2)] + [(5000, 3)], "id long, key long")
    rows = neardup.buckets(bands, block=100)
    assert rows.filter("id = 5000").count() == 0 and rows.groupBy("key", "part").count().agg(F.max("count")).first()[0] < 200
    links = neardup.candidate_links(rows)
    assert links.count() <= 4 * 900 + 60
    assert {r.root for r in components(links).collect()} == {0}


def test_near_copies_among_texts_of_one_template(spark, documents):
    """240 texts alike at 0.78 by their template; every third shares 14 words more with the next, 0.82."""
    template, rows = " ".join(f"t{k}" for k in range(359)), []
    for i in range(240):
        more = [f"p{i - i % 3}_{k}" for k in range(14)] if i % 3 < 2 else [f"o{i}_{k}" for k in range(14)]
        rows.append((i, " ".join([template, *[f"u{i}_{k}" for k in range(36)], *more])))
    got = collections.Counter((r.doc_id, r.class_id) for r in neardup.classes(documents(rows)).collect())
    assert got == collections.Counter(plain_classes(rows)) and len({c for _, c in got}) == 160


def test_a_family_just_below_the_threshold_makes_few_pairs(spark):
    """5,000 multisets that share 88 of 100 elements, alike at 0.79 or, one pair in ten, at 0.81 and more."""
    rows = []
    for i in range(5000):
        own = list(range(10_000 + 20 * i, 10_000 + 20 * i + 12))
        if i % 10 == 1:
            own[:2] = range(10_000 + 20 * (i - 1), 10_000 + 20 * (i - 1) + 2)
        rows.append((i, [*range(88), *own]))
    bags = spark.createDataFrame(rows, "doc_id long, bag array<long>")
    members = bags.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("root"), F.lit(True).alias("minor"))
    pairs = neardup.apart_pairs(members, bags, 0.8)
    want = {(i - 1, i) for i in range(1, 5000, 10)}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    names = neardup.joined_roots(pairs, bags, 0.8, 100).collect()
    assert {(r.node, r.root) for r in names} == {(x, a) for a, b in want for x in (a, b)}


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_pairs_of_the_exact_join(spark, similarity):
    """Random multisets as sets of elements, families of copies among them, components given at random."""
    rng = np.random.default_rng(int(similarity * 10))
    sets = [set(rng.choice(80, rng.integers(1, 50), replace=False).tolist()) for _ in range(60)]
    for k in range(120):
        copy = set(sets[k % 20])
        for x in rng.choice(sorted(copy), min(len(copy) - 1, int(rng.integers(0, 6))), replace=False).tolist():
            copy -= {x}
        sets.append(copy | set(rng.choice(2000, int(rng.integers(0, 6))).tolist()))
    roots = rng.integers(0, 30, len(sets)).tolist()
    minor = (rng.random(len(sets)) < 0.6).tolist()
    bags = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "doc_id long, bag array<long>")
    members = spark.createDataFrame([(i, r, m) for i, (r, m) in enumerate(zip(roots, minor))], "id long, root long, minor boolean")
    pairs = neardup.apart_pairs(members, bags, similarity)
    got = {(r.a, r.b): (r.ra, r.rb) for r in pairs.collect()}
    true = {
        (a, b)
        for a in range(len(sets)) for b in range(a + 1, len(sets))
        if roots[a] != roots[b] and (minor[a] or minor[b]) and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    }
    assert true <= set(got) and all(r == (roots[a], roots[b]) for (a, b), r in got.items())
    root = {r: r for r in roots}
    for a, b in true:
        x, y = root[roots[a]], root[roots[b]]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    for at_once in (3, 10_000):
        names = neardup.joined_roots(pairs, bags, similarity, at_once)
        assert {**{r: r for r in roots}, **{r.node: r.root for r in names.collect()}} == root


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (101, 103), (102, 101)] + [(7, 7)]
    random.seed(2)
    random.shuffle(edges)
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removal(rows, length=50):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1 if d is not None else 0):
            w = raw[i : i + length]
            first[w] = min(d, first.get(w, d))
    out = collections.Counter()
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1 if d is not None else 0):
            if first[raw[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[(d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_removed_bytes_against_brute_force(spark, documents, monkeypatch, small):
    if small:
        monkeypatch.setattr(repeats, "SEGMENT", 64)
        monkeypatch.setattr(repeats, "CHUNK", 300)
    random.seed(5)

    def noise(n):
        return "".join(random.choices("abcde ", k=n))

    parts = [noise(random.randint(30, 200)) for _ in range(12)] + ["a" * 120, "ab" * 70, "orre " * 40]
    rows = [(i, "".join(random.choice([noise(random.randint(0, 60)), random.choice(parts), random.choice(parts)[random.randint(0, 40) :]]) for _ in range(random.randint(0, 8)))) for i in range(150)]
    rows += [(None, parts[0] * 2), (200, None), (201, ""), (7, parts[3] + "é" * 60), (7, parts[3] + "é" * 60), (300, rows[10][1])]
    rows += [(400 + i, noise(20) + parts[5] + noise(20)) for i in range(60)]
    random.shuffle(rows)
    got = collections.Counter(tuple(r) for r in repeats.removed_bytes(documents(rows), bucket_bytes=2000).collect())
    assert got == plain_removal(rows)
    assert repeats.removed_bytes(documents([])).count() == 0


def test_a_line_in_different_contexts_fills_no_bucket(spark, documents, monkeypatch):
    random.seed(9)
    line = "A line that a third of all documents hold, each in another context"
    # The least hash of its runs lies inside, and its windows straddle both edges.
    rows = [(i, "".join(random.choices("abcdefgh ", k=60)) + (line if i % 3 == 0 else "") + "".join(random.choices("abcdefgh ", k=60))) for i in range(900)]
    settled = repeats.settled

    def limited(recurse):
        settle = settled(recurse)

        def checked(table):
            # Those that lost in their chunk already go by document.
            size = sum(len(b.as_py()) for part, b in zip(table.column("part").to_pylist(), table.column("block")) if part != 1)
            if size > 4_000:
                raise ValueError(f"a bucket of {size} bytes")
            return settle(table)

        return checked

    monkeypatch.setattr(repeats, "settled", limited)
    got = collections.Counter(tuple(r) for r in repeats.removed_bytes(documents(rows), bucket_bytes=1000).collect())
    assert got == plain_removal(rows)


def test_registered_queries(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert collections.Counter(tuple(r) for r in queries.op3_sampled_suffix_repeats(spark, tables).collect()) == plain_removal(docs)
    got = collections.Counter((r.doc_id, r.class_id) for r in queries.op9_bag_minhash(spark, tables).collect())
    assert got == collections.Counter(plain_classes(docs))


def test_each_stage_against_its_operator(spark, tables, tmp_path):
    docs = table(spark, tables, "documents")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in out.collect()} if name != "pack" else out.collect())
        assert name == "pack" or out.columns == columns
        if name == "quality":
            scores = quality.classify(docs, table(spark, tables, "labels")).collect()
            assert set(kept[0]) == {r.doc_id for r in scores if r.predicted}
        elif name == "near_duplicates":
            assert set(kept[1]) == {c for _, c in plain_classes([(r.doc_id, r.text) for r in docs.collect()])}
        elif name == "personal_data":
            assert set(kept[2]) == set(kept[1])
            for d, r in kept[2].items():
                before, base = kept[1][d].text, pii.base_spans(kept[1][d].text or "")
                assert r.n_chars == len(r.text) and not pii.base_spans(r.text)
                assert bool(base) <= (r.text != before) and all(before[a:b] not in r.text for k_, a, b in base if k_ < 2)
        elif name == "mix":
            assert {d: r.text for d, r in kept[3].items()} == {d: r.text for d, r in kept[2].items()}
        docs = out
    ids = packing.tokenizer(queries.vocabulary())
    assert sum(r.length for r in kept[4]) == sum(len(ids.one(r.text)) // 4 + 1 for r in kept[3].values())
    assert corpus_pipeline.run(spark, tables).count() == len(kept[4])


def test_the_mix_decides_the_order_of_rows(spark, documents):
    rows = [(i, f"t{i}", "hot" if i < 200 else f"s{i % 4}") for i in range(320)]
    out = corpus_pipeline.mixed_sources(spark, documents(rows), "").withColumn("part", F.spark_partition_id()).collect()
    sources = [r.source for r in out]
    # The first hundred rows hold sources by the square roots of their sizes, not as stored.
    shares = {s: n ** 0.5 for s, n in collections.Counter(sources).items()}
    for s, share in shares.items():
        assert abs(sources[:80].count(s) - 80 * share / sum(shares.values())) <= 8
    assert sorted(r.doc_id for r in out) == list(range(320))


def test_the_mix_decides_which_sources_share_sequences(spark, documents, tmp_path):
    rows = [(i, f"word{i} " * 3, "hot" if i < 6000 else f"s{i % 4}") for i in range(9600)]
    corpus_pipeline.mixed_sources(spark, documents(rows), "").write.parquet(f"{tmp_path}/mix")
    out = corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/mix"), "").collect()
    assert sorted(r.doc_id for r in out) == list(range(9600))
    ranges = collections.defaultdict(list)
    for r in out:
        ranges[r.sequence_id >> 32].append(rows[r.doc_id][2])
    roots = {s: n**0.5 for s, n in collections.Counter(r[2] for r in rows).items()}
    assert len(ranges) > 1
    # Small sources run out after about 5,500 rows: the first range holds the targets, the last one hot rows alone.
    for s, root in roots.items():
        assert abs(ranges[0].count(s) / len(ranges[0]) - root / sum(roots.values())) < 0.02
    assert set(ranges[max(ranges)]) == {"hot"}


def test_stages_on_empty_and_odd_tables(spark, documents, tables):
    odd = documents([(None, None), (1, None), (1, ""), (2, "x@y.zz " * 60), (2, "x@y.zz " * 60)])
    for rows in (documents([]), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, tables).count() >= 0
    assert texts(documents([(None, None)])).collect()[0].text == ""
