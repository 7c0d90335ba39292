from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_tables import documents  # noqa: F401 - a fixture

from paycadence.llm import pii, queries, rules


def plain_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


@given(st.text("0123456789.@+- ()ab%_", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


TEXTS = [
    (1, "Write to ann.b@mail.example.com, or 10.0.0.255 and 4111 1111 1111 1111 or +1 (202) 555-0147."),
    (2, None), (3, ""), (None, "é x@y.zz"), (4, "300.1.1.1 4111111111111112 +12 a@b"), (5, "ann@x.org " * 4000), (5, "ann@x.org " * 4000),
    (6, "1" * 100_000), (7, "@" * 5000 + "a@b.c.@d.e"),
]


def test_detect_every_row(spark, documents):
    rows = pii.detect(documents(TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    want = collections.Counter()
    for d, text in TEXTS:
        base = plain_spans(text or "") if d != 6 else []
        want[(d, hashlib.sha256(pii.written(base).encode()).hexdigest(), *[sum(s[0] == k for s in base) for k in range(4)])] += 1
    assert collections.Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows) == want
    for r in rows:
        kinds = [x.split(":") for x in r.spans.split(",") if x]
        assert [(pii.KINDS.index(k), int(a)) for k, a, _ in kinds] == sorted((pii.KINDS.index(k), int(a)) for k, a, _ in kinds)
        base = plain_spans({d: t for d, t in TEXTS}.get(r.doc_id) or "") if r.doc_id != 6 else []
        assert set(pii.written(base).split(",")) <= set(r.spans.split(",")) | {""}
    assert pii.detect(documents([])).count() == 0


def all_paths(cuts, cands):
    at = collections.defaultdict(list)
    for c in cands:
        at[c[0]].append(c)

    def walk(i):
        if i == len(cuts) - 1:
            yield []
        for c in at[i]:
            for rest in walk(c[1]):
                yield [c, *rest]

    return walk(0)


def test_decoding_and_learning_against_every_segmentation():
    random.seed(1)
    for text in ("12.34.56", "+1 (202)", "a1@b2.c3", "1234 56"):
        cuts, cands = pii.candidates(text, " ", "")
        model = pii.Field(moves=np.random.default_rng(2).normal(size=(5, 5)))
        for f in {f for c in cands for f in c[3]}:
            model.weights[f] = random.gauss(0, 1)

        def value(path, model=model):
            types = [pii.OTHER, *[c[2] for c in path]]
            return sum(model.weights[f] for c in path for f in c[3]) + sum(model.moves[a, b] for a, b in itertools.pairwise(types))

        best = max(all_paths(cuts, cands), key=value)
        assert pii.decode(model, text, " ", "") == [(y, cuts[i], cuts[j]) for i, j, y, _ in best if y != pii.OTHER]


def test_the_field_adds_near_misses_and_keeps_base_spans():
    samples = [(t, " ", " ") for t in ("4111111111111111", "5500005555555559", "340000000000009", "10.2.3.4", "192.168.0.1", "ann@mail.example.com", "+1 (202) 555-0147", "+1 (303) 555-0199", "12345678", "2020-10-10")]
    model = pii.fit(samples, rounds=12)
    for text, _, _ in samples:
        assert pii.all_spans(model, text, pii.base_spans(text)) == pii.base_spans(text) or len(pii.base_spans(text)) == 0
    miss = "card 4111111111111112 here"
    assert [pii.KINDS[k] for k, _, _ in pii.all_spans(model, miss, pii.base_spans(miss))] == ["card"]


def test_masked_texts(spark, documents):
    model = pii.Field()
    rows = documents(TEXTS[:4]).select("doc_id", pii.masked(model, F.col("text")).alias("m")).collect()
    assert {r.doc_id: r.m for r in rows} == {
        1: "Write to <EMAIL>, or <IP> and <CARD> or <PHONE>.", 2: None, 3: "", None: "é <EMAIL>",
    }


def plain_counts(text, least):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    threes = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    reach = [0] * len(words)
    for i, j in itertools.combinations(range(len(words)), 2):
        k = 0
        while j + k < len(words) and words[i + k] == words[j + k]:
            k += 1
        reach[i], reach[j] = max(reach[i], k), max(reach[j], k)
    covered = {j for i, k in enumerate(reach) if k >= least for j in range(i, i + k)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dups += line in seen
            seen.add(line)
    chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    return (len(words), chars, symbols, dups, len(inside), len(covered), max([k for k in reach if k >= least], default=0))


@given(st.lists(st.text("ab é\n\t\x0b\x85\xa0#|", max_size=120), max_size=6), st.sampled_from([4, 5, 8]))
@settings(max_examples=250, deadline=None)
def test_rule_counts_against_brute_force(batch, least):
    got = [tuple(r) for r in rules.stats(batch, least).itertuples(index=False)]
    assert got == [plain_counts(t, least) for t in batch]


def test_rules_over_odd_rows(spark, documents):
    clean = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, clean), (2, None), (3, ""), (None, clean), (4, "a " * 50_000), (5, clean + " " + clean), (5, clean + " " + clean), (6, clean + " " + long + " x " + long)]
    out = {(r.doc_id, r.kept, r.base_failed, r.longest_repeat) for r in rules.apply_rules(documents(rows)).collect()}
    assert out == {
        (1, True, False, 0), (2, False, True, 0), (3, False, True, 0), (None, True, False, 0), (4, False, True, 49_999),
        (5, False, True, 60), (6, False, True, 200),
    }
    assert rules.apply_rules(documents([])).count() == 0
    # Half of the words under repeats pass the base rule, but not the limits on repeats.
    half = clean + " " + clean + " " + " ".join(f"z{i}" for i in range(121))
    (row,) = rules.apply_rules(documents([(1, half)])).collect()
    assert not row.base_failed and not row.kept and row.n_covered_words == 120
    # A short line said twice is no reason to drop a text.
    (row,) = rules.apply_rules(documents([(1, "a line of a dozen words " * 2 + clean)])).collect()
    assert row.kept


def test_registered_queries(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op10_suffix_repetition(spark, tables).collect()
    assert len(got) == len(texts)
    for r in got:
        words = (texts[r.doc_id] or "").encode().split()
        threes = collections.Counter(zip(words, words[1:], words[2:]))
        inside = {j for i, t in enumerate(zip(words, words[1:], words[2:])) if threes[t] > 1 for j in range(i, i + 3)}
        assert (r.n_words, r.n_repeat_words) == (len(words), len(inside))
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and not (r.kept and r.base_failed)
    for r in queries.op2_personal_data(spark, tables).collect():
        assert r.base_sha256 == hashlib.sha256(pii.written(plain_spans(texts[r.doc_id] or "")).encode()).hexdigest()


ENTITIES = (
    "4111111111111111", "5500005555555559", "4111 1111 1111 1111", "5500-0055-5555-5559", "340000000000009", "10.2.3.4", "192.168.0.1", "172.16.9.30",
    "ann@mail.example.com", "bob.c@x.org", "+1 (202) 555-0147", "+1 (303) 555-0199", "+49 171 555 1234", "12345678", "2020-10-10", "1999", "12,500", "10:45",
)


def test_spans_across_other_white_space_and_lone_separators():
    model = pii.fit([(t, " ", " ") for t in ENTITIES], rounds=12)
    for kind, span in (("card", "4111  1111  1111  1111"), ("card", "4111\t1111\t1111\t1111"), ("ip", "10.0.0,1"), ("phone", "0171 / 55 / 1234")):
        text = f"call {span} now"
        assert pii.written(pii.all_spans(model, text, pii.base_spans(text))) == f"{kind}:5:{5 + len(span)}"
    for plain in ("in 1999 and 2020", "at @ noon", "9 - 9 - 9", ""):
        assert pii.all_spans(model, plain, []) == []


def test_a_long_text_of_numbers_and_a_long_word_take_linear_memory():
    random.seed(3)
    numbers = "\t".join(str(random.randrange(10 ** random.randrange(1, 9))) for _ in range(40_000))
    tracemalloc.start()
    pii.all_spans(pii.Field(), numbers, pii.base_spans(numbers))
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    assert list(pii.stretches("a" * 300_000 + " 12345")) == [(300_001, 300_006)]


def test_the_sample_holds_every_kind(spark, documents, monkeypatch):
    """A kind in one document of 2,000 is learnt from; repeated rows count once."""
    rows = [(i, f"on {i} we sold {i * 7919 % 100_000} and {i * 31 % 977}") for i in range(2000)]
    rows += [(5000, "host 10.1.2.3"), (5001, "mail ann@x.org"), (5002, "pay 4111 1111 1111 1111"), (5002, "pay 4111 1111 1111 1111"), (5003, "ring +1 (202) 555-0147")]
    seen = []
    monkeypatch.setattr(pii, "fit", lambda samples: seen.extend(samples))
    pii.train(pii.texts(documents(rows)), max_docs=100, max_stretches=64)
    kinds = collections.Counter(k for t, _, _ in seen for k, _, _ in pii.base_spans(t))
    assert kinds == {0: 1, 1: 1, 2: 1, 3: 1} and len(seen) == len(set(seen)) <= 64 // 8 * 4 + 32
