from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paycadence.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank int, g string, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The top, and for each node its siblings level by level as (left, sibling or None)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            other = k + 1 if k % 2 == 0 else k - 1
            paths[i].append((k % 2 == 1, nodes[other] if other < len(nodes) else None))
            at[i] = k // 2
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain_manifest(rows):
    """Every row's result, from one list in memory."""
    by_lang = collections.defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf((r[0], r[1], r[2], r[3], r[4])), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([t[2] for t in sorted(by_lang[x], key=lambda t: t[:3])]) for x in langs}
    root, tops = plain_tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops):
        subroot, paths = trees[x]
        for (_, _, node, r), path in zip(sorted(by_lang[x], key=lambda t: t[:3]), paths):
            begun = node
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                begun = leaf((r[0], r[1], r[2], r[3] + 1, r[4]))
            folded = begun
            for left, sibling in path + top:
                folded = sha(folded if sibling is None else sibling + folded if left else folded + sibling)
            out.append((r[0], node, subroot, root, sha("".join(s for _, s in path + top if s)), folded, folded == root))
    return out


def rows_of(seed, n, langs=("de", "en", "é", "", None)):
    random.seed(seed)
    out = []
    for i in range(n):
        text = random.choice([None, "", "a", "naïve 日本 😀", "-", "1:x", "w " * random.randint(0, 300)])
        out.append((random.choice([i, i, i, None, 7]), random.choice(["s", "", None, "ü"]), random.choice(langs), random.choice([None, len(text or ""), -3]), text))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def compare(spark, rows, **options):
    table = spark.createDataFrame([(*r, "clash", 1, "g", "p") for r in rows], SCHEMA).repartition(5)
    out = manifest.manifest(table, **options)
    assert out.columns == COLUMNS
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(rows)))
    return got


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_superblocks_of_any_size_give_the_same_tree(spark, bits):
    rows = rows_of(bits, 90) + [(1, "s", "hot", 1, "t")] * 5 + [(None, None, None, None, None)] * 2
    got = compare(spark, rows, bits=bits, rows_a_part=13)
    assert {r[-1] for r in got} == {True, False}


def test_hot_language_and_single_leaves(spark):
    rows = [(i, "s", "hot", i, "t") for i in range(200)] + [(1000 + i, "s", f"l{i}", 1, "t") for i in range(9)]
    compare(spark, rows, bits=3, rows_a_part=20)


def test_one_row_none_and_many_languages(spark):
    assert compare(spark, [(7, None, None, 3, "x" * 300_000)])[0][4] == sha("")
    compare(spark, [(i, "s", f"l{i % 40}", 1, str(i)) for i in range(60)], bits=2, rows_a_part=10)
    empty = manifest.manifest(spark.createDataFrame([], SCHEMA))
    assert empty.columns == COLUMNS and empty.count() == 0 and dict(empty.dtypes)["doc_id"] == "bigint"


def test_ids_beyond_doubles_and_text_ids(spark):
    big = 2**53 + 1
    rows = [(big, "s", "en", 1, "a"), (None, "s", "en", 1, "b"), (big + 1, "s", "en", 1, "c")]
    compare(spark, rows)
    table = spark.createDataFrame([("x", "s", "en", 1, "a")], "doc_id string, source string, lang string, n_chars int, text string")
    assert manifest.manifest(table).first()["leaf"] == leaf(("x", "s", "en", 1, "a"))


def test_stored_paths_prove_their_rows(spark):
    rows = [(i, "s", f"l{i % 3}", i, f"t{i}") for i in range(70)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = manifest.manifest(table, bits=2, with_path=True)
    checked = out.select((manifest.fold_column(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), "verified", "doc_id").collect()
    assert len(checked) == 70 and all(r.ok for r in checked)
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in checked)


@given(st.integers(1, 70), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_local_levels_equal_the_whole_tree(n, bits):
    nodes = [sha(str(i)) for i in range(n)]
    top, paths = plain_tree(nodes)
    whole = manifest.levels(nodes, True, bits)
    assert whole[-1] == [top] and [manifest.siblings(whole, i) for i in range(n)] == paths
    assert all(manifest.folded(x, p) == top for x, p in zip(nodes, paths))


def test_the_plan_cogroups_by_superblock(spark):
    rows = [(i, "s", "en", 1, "t") for i in range(30)]
    out = manifest.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), bits=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
