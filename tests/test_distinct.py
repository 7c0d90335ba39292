from __future__ import annotations

import random
from datetime import date

import pytest
from conftest import records
from pyspark.sql import functions as F

from paycadence.operators import distinct
from paycadence.operators.distinct import DistinctStore


def plain(rows, by):
    """Distinct keys per group, in Python; ``rows`` are (key, period, method)."""
    seen = {}
    for key, period, method in rows:
        group = tuple({"period": period, "method": method}[c] for c in by)
        seen.setdefault(group, set()).add(key)
    return {g: len(keys - {None}) for g, keys in seen.items()}


def made(seed, n, keys, periods=("2024-01-01", "2024-02-01", "2024-03-01")):
    random.seed(seed)
    rows = [(f"k{random.randrange(keys)}", date.fromisoformat(random.choice(periods)), random.choice(["charge", "payment", None])) for _ in range(n)]
    rows += [("hot", date.fromisoformat(periods[0]), "charge")] * (n // 3)
    return rows + [(None, date.fromisoformat(periods[-1]), "payment"), (None, date.fromisoformat(periods[-1]), "cash payment")]


SCHEMA = "key string, period date, method string"


def as_dict(df, by, name="keys"):
    return {tuple(r[c] for c in by): r[name] for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7, 256])
def test_counts_of_every_level(spark, parts):
    rows = made(1, 900, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    cells = distinct.bitmaps(distinct.numbered(df.distinct(), "key", parts), ["period", "method"])
    for by in (["period", "method"], ["method"], ["period"], []):
        assert as_dict(distinct.counts(cells, by, "keys"), by) == plain(rows, by)


def test_numbers_over_several_blocks(spark):
    """70,000 keys of one part fill three blocks; each key is counted once on every level."""
    df = spark.range(70_000).select(F.col("id").alias("key"), (F.col("id") % 2).alias("half"))
    twice = df.union(df.withColumn("half", F.lit(5).cast("long")))
    cells = distinct.bitmaps(distinct.numbered(twice, "key", 1), ["half"])
    assert as_dict(distinct.counts(cells, ["half"], "n"), ["half"], "n") == {(0,): 35_000, (1,): 35_000, (5,): 70_000}
    assert distinct.counts(cells, [], "n").collect()[0].n == 70_000
    assert cells.select("block").distinct().count() == 3


def test_empty_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    cells = distinct.bitmaps(distinct.numbered(df, "key"), ["method"])
    assert distinct.counts(cells, ["method"], "n").count() == distinct.counts(cells, [], "n").count() == 0


def test_levels_need_one_shuffle_of_the_rows(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    spark.createDataFrame(made(2, 50, 20), SCHEMA).write.parquet(path)
    df = spark.read.parquet(path)
    cells = distinct.bitmaps(distinct.numbered(df, "key"), ["period", "method"])
    plan = distinct.counts(cells, [], "n")._jdf.queryExecution().toString()
    # By part; then the last sum, of one number for each part.
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange ") == 2 and "Expand" not in plan and "SinglePartition" not in plan


def test_a_dictionary_grows_without_renumbering(spark):
    first = spark.createDataFrame([(f"k{i}",) for i in range(0, 50)] + [(None,)], "key string")
    more = spark.createDataFrame([(f"k{i}",) for i in range(30, 120)] * 2 + [(None,)], "key string")
    known = distinct.dictionary(first, "key", 4)
    new = distinct.new_numbers(known, more, "key", 4)
    old = {r.key: (r.part, r.number) for r in known.collect()}
    both = {**old, **{r.key: (r.part, r.number) for r in new.collect()}}
    assert len(old) == 50 and len(both) == 120 == len(set(both.values()))
    assert all(both[k] == v for k, v in old.items())
    for part in range(4):
        numbers = sorted(n for p, n in both.values() if p == part)
        assert numbers == list(range(len(numbers)))


def test_a_store_by_cycles(spark, tmp_path):
    """Closing cycles one by one, and one of them anew, gives the counts over all rows."""
    store = DistinctStore(spark, f"file://{tmp_path}/store", "key", "string", parts=8)
    rows = made(3, 600, 200)
    frames = {}
    for period in sorted({r[1] for r in rows}):
        frames[period] = [r for r in rows if r[1] == period]
        store.replace(spark.createDataFrame(frames[period], SCHEMA), ["method"])
    for by in (["period", "method"], ["period"], ["method"], []):
        want = {g: n for g, n in plain(rows, by).items() if n}
        assert as_dict(distinct.counts(store.cells(), by, "keys"), by) == want
    again = date(2024, 2, 1)
    frames[again] = [("late", again, "charge"), *frames[again][:40]]
    before = records(store.cells().filter(F.col("period") != F.lit(again)), "period", "method", "part", "block")
    store.replace(spark.createDataFrame(frames[again], SCHEMA), ["method"])
    assert records(store.cells().filter(F.col("period") != F.lit(again)), "period", "method", "part", "block") == before
    now = [r for part in frames.values() for r in part]
    assert as_dict(distinct.counts(store.cells(), ["period"], "keys"), ["period"]) == plain(now, ["period"])
    assert store.dictionary().count() == store.dictionary().select("key").distinct().count() == len({r[0] for r in [*rows, *now]} - {None})
