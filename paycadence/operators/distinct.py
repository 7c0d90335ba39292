"""Distinct counts that merge: keys numbered densely by part, and one bitmap for each group and block of numbers.

A key's part is a hash of it, its number the rank among the part's keys. A group's distinct
keys are bits: one row of 4 KB for each group, part and block of 32,768 numbers. Rows of coarser
groups are the ``or`` of finer ones, so counts over methods, cycles or segments need neither the
keys nor a copy of every row for each level. Parts share no key, so counts add up over them, and
all steps up to the last sum run on one partitioning by part.

Null keys are not counted; null groups keep their own row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts are tasks: at least as many as cores, few enough that a part's blocks are well filled.
PARTS = 256
#: Numbers in a block, as Spark's bitmap functions have it.
BLOCK = 32_768


def part_of(key: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def numbered(rows: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """Adds ``part`` and ``number`` (from 0, without gaps in the part; null for a null key).

    Rows should be reduced by key first: rows of one key stay in one task.
    """
    with_part = rows.withColumn("part", part_of(key, parts))
    rank = F.dense_rank().over(Window.partitionBy("part").orderBy(F.col(key).asc_nulls_last()))
    return with_part.withColumn("number", F.when(F.col(key).isNotNull(), rank - 1).cast("bigint"))


def dictionary(keys: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """key, part and number of each distinct key: what stored bitmaps refer to."""
    return numbered(keys.select(key).filter(F.col(key).isNotNull()).distinct(), key, parts)


def new_numbers(known: DataFrame, keys: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """key, part and number of the keys that the dictionary lacks, numbered behind those of their part.

    ``parts`` is that of ``known``.
    """
    taken = known.groupBy("part").agg(F.count("*").alias("taken"))
    lacking = keys.select(key).filter(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
    behind = numbered(lacking, key, parts).join(taken, "part", "left")
    return behind.select(key, "part", (F.col("number") + F.coalesce("taken", F.lit(0))).alias("number"))


def bitmaps(rows: DataFrame, by: Sequence[str], *sums: str) -> DataFrame:
    """by, part, block, bits and the sums of further columns, from numbered rows."""
    # Null numbers set no bit; their rows are in block 0 for the sake of the sums.
    block = F.floor(F.coalesce("number", F.lit(0)) / BLOCK).cast("int").alias("block")
    bits = F.bitmap_construct_agg(F.pmod("number", F.lit(BLOCK))).alias("bits")
    return rows.groupBy(*by, "part", block).agg(bits, *[F.sum(c).alias(c) for c in sums])


def merged(cells: DataFrame, by: Sequence[str], *sums: str) -> DataFrame:
    """Bitmaps of coarser groups, or of several stored tables put together."""
    return cells.groupBy(*by, "part", "block").agg(F.bitmap_or_agg("bits").alias("bits"), *[F.sum(c).alias(c) for c in sums])


def counts(cells: DataFrame, by: Sequence[str], name: str, *sums: str) -> DataFrame:
    """by, the distinct keys of each group as ``name``, and the sums."""
    level = merged(cells, by, *sums)
    # A level over everything has one group, which is still a shuffle by key and not a single partition.
    keys = [F.col(c) for c in by] or [F.lit(True).alias("_all")]
    out = level.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name), *[F.sum(c).alias(c) for c in sums])
    return out if by else out.drop("_all")


def levels(cells: DataFrame, groups: Sequence[Sequence[str]], name: str, types: dict[str, str]) -> DataFrame:
    """``counts`` for each list of groups, in one long frame.

    ``types`` names every group column with its type; ``level`` says which were used, joined by
    commas, and the others are null.
    """
    out = None
    for by in groups:
        used = [F.col(c) if c in by else F.lit(None).cast(t).alias(c) for c, t in types.items()]
        part = counts(cells, by, name).select(F.lit(",".join(by)).alias("level"), *used, name)
        out = part if out is None else out.unionByName(part)
    return out


class DistinctStore:
    """Bitmaps by period, and the dictionary that they refer to, as Parquet in a shared folder.

    ``replace`` rewrites the periods of its rows and no others. New keys are appended before the bitmaps
    that use them, and a key keeps its number, so a run that fails between the two leaves nothing wrong.
    One run writes at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str, parts: int = PARTS):
        self.spark, self.folder, self.key, self.parts = spark, folder.rstrip("/"), key, parts
        self.schema = f"`{key}` {kind}, part int, number bigint"
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.folder}/keys")

    def dictionary(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/keys")

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/cells")

    def replace(self, rows: DataFrame, by: Sequence[str] = ()) -> None:
        """``rows`` have ``period``, the key and the columns ``by``; all rows of the periods they are of."""
        names = ["period", *by, self.key]
        reduced = rows.select(*names).distinct()
        new_numbers(self.dictionary(), reduced, self.key, self.parts).write.mode("append").parquet(f"{self.folder}/keys")
        known = reduced.join(self.dictionary(), self.key)
        writer = bitmaps(known, ["period", *by]).write.partitionBy("period").mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/cells")
