"""What several operators need: tables, row counts per Arrow batch, ordinals, components."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Documents reach megabytes, so the default of 10,000 rows is too many.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Makes Python workers ready: ``BATCH_ROWS`` rows a batch (from here on in this session), and ``ship``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Sends this package to where Python workers can import it, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="paycadence-")) / "paycadence.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, str(Path(package.name) / file.relative_to(package)))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


class Remembered:
    """A bounded memory in two generations: what is met again while a generation fills outlives it."""

    def __init__(self, make, size: int):
        self.make, self.size = make, size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, keys: list[str]) -> list[bytes]:
        """The value of each key, made where it isn't known."""
        new = self.new
        found = list(map(new.get, keys))
        if None in found:
            old, make = self.old, self.make
            for i, value in enumerate(found):
                if value is None:
                    key = keys[i]
                    value = new.get(key)
                    if value is None:
                        value = old.get(key)
                        if value is None:
                            value = make(key)
                        new[key] = value
                    found[i] = value
            if len(new) > self.size:
                self.old, self.new = new, {}
        return found


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text alone, so that other columns can't clash; a null text is empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def kept(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder: lineage ends there, executors may be lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder is ``spark.checkpoint.dir``; only a local master gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that every executor reaches")
            folder = tempfile.mkdtemp(prefix="paycadence-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def held_out(modulus: int, rest: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id, as text, leaves this rest; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def ordinals(df: DataFrame, groups: list[str], order: list[Column], out: str, rows_a_task: int | None = None) -> DataFrame:
    """Numbers the rows of each group from 0 without a gap, no group in one task.

    Rows go to buckets by the hash of ``order``; a bucket's first number is the count of the
    buckets before it. So numbers follow a pseudo-random order that depends on the data alone.
    A bucket of all rows has about ``rows_a_task``, by default 2,000 or what makes 5,000 buckets;
    only counts per bucket meet in a group.
    """
    total = df.count()
    rows_a_task = rows_a_task or max(2_000, total // 5_000)
    buckets = max(1, -(-total // rows_a_task))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = df.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"),
    )
    inside = Window.partitionBy(*groups, "__bucket").orderBy(*order)
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)] + [F.col("__bucket") == F.col("__b")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return (
        df.withColumn("__row", F.row_number().over(inside) - 1)
        .join(first, on)
        .withColumn(out, (F.col("__first") + F.col("__row")).cast("long"))
        .drop("__bucket", "__row", "__b", "__first", *[f"__g{i}" for i in range(len(groups))])
    )


def components(edges: DataFrame, rounds: int = 40, rows_a_task: int = 100_000) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node that has an edge.

    ``edges`` has columns a and b. Each round links every node to the smallest root next to it
    and then to that root's root, so paths shorten geometrically; a round reads and writes only
    (node, root) rows in the checkpoint folder. No node list reaches the driver. Stages have as many
    tasks as their rows need, whatever the number of shuffle partitions.
    """
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    tasks = max(1, -(-both.count() // rows_a_task))
    both = both.coalesce(tasks)
    roots = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")).coalesce(tasks))
    for _ in range(rounds):
        near = both.join(roots, F.col("b") == F.col("node")).coalesce(tasks).groupBy("a").agg(F.min("root").alias("near"))
        step = kept(roots.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("next")).coalesce(tasks))
        # A smaller root found by one node is told to its old root as well.
        told = step.groupBy(F.col("root").alias("old")).agg(F.min("next").alias("told")).coalesce(tasks)
        hook = step.join(told, F.col("root") == F.col("old")).select("node", F.col("root").alias("was"), F.least("next", "told").alias("root")).coalesce(tasks)
        jump = hook.select(F.col("node").alias("up"), F.col("root").alias("above"))
        new = hook.join(jump, F.col("root") == F.col("up"), "left").select("node", "was", F.coalesce("above", "root").alias("root"))
        new = kept(new.coalesce(tasks))
        changed = new.filter(F.col("was") != F.col("root")).limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
