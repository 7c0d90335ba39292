"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph here is a line, cut further behind sentence ends, without the white space around it;
empty ones don't count. Each is hashed to a wide vector of ``LANES`` numbers of 8 bits, and a
fingerprint is the sum of the vectors modulo 2**32 in each lane. So the order of paragraphs
doesn't matter, equal multisets have equal fingerprints, a paragraph is put in or taken out by
adding or subtracting its vector (``combine``), and two fingerprints of multisets that share
paragraphs point the same way: their likeness is the centred vectors' product over the larger
square, from 0 to 1.

Only DataFrame functions touch rows. Null texts count as empty; an empty text's fingerprint is
all zeros, alike (1) to another empty one and not (0) to others. Rows with equal ids are taken in
the order of their texts; the last row's next row is the first. One row is its own next row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, texts

LANES = 64
WORDS = LANES // 2  # numbers of 64 bits that hold two lanes each
PARAGRAPH_END = r"\n|(?<=[.!?]) "


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH_END), lambda x: F.trim(x)), lambda x: x != "")


def lane_sums(paragraph: Column) -> list[Column]:
    """Aggregates: two lanes of 32 bits in each number, from 8-bit parts of eight hashes."""
    out = []
    for seed in range(LANES // 8):
        wide = F.xxhash64(F.lit(seed), paragraph)
        for part in range(4):
            out.append(F.sum(F.shiftrightunsigned(wide, 8 * part).bitwiseAND(F.lit(0xFF000000FF))).alias(f"w{4 * seed + part}"))
    return out


def lanes(words: Column, count: Column) -> Column:
    """The numbers of two lanes apart, each centred at its mean over random paragraphs."""
    centre = count.cast("double") * 127.5
    low = F.transform(words, lambda w: w.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") - centre)
    high = F.transform(words, lambda w: F.shiftrightunsigned(w, 32).cast("double") - centre)
    return F.concat(low, high)


def hexed(words: Column, count: Column) -> Column:
    """The count of paragraphs and the lanes, in hexadecimal."""
    parts = F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0"))
    return F.concat(F.lpad(F.lower(F.hex(count)), 8, "0"), F.array_join(parts, ""))


def likeness(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Of two fingerprints' numbers and counts: share of the larger multiset that both hold, estimated."""
    x, y = lanes(a, na), lanes(b, nb)

    def product(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)

    larger = F.greatest(product(x, x), product(y, y))
    close = F.least(F.lit(1.0), F.greatest(F.lit(0.0), product(x, y) / larger))
    return F.when((na == nb) & (a == b), F.lit(1.0)).when((na == 0) | (nb == 0) | (larger == 0), F.lit(0.0)).otherwise(close)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Numbers of the multiset with b's paragraphs put in (1) or taken out (-1), lane by lane."""
    mask, over = F.lit(0xFFFFFFFF), F.lit(1 << 32)

    def lane(p: Column, q: Column) -> Column:
        return F.pmod(p + sign * q, over)

    return F.zip_with(
        a,
        b,
        lambda p, q: F.shiftleft(lane(F.shiftrightunsigned(p, 32), F.shiftrightunsigned(q, 32)), 32).bitwiseOR(
            lane(p.bitwiseAND(mask), q.bitwiseAND(mask))
        ),
    )


def summed(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, n and words of the paragraphs in an array column of each row; keys tell rows apart."""
    names = [f"w{i}" for i in range(WORDS)]
    sums = df.select(*keys, F.explode_outer(column).alias("__p")).groupBy(*keys).agg(F.count("__p").alias("n"), *lane_sums(F.col("__p")))
    return sums.select(*keys, "n", F.array(*[F.coalesce(F.col(x), F.lit(0)) for x in names]).alias("words"))


def _bucketed(rows: DataFrame, rows_a_bucket: int | None) -> DataFrame:
    """Rows with the number of a range of ids, and for each range the row that follows its last one (``ghost``).

    Range bounds come from quantiles of the ids, a row of which is a number; ranges have about
    ``rows_a_bucket`` rows, by default 2,000 or what makes 20,000 ranges. The ghost of the last
    range is the first row of all.
    """
    total = rows.count()
    rows_a_bucket = rows_a_bucket or max(2_000, total // 20_000)
    n = max(1, -(-total // rows_a_bucket))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    # Bounds in blocks: a row is compared to the blocks' first bounds and to one block's.
    wide = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    if blocks:
        firsts = F.array(*[F.lit(int(b[0])) for b in blocks])
        inner = F.array(*[F.array(*[F.lit(int(x)) for x in b]) for b in blocks])
        block = F.size(F.filter(firsts, lambda x: x <= F.col("doc_id")))
        bucket = F.when(block == 0, 0).otherwise(
            (block - 1) * wide + F.size(F.filter(F.element_at(inner, F.greatest(block, F.lit(1))), lambda x: x <= F.col("doc_id")))
        )
        rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    # The first row of each range: its id by counting, its text by a second, filtered read.
    least = kept(rows.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")))
    lead = F.lead("bucket").over(Window.orderBy("bucket"))  # a row for each range
    head = F.first("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = least.select(F.col("bucket").alias("__to"), F.coalesce(lead, head).alias("__from"))
    firsts = (
        rows.join(
            F.broadcast(least.withColumnRenamed("bucket", "__b")),
            (F.col("bucket") == F.col("__b")) & F.when(F.col("nulls"), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("first")),
        )
        .groupBy("bucket")
        .agg(F.min(F.struct("doc_id", "text")).alias("s"))
        .select(F.col("bucket").alias("__b"), "s.*")
    )
    ghosts = firsts.join(F.broadcast(follow), F.col("__b") == F.col("__from")).select("doc_id", "text", F.col("__to").alias("bucket"))
    return rows.select("doc_id", "text", "bucket", F.lit(False).alias("ghost")).unionByName(ghosts.withColumn("ghost", F.lit(True)))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_paragraphs and fingerprint of every row."""
    rows = texts(docs, doc_id, text).withColumn("__row", F.monotonically_increasing_id())
    got = summed(rows.select("doc_id", "__row", paragraphs(F.col("text")).alias("p")), ["doc_id", "__row"], "p")
    return got.select("doc_id", F.col("n").alias("n_paragraphs"), hexed(F.col("words"), F.col("n")).alias("fingerprint"))


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_a_bucket: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next text's are.

    The last quarter of the code points is replaced by the first as many of the next row's text.
    Texts are shuffled once, by ranges of ids; sums and neighbours stay in that partitioning.
    """
    parts = _bucketed(texts(docs, doc_id, text), rows_a_bucket)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    following = F.lead("text").over(order)
    lined = parts.withColumn("place", F.row_number().over(order)).withColumn("next", following)
    edited = F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("next").substr(F.lit(1), quarter))
    lined = lined.withColumn("edited", F.when(~F.col("ghost"), edited))
    facts = ["bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = lined.select(
        "bucket",
        "place",
        "ghost",
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), paragraphs(F.col("text")).alias("p")),
                F.struct(F.lit(1).alias("kind"), paragraphs(F.coalesce("edited", F.lit(""))).alias("p")),
            )
        ).alias("x"),
    ).select(*facts, "x.kind", "x.p")
    sums = summed(both, [*facts, "kind"], "p")
    own, other = F.col("kind") == 0, F.col("kind") == 1
    rows = sums.groupBy(*facts).agg(
        F.max(F.when(own, F.struct("n", "words"))).alias("a"), F.max(F.when(other, F.struct("n", "words"))).alias("e")
    )
    after = Window.partitionBy("bucket").orderBy("place")
    rows = rows.withColumn("b", F.lead("a").over(after)).filter(~F.col("ghost"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed(F.col("a.words"), F.col("a.n")).alias("fingerprint"),
        hexed(F.col("e.words"), F.col("e.n")).alias("edited_fingerprint"),
        likeness(F.col("a.words"), F.col("a.n"), F.col("e.words"), F.col("e.n")).alias("near_edited"),
        likeness(F.col("a.words"), F.col("a.n"), F.col("b.words"), F.col("b.n")).alias("near_next"),
    )
