"""Near-duplicate classes by BagMinHash signatures of word shingles.

A text is the multiset of its runs of five words (white space apart; a shorter text is one run).
BagMinHash: each shingle of count c runs Poisson processes over the count's range, [0, 1), [1, 2),
[2, 4), [4, 8) and so on, of a rate equal to the range's length. A point carries a time, a register
and a place in its range, and counts if that place lies below c. Each register keeps its earliest
time; two texts agree in a register with the probability of their weighted Jaccard similarity. A
process goes on only while its time is below the latest register of its text, so a long text costs
hardly more than one point a shingle.

Equal texts form one class first, by a 128-bit hash, and only one row of each goes on. Registers
are banded; in a band's bucket each text is linked to the first one (in a fixed pseudo-random
order) and to its neighbour in that order: two links a row, however large the bucket. Large buckets
are dealt to parts, whose first rows are linked in the same way. Each link is then verified by the
true multiset overlap, and links make components.

A bucket of more than three rows may still hold several components. The texts of all such buckets
are joined exactly (``apart_pairs``): elements of their multisets, the rarest first, meet by element
and by class of size, and only where the remaining elements of both could still make the pair alike.
Elements that a family of texts shares come last and meet nowhere, unless they alone make texts
alike. Only pairs from different components are kept, one of them outside its bucket's largest; they
are verified in rounds, a random share first, and each round drops the pairs that the ones found so
far join. So no pair that shares a bucket is left out. Classes are the connected components.

Null text counts as empty. Texts without words are alike only if equal. A row with a null id joins
a class by equal text only, and a class of null ids alone has a null class_id. Repeated rows come
back as often; rows of one id with different texts are one document to the links, compared by
the first of those texts in order. Texts of any length are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, kept, small_batches, texts

WORDS = 5
BANDS, ROWS = 32, 5
REMEMBERED = 300_000
#: Rows of ids up to which a set of them is broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of a bucket beyond which it is dealt to parts of about as many rows.
BLOCK = 500
#: Pairs that a round verifies at least, if there are as many.
ROUND_PAIRS = 50_000
#: Ratio between neighbouring classes of multiset sizes.
SIZE_STEP = 1.06

ODD = np.uint64(0x9E3779B97F4A7C15)


#: One number for each range of a count.
STEPS = np.arange(1, 65, dtype=np.uint64) * ODD


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of shingles; remembers the hash of each word it has met."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def word_hashes(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word and its text's number."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [t.split() for t in batch]
        for words in split:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        sizes = [len(x) for x in split]
        hashes = np.fromiter((known[w] for x in split for w in x), np.uint64, sum(sizes))
        return hashes, np.repeat(np.arange(len(batch)), sizes)

    def bags(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, shingle hash and count, by text and hash."""
        hashes, doc = self.word_hashes(batch)
        sizes = np.bincount(doc, minlength=len(batch))
        first = np.cumsum(sizes) - sizes
        n = len(hashes)
        place = np.arange(n) - first[doc] if n else np.zeros(0, np.int64)
        # A run starts at each word that has enough behind it; a shorter text is one run.
        starts = np.flatnonzero((place + self.words <= sizes[doc]) | (place == 0))
        owner = doc[starts]
        h = np.zeros(len(starts), np.uint64)
        for k in range(self.words):
            there = place[starts] + k < sizes[owner]
            word = np.where(there, hashes[np.minimum(starts + k, max(0, n - 1))], np.uint64(0))
            h = mixed(h * ODD + word + np.uint64(k + 1))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(n_docs: int, doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, registers: int) -> np.ndarray:
    """BagMinHash registers of each text; infinite for a text without shingles."""
    levels = int(count.max()).bit_length() if len(count) else 0
    owner, seed, rate, low, weight = [], [], [], [], []
    for level in range(levels + 1):
        start = (1 << level) >> 1  # ranges [0, 1), [1, 2), [2, 4), ...
        there = count > start
        if not there.any():
            break
        owner.append(doc[there])
        seed.append(mixed(shingle[there] + STEPS[level]))
        rate.append(np.full(there.sum(), float(max(1, start))))
        low.append(np.full(there.sum(), start))
        weight.append(count[there])
    least = np.full(n_docs * registers, np.inf)
    if not owner:
        return least.reshape(n_docs, registers)
    owner, seed, rate, low, weight = map(np.concatenate, (owner, seed, rate, low, weight))
    time = np.zeros(len(owner))
    latest = np.full(n_docs, np.inf)
    while len(owner):
        seed = mixed(seed + ODD)
        uniform = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        time = time - np.log(uniform) / rate
        draw = mixed(seed ^ ODD)
        register = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        place = low + ((draw >> np.uint64(32)).astype(np.float64) / 2.0**32 * rate).astype(np.int64)
        counts = (place < weight) & (time < latest[owner])
        np.minimum.at(least, owner[counts] * registers + register[counts], time[counts])
        touched = np.unique(owner)
        latest[touched] = least.reshape(n_docs, registers)[touched].max(axis=1)
        on = time < latest[owner]
        owner, seed, rate, low, weight, time = (x[on] for x in (owner, seed, rate, low, weight, time))
    return least.reshape(n_docs, registers)


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = registers.view(np.uint64).reshape(len(registers), bands, rows)
    h = np.zeros(bits.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        h = mixed(h * ODD + bits[:, :, r])
    return h.view(np.int64)


def _bands(words: int, bands: int, rows: int):
    @F.pandas_udf("array<long>")
    def hashed(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler(words)
        for column in columns:
            doc, shingle, count = shingler.bags(column.tolist())
            registers = signatures(len(column), doc, shingle, count, bands * rows)
            found = list(band_hashes(registers, bands, rows))
            for i in np.flatnonzero(np.isinf(registers[:, 0])):
                found[i] = found[i][:0]
            yield pd.Series(found, index=column.index)

    return hashed


def _members(words: int):
    @F.pandas_udf("array<long>")
    def elements(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """The multiset as a set: the k-th of a shingle is an element of its own."""
        shingler = Shingler(words)
        for column in columns:
            doc, shingle, count = shingler.bags(column.tolist())
            which = np.repeat(np.arange(len(count)), count)
            k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            values = mixed(shingle[which] + ODD * k.astype(np.uint64)).view(np.int64)
            cuts = np.searchsorted(doc[which], np.arange(1, len(column)))
            yield pd.Series(np.split(values, cuts), index=column.index)

    return elements


def _small(df: DataFrame) -> DataFrame:
    """A stored frame of a few numbers a row, broadcast if a count of its rows allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def buckets(bands: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``bands`` (id, key) that share their bucket: with part (0, or from 1 on in a large bucket), the first
    row (head) and the one before (beside) in the part."""
    rank = F.xxhash64("id", F.lit(9))
    large = kept(bands.groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block))
    part = F.coalesce(1 + F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("n") / block)), F.lit(0))
    dealt = bands.join(_small(large), F.col("key") == F.col("__key"), "left").select("id", "key", part.alias("part")).repartition("key", "part")
    same = Window.partitionBy("key", "part")
    ordered = same.orderBy(rank, "id")
    rows = dealt.select("*", F.first("id").over(ordered).alias("head"), F.lag("id").over(ordered).alias("beside"), F.count(F.lit(1)).over(same).alias("n"))
    return rows.filter("n > 1 or part > 0").drop("n")


def candidate_links(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of ``buckets``: each row with its part's first and its neighbour, and likewise the firsts."""
    ordered = Window.partitionBy("key").orderBy(F.xxhash64("id", F.lit(9)), "id")
    firsts = rows.filter("part > 0 and head = id").select(
        "id", F.first("id").over(ordered).alias("head"), F.lag("id").over(ordered).alias("beside")
    )
    pairs = rows.select("id", "head", "beside").unionByName(firsts).select("id", F.explode(F.array("head", "beside")).alias("other"))
    return (
        pairs.filter(F.col("other").isNotNull() & (F.col("other") != F.col("id")))
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        .distinct()
    )


def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """id, root and minor of the rows in buckets of several components; minor: outside the largest one of some bucket.

    Buckets of up to three rows were compared whole by ``candidate_links``.
    """
    rooted = rows.join(roots, F.col("id") == F.col("node"), "left").select("id", "key", F.coalesce("root", "id").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("key").alias("__key"))
    sizes = sizes.agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"))
    # Stored, so that the join below is one of two shuffled sides and its hot keys can be split.
    open_ = kept(sizes.filter("roots > 1 and n > 3").select("__key", "most"))
    return rooted.join(open_, F.col("key") == F.col("__key")).groupBy("id", "root").agg(F.max(F.col("root") != F.col("most")).alias("minor"))


def apart_pairs(members: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Every alike pair a, b of ``members`` (id, root, minor) with roots ra, rb that differ, among few that aren't alike.

    In the order of elements by rarity, alike pairs meet first at an element behind which both hold
    enough. With sizes m <= n, a pair is alike if it shares (m + n) s / (1 + s) elements, s being the
    similarity. So an element with u elements from it on (itself included) lets its text meet
    sizes up to u (1 + s) / s - m only; the smaller text is sent to the classes of these sizes.
    """
    held = members.join(bags, F.col("id") == F.col("doc_id")).select("id", F.size("bag").alias("n"), F.explode("bag").alias("e"))
    shared = held.groupBy(F.col("e").alias("__e")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    one, need = Window.partitionBy("id"), similarity / (1 + similarity)
    places = held.join(shared, F.col("e") == F.col("__e")).select(
        "id", "n", "e", F.row_number().over(one.orderBy("c", "e")).alias("k"), F.count(F.lit(1)).over(one).alias("of")
    )
    # Elements that nobody else holds come first: u elements remain from this one on.
    left = places.select("id", "n", "e", (F.col("of") - F.col("k") + 1).alias("u")).filter(F.col("u") >= F.col("n") * similarity - 1e-9)
    upto = F.least(F.col("u") / need - F.col("n"), F.col("n") / similarity) + 1e-9
    rows = kept(left.withColumn("upto", F.floor(upto)).join(members, "id").select("id", "root", "minor", "n", "e", "u", "upto"))

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n) / float(np.log(SIZE_STEP))).cast("int")

    large = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns], size_class(F.col("n")).alias("b_class"))
    small = rows.filter("upto >= n").select("*", F.explode(F.sequence(size_class(F.col("n")), size_class(F.col("upto")))).alias("class"))
    meet = F.expr(
        "e = b_e and class = b_class and root != b_root and b_n >= n and b_n <= upto and n <= b_upto and (n < b_n or id < b_id)"
    )
    # Two of the largest component never meet, so a hot element costs as many steps as it has rows outside of it, times its rows.
    met = small.filter("minor").join(large, meet).unionByName(small.filter("not minor").join(large.filter("b_minor"), meet))
    swap = F.col("id") > F.col("b_id")
    choose = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    met = met.select(
        choose("id", "b_id").alias("a"), choose("b_id", "id").alias("b"), choose("root", "b_root").alias("ra"), choose("b_root", "root").alias("rb"),
        F.least("u", "b_u").alias("u"), (F.col("n") + F.col("b_n")).alias("n"),
    )
    # Whatever both hold before the last element they met at, they met at too.
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("u").alias("u"), *[F.first(x).alias(x) for x in ("ra", "rb", "n")])
    return pairs.filter(F.col("c") - 1 + F.col("u") >= F.col("n") * need - 1e-9).select("a", "b", "ra", "rb")


def joined_roots(pairs: DataFrame, bags: DataFrame, similarity: float, at_once: int) -> DataFrame | None:
    """(node, root) of the components that alike pairs make of roots; None if there are none.

    Pairs are verified by rounds of rising shares, drawn by a hash, the first one of about ``at_once``.
    """
    total = pairs.count()
    # Frames of a few numbers a row get tasks by their rows, whatever the number of shuffle partitions.
    tasks = max(1, -(-total // 100_000))
    left, edges = pairs.coalesce(tasks), None
    drawn = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))
    share, done = 1, None
    while total // share > at_once:
        share *= 4
    names = None
    while True:
        now = left.filter(drawn % share == 0)
        if done:
            now = now.filter(drawn % done != 0)
        found = kept(overlapping(now, bags, similarity).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct().coalesce(tasks))
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            names = components(edges)
        if share == 1:
            return names
        share, done = share // 4, share
        if names is not None:
            ends = [names.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root")) for c in ("ra", "rb")]
            on = left.join(ends[0], F.col("ra") == F.col("ra_node"), "left").join(ends[1], F.col("rb") == F.col("rb_node"), "left")
            left = kept(on.filter(F.coalesce("ra_root", "ra") != F.coalesce("rb_root", "rb")).select("a", "b", "ra", "rb").coalesce(tasks))
            if left.isEmpty():
                return names


def _labelled(docs: DataFrame, similarity: float, words: int, bands: int, rows: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their text's hash (doc_id, e1, e2), and each distinct text's least id and class (k1, k2, id, class_id)."""
    small_batches(docs.sparkSession)
    every = texts(docs, doc_id, text)
    signed = kept(every.select("doc_id", *_equal("text"), _bands(words, bands, rows)("text").alias("bands")))
    alike = kept(signed.groupBy("e1", "e2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    banded = kept(buckets(alike.filter("id is not null").select("id", F.explode("bands").alias("key"))))
    pairs = kept(candidate_links(banded))
    links = kept(verified(every, pairs, similarity, words).select("a", "b"))
    roots = components(links)
    of = alike.select("e1", "e2", "id").join(roots, F.col("id") == F.col("node"), "left").withColumn("class_id", F.coalesce("root", "id"))
    of = of.select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "id", "class_id")
    members = kept(apart(banded, roots))
    if not members.isEmpty():
        bags = _bags(every, members.select(F.col("id").alias("doc_id")), words)
        names = joined_roots(kept(apart_pairs(members, bags, similarity)), bags, similarity, max(ROUND_PAIRS, 2 * members.count()))
        if names is not None:
            of = of.join(names, F.col("class_id") == F.col("node"), "left").withColumn("class_id", F.coalesce("root", "class_id")).drop("node", "root")
    return signed.select("doc_id", "e1", "e2"), of


def _equal(text: str, mark: str = "") -> list:
    """128 bits that equal texts share."""
    return [F.xxhash64(text).alias(f"{mark}e1"), F.xxhash64(F.lit(7), text).alias(f"{mark}e2")]


def classes(
    docs: DataFrame, similarity: float = 0.8, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id and class_id (the least id of its class) of every row."""
    signed, of = _labelled(docs, similarity, words, bands, rows, doc_id, text)
    return signed.join(of, (F.col("e1") == F.col("k1")) & (F.col("e2") == F.col("k2"))).select("doc_id", "class_id")


def deduplicate(
    docs: DataFrame, similarity: float = 0.8, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All columns of one row of each class: the one of the least id (any of its repeated rows)."""
    _, of = _labelled(docs, similarity, words, bands, rows, doc_id, text)
    first = of.filter(F.col("id").eqNullSafe(F.col("class_id"))).select(F.col("k1"), F.col("k2"), F.col("id").alias("__id"))
    marked = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    marked = marked.select("*", *_equal("__text", "__")).drop("__text")
    same = (F.col("__e1") == F.col("k1")) & (F.col("__e2") == F.col("k2")) & F.col(doc_id).eqNullSafe(F.col("__id"))
    return marked.join(first, same, "left_semi").dropDuplicates(["__e1", "__e2"]).drop("__e1", "__e2")


def _bags(every: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and bag, the multiset of shingles, of some ids."""
    ids = kept(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return kept(
        every.join(ids, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .select("doc_id", _members(words)("text").alias("bag"))
    )


def verified(every: DataFrame, pairs: DataFrame, similarity: float, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose multisets of shingles overlap enough, with their similarity."""
    return overlapping(pairs, _bags(every, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), words), similarity)


def overlapping(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    left = bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b"))
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("shared", shared)
        .withColumn("similarity", F.col("shared") / (F.size("bag_a") + F.size("bag_b") - F.col("shared")))
        .filter(F.col("similarity") >= similarity)
        .drop("bag_a", "bag_b", "shared")
    )
