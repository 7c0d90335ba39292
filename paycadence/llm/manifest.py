"""A Merkle manifest of a table of documents: leaves, one tree for each language, a root over all.

Each row is a leaf, the SHA-256 of its fields. The leaves of a language, in the order of ids, are
folded in pairs level by level (a node without a partner is hashed alone) until one is left, the
subroot; subroots in the order of languages are folded in the same way to the root.

Trees are cut into superblocks of ``2 ** bits`` neighbours. Going up, each superblock is reduced to
its top node, and these are the nodes of the next round. Coming down, the nodes of a superblock are
cogrouped with the one row of outer nodes that it needs (the siblings above its top): one call
finishes the local reduction, joins inner to outer siblings and folds every leaf to a root again.
So a task holds one superblock, however many rows a language has, and the rounds grow with the
logarithm of the largest language; only that language's count and the root reach the driver.

Positions come from a range partitioning by language, id, leaf and a row number, written before it
is read again: rows of one language or of one id are spread over tasks. Rows with equal ids stand in
the order of their leaves; equal rows are leaves of their own, alike in all but their siblings. A
null id comes first in its language and is never tampered with; a null language is a tree of its
own, the first one. Nulls and empty values differ (``-`` and ``0:``). Texts of any length are hashed
whole, in the JVM. Other columns play no part. A table without rows has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, ship

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 10
ROWS_A_PART = 50_000
PATH = "array<struct<left:boolean,sibling:string>>"
NODES = "g string, n long, rank long, node string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """Byte count, colon and value; a dash for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(df: DataFrame, order: Sequence[str], rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """Adds n, the count of a row's group ``g``, and rank, its place in it from 0 by ``order``.

    ``df`` must be stored. Parts are ranges of (g, order); counts of parts are all that meets in a group.
    """
    parts = max(1, -(-df.count() // rows_a_part))
    ranges = df.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)
    placed = kept(ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = placed.groupBy("part", "g").agg(F.min("at").alias("from"), F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("g")
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", "g", "from", F.sum("rows").over(group).alias("n"), F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(counts, ["part", "g"]).withColumn("rank", F.col("at") - F.col("from") + F.col("before")).drop("part", "at", "from", "before")


def levels(nodes: list[str], whole: bool, bits: int) -> list[list[str]]:
    """The nodes of a superblock and of every level above them inside it; ``whole``: it is its tree's only one."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= bits:
        below = out[-1]
        out.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def siblings(inside: list[list[str]], i: int) -> list[tuple[bool, str | None]]:
    """For node ``i``, level by level: whether its sibling stands left of it, and the sibling if there is one."""
    path = []
    for level in inside[:-1]:
        path.append((bool(i & 1), level[i ^ 1] if i ^ 1 < len(level) else None))
        i >>= 1
    return path


def folded(node: str, path: Sequence[tuple[bool, str | None]]) -> str:
    for left, sibling in path:
        node = digest((sibling + node if left else node + sibling) if sibling is not None else node)
    return node


def fold_column(node: Column, path: Column) -> Column:
    """The root that a leaf and its path (``PATH``) lead to, as a column: checks a stored proof."""

    def step(at: Column, x: Column) -> Column:
        other = F.coalesce(x["sibling"], F.lit(""))
        return F.sha2(F.when(x["left"], F.concat(other, at)).otherwise(F.concat(at, other)), 256)

    return F.aggregate(path, node, step)


def _up(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Nodes (``NODES``) of each round: those given, top nodes of their superblocks, and so on to one a group."""

    def top(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        n = int(block["n"].iloc[0])
        node = levels(block["node"].tolist(), n <= 1 << bits, bits)[-1][0]
        return pd.DataFrame({"g": [block["g"].iloc[0]], "n": [-(-n >> bits)], "rank": [int(block["rank"].iloc[0]) >> bits], "node": [node]})

    most = nodes.agg(F.max("n")).first()[0]
    rounds = [nodes]
    while len(rounds) == 1 or most > 1:
        block = F.shiftright("rank", bits).alias("block")
        rounds.append(kept(rounds[-1].select("g", "n", "rank", "node").groupBy("g", block).applyInPandas(top, NODES)))
        most = -(-most >> bits)
    return rounds


def _paths(nodes: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """g, rank, path and subroot of each node, from the outer rows (same columns) of their superblocks."""

    def join(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        inside = levels(block["node"].tolist(), int(block["n"].iloc[0]) <= 1 << bits, bits)
        rest = [(x["left"], x["sibling"]) for x in above["path"].iloc[0]]
        paths = [siblings(inside, i) + rest for i in range(len(block))]
        return pd.DataFrame({"g": block["g"], "rank": block["rank"], "path": paths, "subroot": above["subroot"].iloc[0]})

    blocks = nodes.select("g", "n", "rank", "node").groupBy("g", F.shiftright("rank", bits).alias("block"))
    return blocks.cogroup(outer.groupBy("g", F.col("rank").alias("block"))).applyInPandas(join, f"g string, rank long, path {PATH}, subroot string")


def _outer(rounds: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """Outer rows for the superblocks of the first round, from those of the last."""
    for nodes in reversed(rounds[1:-1]):
        above = kept(_paths(nodes, above, bits))
    return above


def leaves(docs: DataFrame, doc_id: str, source: str, lang: str, n_chars: str, text: str) -> DataFrame:
    """g (the language, null apart from all), id as text, leaf and the tampered leaf (null where nothing changes)."""
    values = [F.col(c) for c in (doc_id, source, lang, n_chars, text)]
    more = [*values[:3], values[3].cast("decimal(38,0)") + 1, values[4]]
    struck = (F.crc32(values[0].cast("string").cast("binary")) % 7 == 0) & values[3].isNotNull()
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), values[2].cast("string")), F.lit("0")).alias("g"),
        values[0].alias("doc_id"),
        leaf(values).alias("node"),
        F.when(struck, leaf(more)).alias("struck"),
        F.monotonically_increasing_id().alias("row"),
    )


def manifest(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    lang: str = "lang",
    n_chars: str = "n_chars",
    text: str = "text",
    bits: int = BITS,
    with_path: bool = False,
    rows_a_part: int = ROWS_A_PART,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; its path (``PATH``) on request.

    folded_root starts from the tampered leaf: n_chars is one more where 7 divides crc32 of the id.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    columns = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    columns += f", path {PATH}" if with_path else ""
    stored = kept(leaves(docs, doc_id, source, lang, n_chars, text))
    if stored.isEmpty():
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, {columns}")
    # Ids travel through pandas as text: whole numbers beside nulls would turn into floats there.
    ranked = kept(numbered(stored, ("doc_id", "node", "row"), rows_a_part).withColumn("doc_id", F.col("doc_id").cast("string")).drop("row"))
    trees = _up(ranked, bits)
    subroots = trees[-1].select("g", F.col("node"))
    tops = kept(numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("lang"), "node"), ("lang",), rows_a_part))
    crown = _up(tops, bits)
    root = crown[-1].first()["node"]  # one row
    none = F.array().cast(PATH).alias("path")
    above = _outer(crown, crown[-1].select("g", "rank", none, F.lit("").alias("subroot")), bits)
    above = tops.join(_paths(tops, above, bits).drop("g"), "rank")
    above = above.select(F.col("lang").alias("g"), F.lit(0).cast("long").alias("rank"), "path", F.col("node").alias("subroot"))
    outer = _outer(trees, kept(above), bits)

    def finish(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        nodes = block["node"].tolist()
        inside = levels(nodes, int(block["n"].iloc[0]) <= 1 << bits, bits)
        rest = [(x["left"], x["sibling"]) for x in above["path"].iloc[0]]
        joined = "".join(s for _, s in rest if s)
        out: dict[str, list] = {"proof_sha256": [], "folded_root": []}
        paths = []
        for i, (node, struck) in enumerate(zip(nodes, block["struck"])):
            near = siblings(inside, i)
            out["proof_sha256"].append(digest("".join(s for _, s in near if s) + joined))
            out["folded_root"].append(folded(struck if isinstance(struck, str) else node, near + rest))
            if with_path:
                paths.append(near + rest)
        found = pd.DataFrame({"doc_id": block["doc_id"].tolist(), "leaf": nodes, "subroot": above["subroot"].iloc[0], "root": root, **out})
        found["verified"] = found["folded_root"] == root
        if with_path:
            found["path"] = paths
        return found

    blocks = ranked.groupBy("g", F.shiftright("rank", bits).alias("block"))
    done = blocks.cogroup(outer.groupBy("g", F.col("rank").alias("block"))).applyInPandas(finish, f"doc_id string, {columns}")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
