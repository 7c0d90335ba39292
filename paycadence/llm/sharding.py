"""Shards by minimax contiguous partition of groups of equal texts.

Groups stand in the order of their text's hash, and a shard is a run of groups. The smallest
capacity that lets a greedy walk end in ``n_shards`` runs is found by binary search, and the
cuts are made there. The walk needs running sums only, so it works on a histogram: hashes by
their leading bits, with bytes per cell. A cell that may hold a cut is opened into finer cells
until every cell that matters is a single hash, which can't be cut; what reaches the driver is a
bounded number of (cell, bytes) rows in each round, whatever the number of documents.

Only DataFrame functions touch rows. Null texts count as empty (size 1); equal texts share a shard
however many there are, so a group larger than the mean shard sets the capacity. An empty table
gives no rows. Repeated rows get slots of their own. Null ids are rows like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ordinals, texts

#: Leading bits of the first histogram, and bits more for each opened cell.
FIRST_BITS, MORE_BITS = 12, 9


@dataclass(frozen=True)
class Cell:
    """Hashes [low, high), as unsigned numbers; whole if it can't be cut."""

    low: int
    high: int
    size: int
    whole: bool


def walk(cells: list[Cell], capacity: int, n_shards: int, soft: bool) -> list[int] | None:
    """Greedy: for each cut, the cell that it falls in or before; None if the shards don't suffice.

    ``soft`` lets cells that aren't whole be cut anywhere (too hopeful); else nowhere (too strict).
    """
    cuts, room = [], capacity
    for k, cell in enumerate(cells):
        left = cell.size
        while left > room:
            if len(cuts) == n_shards - 1:
                return None
            if soft and not cell.whole:
                left -= room
            elif cell.size > capacity:
                return None
            cuts.append(k)
            room = capacity
        room -= left
    return cuts


def least(cells: list[Cell], n_shards: int, soft: bool) -> int:
    """The smallest capacity for which the walk succeeds, by binary search."""
    low, high = 0, sum(c.size for c in cells)
    while high - low > 1:
        middle = (low + high) // 2
        if walk(cells, middle, n_shards, soft) is None:
            low = middle
        else:
            high = middle
    return high


def boundaries(sizes: DataFrame, n_shards: int) -> list[int]:
    """First hash of each shard but the first, ascending. ``sizes``: h, read as unsigned, and size."""
    cells = [Cell(0, 1 << 64, 0, False)]
    open_now, bits = cells, FIRST_BITS
    while True:
        opened = _open(sizes, open_now, bits)
        gone = set(open_now)
        cells = sorted([c for c in cells if c not in gone] + opened, key=lambda c: c.low)
        if not cells:
            return []
        hopeful, strict = least(cells, n_shards, True), least(cells, n_shards, False)
        if all(c.whole for c in cells) or hopeful == strict and _agree(cells, strict, n_shards):
            cuts = walk(cells, strict, n_shards, False)
            return [cells[k].low for k in cuts]
        # The walk at the right capacity cuts between these two walks' cuts.
        early = walk(cells, hopeful, n_shards, False) or []
        late = walk(cells, strict, n_shards, True) or []
        open_now = []
        for i in range(n_shards - 1):
            first = early[i] if i < len(early) else _strict_cut(cells, hopeful, i)
            last = late[i] if i < len(late) else len(cells) - 1
            open_now += [c for c in cells[max(0, first - 1) : last + 2] if not c.whole]
        open_now = sorted(set(open_now), key=lambda c: c.low)
        if not open_now:
            open_now = [c for c in cells if not c.whole]
        bits = MORE_BITS


def _agree(cells: list[Cell], capacity: int, n_shards: int) -> bool:
    """Whether no cut falls in or next to a cell that could be cut."""
    cuts = walk(cells, capacity, n_shards, False)
    return cuts == walk(cells, capacity, n_shards, True) and all(cells[k].whole for k in cuts)


def _strict_cut(cells: list[Cell], capacity: int, i: int) -> int:
    """Cell of the i-th cut of a strict walk with as many shards as it takes."""
    cuts, room = -1, capacity
    for k, cell in enumerate(cells):
        if cell.size > room:
            cuts, room = cuts + 1, capacity
            if cuts == i:
                return k
        room -= min(room, cell.size)
    return len(cells) - 1


def _open(sizes: DataFrame, cells: list[Cell], bits: int) -> list[Cell]:
    """The cells' parts that aren't empty: (range, bytes, whether it is one hash); a job for each width of cell."""
    opened = []
    for span in {c.high - c.low for c in cells}:
        step = span.bit_length() - 1
        width = max(0, step - bits)
        rows = sizes
        if step < 64:
            wanted = sizes.sparkSession.createDataFrame([(c.low >> step,) for c in cells if c.high - c.low == span], "__cell long")
            rows = sizes.join(F.broadcast(wanted), F.shiftrightunsigned("h", step) == F.col("__cell"), "left_semi")
        found = (
            rows.groupBy(F.shiftrightunsigned("h", width).alias("part"))
            .agg(F.sum("size").alias("size"), (F.min("h") == F.max("h")).alias("whole"))
            .collect()
        )
        for r in found:
            low = r["part"] % (1 << 64) << width
            opened.append(Cell(low, low + (1 << width), r["size"], r["whole"]))
    return opened


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shard(
    docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text", rows_a_task: int | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard for every row."""
    binary = F.col("text").cast("binary")
    rows = kept(
        texts(docs, doc_id, text).select(
            "doc_id",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.crc32(binary).alias("text_crc32"),
            F.xxhash64(binary, F.octet_length("text")).alias("h"),
        )
    )
    groups = kept(rows.groupBy("h").agg(F.sum("size").alias("size")))
    # Order of unsigned numbers: the sign bit turned.
    turned = F.col("h").bitwiseXOR(F.lit(_signed(1 << 63)))
    number = F.lit(0)
    for low in boundaries(groups, n_shards):
        number = number + (turned >= F.lit(_signed(low) ^ _signed(1 << 63))).cast("int")
    placed = rows.withColumn("shard", number)
    return ordinals(placed, ["shard"], [F.col("doc_id"), F.col("h")], "slot", rows_a_task).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
