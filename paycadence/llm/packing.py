"""Packs documents into sequences of a fixed number of tokens by the sum-of-squares rule.

Each document becomes token ids and an end mark; one longer than a sequence is cut into full
pieces and a rest. A task packs the pieces of one bucket, the largest first: a piece goes to the
open sequence (or a new one) after which the squared counts of open sequences per free length
add up to the least; ties go to the tightest fit.

``pack`` deals pieces to buckets by a hash; ``pack_in_order`` packs ranges of the rows' order in
their files, so that an order such as the mix's decides which rows share sequences.

Null text counts as empty and yields one piece, the end mark. Repeated rows are packed one by
one. Buckets hold about ``pieces_a_task`` pieces by a hash of id, piece and content; a bucket
needs memory for its own rows only, and nothing else of a row travels but numbers.
"""

from __future__ import annotations

import array
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, kept, small_batches, texts
from .first_fit import byte_of

#: Words and their ids that a worker remembers in each of two generations.
REMEMBERED = 500_000
SEPARATORS = re.compile("[\x1c-\x1f]")
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|#$%&*()\"]*)")
#: Longer words go to the library itself.
LONG_WORD = 1_000
#: The byte that ends a word below: no letter has it.
END = b"\n"


class WordTokenizer:
    """A word tokenizer of the ``tokenizers`` library, with a memory of the ids of words.

    Valid for tokenizers that drop white space, encode what stands between alone, and split
    letters from punctuation, with an end-of-word mark in their vocabulary. Words of plain
    letters are merged by a faster library: ids ascend with the order of merges there, so they are
    the ranks of their byte strings, the end of a word being a byte of its own.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        added = {t.content for t in self.plain.get_added_tokens_decoder().values()}
        of, ranks = byte_of(), {}
        for token, i in self.plain.get_vocab(with_added_tokens=False).items():
            if token not in added:
                word = token.removesuffix("</w>")
                ranks[bytes(of[c] for c in word) + (END if word != token else b"")] = i
        merge = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        marks = Remembered(self.one, REMEMBERED)

        def make(chunk: str) -> bytes:
            cut = PLAIN.fullmatch(chunk)
            if cut is None or len(chunk) > LONG_WORD:
                return self.one(chunk)
            word = array.array("I", merge(cut[1].lower() + "\n")).tobytes()
            return word + marks.of([cut[2]])[0] if cut[2] else word

        self.known = Remembered(make, REMEMBERED)

    def one(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        # Python takes U+001C to U+001F for white space, the tokenizers don't.
        split = [re.split("[ \n]+", t) if SEPARATORS.search(t) else t.split() for t in batch]
        return [b"".join(self.known.of(x)) for x in split]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process: its memory outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def pieces(
    docs: DataFrame, path: str, size: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row, and the columns ``also``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<start:long,length:long,ids_crc32:long>>")
    def cut(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, mark = tokenizer(path), np.array([end], "<u4").tobytes()
        for column in columns:
            out = []
            for raw in encoder.encode(column.tolist()):
                raw += mark
                n = len(raw) // 4
                out.append([(a, min(size, n - a), zlib.crc32(raw[4 * a : 4 * (a + size)])) for a in range(0, n, size)])
            yield pd.Series(out)

    rows = texts(docs, doc_id, text) if not also else docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *also
    )
    return rows.select("doc_id", F.posexplode(cut("text")).alias("piece", "x"), *also).select(
        "doc_id", "piece", "x.start", "x.length", "x.ids_crc32", *also
    )


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the given order."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(size + 1)  # open sequences by free length; full ones and new ones aren't open
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    n = 0
    for i, s in enumerate(lengths.tolist()):
        best, gap = (2 * count[size - s] + 1 if s < size else 0.0), size
        if s < size:
            was = count[s:size]
            there = np.flatnonzero(was)
            if len(there):
                change = 2 * (count[there] - was[there]) + 2
                if there[0] == 0:
                    change[0] = 1 - 2 * was[0]
                k = int(np.argmin(change))
                if change[k] <= best:
                    gap = int(there[k]) + s
        if gap == size:
            at, n = n, n + 1
        else:
            at = open_[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = at, size - gap
        if gap > s:
            open_[gap - s].append(at)
            count[gap - s] += 1
    return where, offset


def _packed(numbered: DataFrame, size: int, length: str, prefix: str) -> DataFrame:
    """Adds <prefix>sequence and <prefix>offset, packing each ``__bucket`` by itself."""
    schema = ", ".join(f"`{c}` {t}" for c, t in numbered.dtypes) + f", `{prefix}sequence` long, `{prefix}offset` long"

    def pack(group: pa.Table) -> pa.Table:
        sizes = group.column(length).to_numpy()
        order = np.argsort(-sizes, kind="stable")
        where, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        where[order], offset[order] = sum_of_squares(sizes[order], size)
        where += int(group.column("__bucket")[0].as_py()) << 32
        return group.append_column(f"{prefix}sequence", pa.array(where)).append_column(f"{prefix}offset", pa.array(offset))

    return numbered.groupBy("__bucket").applyInArrow(pack, schema).drop("__bucket")


def pack(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    end: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    pieces_a_task: int = 50_000,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    rows = kept(pieces(docs, path, size, end, doc_id, text))
    buckets = max(1, -(-rows.count() // pieces_a_task))
    return _named(_packed(rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))), size, "length", ""))


def _named(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset"
    )


def pack_in_order(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    end: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    pieces_a_range: int = 4_000,
    rows_a_block: int = 500,
) -> DataFrame:
    """As ``pack``, but over ranges of the rows as they stand in files: sequence ids ascend with the ranges.

    ``docs`` is read from Parquet files written in the order of their part numbers. A range is
    made of whole blocks of ``rows_a_block`` rows of a file: those that begin among its
    ``pieces_a_range`` pieces. Nothing is collected.
    """
    number = F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as long)"), F.lit(0))
    placed = docs.select(
        F.col(doc_id).alias("__doc_id"),
        F.col(text).alias("__text"),
        F.struct(number.alias("part"), F.col("_metadata.file_path").alias("file"), F.expr(f"_metadata.row_index div {rows_a_block}").alias("block")).alias("__at"),
    )
    rows = kept(pieces(placed, path, size, end, "__doc_id", "__text", ("__at",)))
    # Pieces before a file (one row for each file), and before a block of it (one task for each file's blocks).
    blocks = rows.groupBy("__at").agg(F.count(F.lit(1)).alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy(F.struct("__at.part", "__at.file").alias("file")).agg(F.sum("n").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(before.orderBy("file")), F.lit(0)).alias("first"))
    within = F.sum("n").over(before.partitionBy("__at.part", "__at.file").orderBy("__at.block"))
    blocks = blocks.withColumn("within", F.coalesce(within, F.lit(0)))
    of = blocks.join(files, (F.col("__at.part") == F.col("file.part")) & (F.col("__at.file") == F.col("file.file"))).select(
        F.col("__at").alias("__place"), F.expr(f"(first + within) div {pieces_a_range}").alias("__bucket")
    )
    numbered = rows.join(of, F.col("__at") == F.col("__place")).drop("__at", "__place")
    return _named(_packed(numbered, size, "length", ""))
