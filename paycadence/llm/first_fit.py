"""Packs documents into sequences by first-fit decreasing, in random groups of documents.

Each document becomes token ids and an end mark. Full stretches of ``size`` ids are sequences of
their own; the rest of each document, less than a sequence, is packed. Documents are dealt to
groups of about ``docs_a_group`` at random (by a hash of id and row number), and each group is packed
by itself: the rests by falling length, each into the first sequence that has room. A tournament
tree of free room finds that sequence in logarithmic time: each inner node holds the larger room of
its two, and sequences not yet begun are leaves of full room.

Documents may be cut, so what first-fit leaves open is then closed: with K = (ids of the group) div
``size``, the K fullest sequences stay and are filled up from the others, which are taken apart,
largest rest first; what is left over is laid into sequences whose lengths are powers of two, one
for each binary digit of its length. These need no padding by the rule (a sequence is padded to
``size`` unless its length is a power of two), so no sequence does. About one document in a
sequence that first-fit left open is cut once more.

Ids travel as 16-bit numbers (32-bit ones for vocabularies that need them), less than one sequence
of them for each document, with a checksum for each full stretch. Null text counts as empty and
gives the end mark alone. Repeated rows and rows of one id are packed one by one, spread over
groups. Very long texts are full stretches but for their end; a group holds the memory of its
own rests. An empty table gives no rows.
"""

from __future__ import annotations

import array
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, small_batches, texts

# How byte-level vocabularies split text, and the bytes that stand for themselves in their files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))

#: Spaces and line feeds with what follows them: between two of these a text can be cut, if it holds no other white space.
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
REMEMBERED = 500_000

#: Runs of one kind of character beyond which text goes to the slower library, whose time stays linear.
LONG_RUN = 4_000


def byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: the others are counted on from U+0100."""
    rest = [b for b in range(256) if b not in PLAIN_BYTES]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """The ids of a byte-level BPE tokenizer's file, by a faster library that holds the same vocabulary.

    Ids of such a file ascend with the order of merges, so they are the ranks of their byte
    strings. Texts that hold an added token's string go through ``tokenizers`` itself. The ids
    of words are remembered, as bytes of numbers of ``width``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        vocabulary = self.plain.get_vocab(with_added_tokens=False)
        of = byte_of()
        ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items() if t not in self.added}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long = regex.compile(rf"\s{{{LONG_RUN}}}|\p{{L}}{{{LONG_RUN}}}|\p{{N}}{{{LONG_RUN}}}|[^\s\p{{L}}\p{{N}}]{{{LONG_RUN}}}")
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        known = declared["pre_tokenizer"]["type"] == "ByteLevel" and declared["normalizer"] is None
        self.same = known and not declared["pre_tokenizer"].get("add_prefix_space") and declared["pre_tokenizer"].get("use_regex", True)
        self.width = "<u2" if self.plain.get_vocab_size() <= 1 << 16 else "<u4"
        code, fast = "H" if self.width == "<u2" else "I", self.fast.encode_ordinary
        self.known = Remembered(lambda chunk: array.array(code, (fast if len(chunk) < LONG_RUN else self.one)(chunk)).tobytes(), REMEMBERED)

    def one(self, text: str) -> list[int]:
        return self.plain.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """The ids of the text, little-endian numbers of ``width``."""
        if not self.same or any(t in text for t in self.added):
            return np.array(self.one(text), self.width).tobytes()
        if any(c in text for c in OTHER_SPACE):
            long = len(text) >= LONG_RUN and self.long.search(text)
            return np.array((self.one if long else self.fast.encode_ordinary)(text), self.width).tobytes()
        return b"".join(self.known.of(CHUNK.findall(text)))


_LOADED: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]


def first_fit(lengths: list[int], size: int) -> list[int]:
    """The sequence of each length, in the given order: the first one with room."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [size] * (2 * leaves)
    where = []
    for s in lengths:
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < s:
                i += 1
        where.append(i - leaves)
        room[i] -= s
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
    return where


def pack_rests(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (rest, from, length): first-fit decreasing, then closed by cutting. ``lengths`` fall."""
    sequences: list[list[tuple[int, int, int]]] = []
    for i, at in enumerate(first_fit(lengths, size)):
        while at >= len(sequences):
            sequences.append([])
        sequences[at].append((i, 0, lengths[i]))
    load = [sum(p[2] for p in s) for s in sequences]
    order = sorted(range(len(sequences)), key=lambda b: (-load[b], b))
    full, left = divmod(sum(load), size)
    out = [sequences[b] for b in order[:full]]
    loose = sorted((p for b in order[full:] for p in sequences[b]), key=lambda p: p[2])  # the largest is taken first
    wanted = [(s, size - load[b]) for s, b in zip(out, order)]
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            out.append([])
            wanted.append((out[-1], 1 << bit))
    for sequence, need in wanted:
        while need:
            i, start, n = loose.pop()
            take = min(n, need)
            sequence.append((i, start, take))
            need -= take
            if take < n:
                loose.append((i, start + take, n - take))
    return out


def pack(
    docs: DataFrame,
    path: str,
    size: int = 1024,
    end: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    docs_a_group: int = 4096,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""
    small_batches(docs.sparkSession)
    rows = texts(docs, doc_id, text)
    groups = max(1, -(-docs.count() // docs_a_group))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)).alias("__group"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            tokens, full, rest = [], [], []
            for text_ in batch.column(2).to_pylist():
                ids = np.frombuffer(encoder.encode(text_) + np.array([end], encoder.width).tobytes(), encoder.width)
                whole = len(ids) // size * size
                tokens.append(len(ids))
                full.append([zlib.crc32(ids[a : a + size].astype("<u4").tobytes()) for a in range(0, whole, size)])
                rest.append(ids[whole:].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array([encoder.width] * len(tokens))],
                ["doc_id", "__group", "doc_tokens", "full", "rest", "width"],
            )

    encoded = dealt.mapInArrow(encode, f"doc_id {kind}, __group long, doc_tokens long, full array<long>, rest binary, width string")

    def lay(group: pa.Table) -> pa.Table:
        width = group.column("width")[0].as_py()
        tokens, full = group.column("doc_tokens").to_pylist(), group.column("full").to_pylist()
        rest = [np.frombuffer(x, width).astype("<u4") for x in group.column("rest").to_pylist()]
        base = group.column("__group")[0].as_py() << 32
        sums = [zlib.crc32(x.tobytes()) for x in rest]
        order = sorted((i for i in range(len(rest)) if len(rest[i])), key=lambda i: (-len(rest[i]), sums[i], tokens[i]))
        at, start, length, crc, sequence, offset = [], [], [], [], [], []
        n = 0
        for laid in pack_rests([len(rest[i]) for i in order], size):
            place = 0
            for i, a, m in laid:
                i = order[i]
                at.append(i)
                start.append(tokens[i] - len(rest[i]) + a)
                length.append(m)
                crc.append(sums[i] if m == len(rest[i]) else zlib.crc32(rest[i][a : a + m].tobytes()))
                sequence.append(base + n)
                offset.append(place)
                place += m
            n += 1
        for i, checks in enumerate(full):
            at += [i] * len(checks)
            start += range(0, size * len(checks), size)
            length += [size] * len(checks)
            crc += checks
            sequence += range(base + n, base + n + len(checks))
            offset += [0] * len(checks)
            n += len(checks)
        long = lambda values: pa.array(values, pa.int64())
        ids = group.column("doc_id").take(long(at))
        return pa.table(
            {"doc_id": ids, "start": long(start), "length": long(length), "ids_crc32": long(crc), "doc_tokens": long([tokens[i] for i in at]), "sequence_id": long(sequence), "offset": long(offset)}
        )

    columns = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return encoded.groupBy("__group").applyInArrow(lay, f"doc_id {kind}, {columns}")
