"""Removes bytes that a document shares with an earlier one: common substrings of ``LENGTH`` bytes.

A suffix array of all texts, cut at ``LENGTH`` bytes, would put equal windows side by side. As in
external induced sorting, only sampled suffixes are sorted, and the rest is induced from them:

1. Sampled positions: of each window's runs of ``GRAM`` bytes the one of the least hash. Equal
   windows sample the same run, so a run's hash is where their suffix tuples meet. A sampled
   position stands for all windows that chose it, a stretch of starts; its name is the hash of
   the bytes they cover, its common-prefix value is implied by equal names.
2. Tuples (run, name, document) are sorted externally: tasks send them in packed blocks to
   buckets of runs. Equal names of a later document: every window of the stretch is removed.
   Before they are sent, tuples of equal names are reduced to the first document's in each
   block; so a passage of a third of all texts reaches its bucket once for each block. Tuples of
   a hot run, one of a frequent line in many contexts, go to buckets by their names instead.
3. Recursion: where names differ under one run, windows may still be equal in part. Those whose
   middle bytes agree (a check of a byte for each quarter of the stretch) go on as tuples of one
   window each, sorted in the same way in buckets of windows. Of a hot run all quarters go on.

Between the steps a document's verdicts come back to it by id, and its positions are computed
anew rather than stored. Names have 64 bits beside the run's 32 and its bucket's.

Null texts count as empty; texts below ``LENGTH`` bytes lose nothing. A row with a null id is
neither compared nor cut. Rows of one id are not earlier than each other. Texts longer than
``SEGMENT`` are worked on in overlapping segments, whole; names cut by a segment's end are
settled in step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts
from .neardup import ODD, mixed

LENGTH, GRAM = 50, 20
#: Window starts in a segment of a text, and bytes that are worked on together.
SEGMENT, CHUNK = 1 << 20, 1 << 20
QUARTER = 8
#: Text bytes for which a bucket is opened: at least, and at most (a bucket is sorted in memory).
BUCKET_BYTES = 12 << 20, 256 << 20
#: Text bytes for each part of the sample that finds hot runs.
SAMPLE_BYTES = 4 << 20

BLOCK = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("block", pa.binary())])


class Positions:
    """Windows and sampled positions of some texts; all are arrays over sampled positions but ``window``."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        """``pieces``: row number, start in its text, bytes of a segment."""
        raw = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8).astype(np.uint64)
        self.sizes = sizes = np.array([len(p[2]) for p in pieces])
        end = np.repeat(np.cumsum(sizes), sizes)
        powers = {1: mixed(raw + np.uint64(1))}
        for k in (1, 2, 4, 8, 16):
            powers[2 * k] = self._join(powers[k][:-k], powers[k][k:]) if len(powers[k]) > k else powers[k][:0]
        self._powers = {k: powers[k] for k in (16, 32)}
        gram, self.window = self.hashes(GRAM), self.hashes(LENGTH)
        self.piece_of = np.repeat(np.arange(len(pieces)), sizes)
        self.row = np.array([p[0] for p in pieces], np.int64)
        # Where in its text a joined place lies.
        self.shift = np.array([p[1] for p in pieces], np.int64) - (np.cumsum(sizes) - sizes)
        n = max(0, len(raw) - LENGTH + 1)
        least, at, span = gram, np.arange(len(gram)), 1
        width = LENGTH - GRAM + 1
        while span < width and n:
            step = min(span, width - span)
            other = least[step:] < least[: len(least) - step]
            at = np.where(other, at[step:], at[: len(at) - step])
            least = np.where(other, least[step:], least[: len(least) - step])
            span += step
        starts = np.arange(n)
        starts = starts[starts + LENGTH <= end[:n]] if n else starts
        chosen = at[starts] if n else starts
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        self.first = starts[head]
        self.last = starts[np.append(head[1:], len(starts)) - 1] if len(head) else starts
        self.at = chosen[head]
        run = mixed(gram[self.at] + np.uint64(1)) if len(head) else gram[:0]
        self.run = run
        low, high = (self.at - self.last).astype(np.uint64), (self.at - self.first).astype(np.uint64)
        self.name = mixed(self._join(self.window[self.first], self.window[self.last]) + low * np.uint64(64) + high)

    @staticmethod
    def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(a * ODD + b)

    def hashes(self, length: int) -> np.ndarray:
        """Of every run of so many bytes (16 to 64), from two that overlap."""
        half = 16 if length <= 32 else 32
        a, gap = self._powers[half], length - half
        return self._join(a[: len(a) - gap], a[gap:]) + np.uint64(length) if len(a) > gap else a[:0]

    def checks(self) -> np.ndarray:
        """For each quarter of the possible starts a byte from what all its windows cover; 0 without windows there."""
        width = LENGTH - GRAM + 1
        core = self.hashes(LENGTH - QUARTER + 1)
        out = np.zeros((len(self.at), -(-width // QUARTER)), np.uint8)
        for q in range(out.shape[1]):
            there = (self.at - self.first >= q * QUARTER) & (self.at - self.last < (q + 1) * QUARTER)
            out[there, q] = core[self.at[there] - q * QUARTER] % np.uint64(255) + np.uint64(1)
        return out

    def rows(self) -> np.ndarray:
        """Row number of each sampled position."""
        return self.row[self.piece_of[self.at]] if len(self.at) else self.at

    def windows(self, which: np.ndarray, quarters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of some positions, and each one's position; only in the marked quarters."""
        which_, starts = self.spread(which)
        q = (self.at[which_] - starts) // QUARTER
        mark = np.repeat(quarters, self.last[which] - self.first[which] + 1)
        keep = (mark >> q) & 1 == 1
        return starts[keep], which_[keep]

    def pieces(self) -> Iterator[tuple[int, int, int, int]]:
        """Row number, joined start and end, and shift to the text's own places of each piece."""
        ends = np.cumsum(self.sizes)
        yield from zip(self.row.tolist(), (ends - self.sizes).tolist(), ends.tolist(), self.shift.tolist())

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.last[which] - self.first[which] + 1
        owner = np.repeat(which, n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return owner, self.first[owner] + inside


def segments(row: int, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    for a in range(0, max(1, len(raw) - LENGTH + 1), SEGMENT):
        yield row, a, raw[a : a + SEGMENT + LENGTH - 1]


def chunks(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()) -> Iterator[tuple[list, list[bytes], list]]:
    """Ids, texts and further columns of rows, up to CHUNK bytes (or one row) together."""
    ids, raws, more, size = [], [], [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in extra]
        for i, (d, t) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("raw"))):
            raw = t.as_py() or b""
            if ids and size + len(raw) > CHUNK:
                yield ids, raws, more
                ids, raws, more, size = [], [], [], 0
            ids.append(d)
            raws.append(raw)
            more.append(tuple(c[i] for c in columns))
            size += len(raw)
    if ids:
        yield ids, raws, more


def in_groups(ids: list, raws: list[bytes]) -> Iterator[Positions]:
    """Positions of the rows with an id and a window, about CHUNK bytes at a time."""
    group, size = [], 0
    for i, raw in enumerate(raws):
        if ids[i] is None or len(raw) < LENGTH:
            continue
        for piece in segments(i, raw):
            if group and size + len(piece[2]) > CHUNK:
                yield Positions(group)
                group, size = [], 0
            group.append(piece)
            size += len(piece[2])
    if group:
        yield Positions(group)


TUPLE = np.dtype([("run", "<u4"), ("name", "<u8"), ("doc", "<i8"), ("check", "<u4")])
#: Columns of a block, one after the other: of first tuples in steps 2 and 3, and of tuples that lost.
CHECKED, UNCHECKED, LOST = ("run", "name", "doc", "check"), ("run", "name", "doc"), ("name", "doc")


def to_block(t: np.ndarray, columns: tuple[str, ...]) -> bytes:
    return b"".join(np.ascontiguousarray(t[c]).tobytes() for c in columns)


def from_block(raw: bytes, columns: tuple[str, ...]) -> np.ndarray:
    n, at = len(raw) // sum(TUPLE[c].itemsize for c in columns), 0
    t = np.zeros(n, TUPLE)
    for c in columns:
        t[c] = np.frombuffer(raw, TUPLE[c], n, at)
        at += n * TUPLE[c].itemsize
    return t


def firsts(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tuples sorted by run, name and document; which are the first of their name; and the name's first document."""
    t = t[np.lexsort((t["doc"], t["name"], t["run"]))]
    new = np.ones(len(t), bool)
    new[1:] = (t["run"][1:] != t["run"][:-1]) | (t["name"][1:] != t["name"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    return t, new, t["doc"][head]


def sent(run: np.ndarray, name: np.ndarray, doc: np.ndarray, check: np.ndarray | None, buckets: int, hot: np.ndarray) -> pa.RecordBatch:
    """Blocks for the buckets: first tuples (part 0; of runs in ``hot``, part 2), and those that lose to them here already (part 1).

    Without ``check`` (step 3), and for runs in ``hot`` (sorted), buckets go by name: only equal names
    need to meet there. Those that lose go by their documents, so that a frequent name doesn't fill one.
    Inside a block tuples stand by document, so that this column compresses to nearly nothing.
    """
    t = np.empty(len(run), TUPLE)
    t["run"], t["name"], t["doc"], t["check"] = run & np.uint64(0xFFFFFFFF), name, doc, 0 if check is None else check
    spread = np.ones(len(run), bool) if check is None else member(run, hot)
    key = np.where(spread, mixed(name + ODD), run)
    to = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    # Which bucket, and whether by a hot run: equal names agree in both, so sorting inside sorts all.
    to = to * 2 + (spread if check is not None else 0)
    order = np.lexsort((t["doc"], t["name"], t["run"], to))
    t, to = t[order], to[order]
    new = np.ones(len(t), bool)
    new[1:] = (to[1:] != to[:-1]) | (t["run"][1:] != t["run"][:-1]) | (t["name"][1:] != t["name"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    late = t[t["doc"] > t["doc"][head]]
    keep, to = t[new], to[new]
    order = np.lexsort((keep["doc"], to))
    keep, to = keep[order], to[order]
    heads = np.flatnonzero(np.diff(to, prepend=-1))
    columns = UNCHECKED if check is None else CHECKED
    rows = [(int(to[a]) // 2, int(to[a]) % 2 * 2, to_block(keep[a:b], columns)) for a, b in zip(heads, np.append(heads[1:], len(to)))]
    if len(late):
        late = late[np.argsort(late["doc"], kind="stable")]
        rows.append((int(mixed(late["doc"][:1].astype(np.uint64))[0] % np.uint64(buckets)), 1, to_block(late, LOST)))
    return pa.RecordBatch.from_pydict(dict(zip(BLOCK.names, map(list, zip(*rows)))) if rows else {n: [] for n in BLOCK.names}, schema=BLOCK)


VERDICT = "doc_id long, name long, quarters int"


def settled(recurse: bool):
    """For a bucket: (document, name, -1) to remove; with ``recurse`` (document, name, marked quarters) to look into."""

    def settle(table: pa.Table) -> pa.Table:
        parts = {0: [], 1: [], 2: []}
        for part, block in zip(table.column("part").to_pylist(), table.column("block")):
            parts[part].append(from_block(block.as_py(), LOST if part == 1 else CHECKED if recurse else UNCHECKED))
        none = np.zeros(0, TUPLE)
        t, new, first = firsts(np.concatenate(parts[0] or [none]))
        hot, new_hot, first_hot = firsts(np.concatenate(parts[2] or [none]))
        late = np.concatenate([t[t["doc"] > first], hot[hot["doc"] > first_hot], *parts[1]])
        doc, name, marks = late["doc"], late["name"], np.full(len(late), -1, np.int32)
        if recurse:
            t = t[new]
            found = np.zeros(len(t), np.int32)
            for q in range(4):
                check = (t["check"] >> np.uint32(8 * q)) & np.uint32(255)
                key = t["run"].astype(np.uint64) * np.uint64(256) + check
                _, back, n = np.unique(key, return_inverse=True, return_counts=True)
                found |= ((n[back] > 1) & (check > 0)).astype(np.int32) << q
            # A hot run's names are in many buckets: all their quarters are looked into.
            hot = hot[new_hot]
            every = np.zeros(len(hot), np.int32)
            for q in range(4):
                every |= ((hot["check"] >> np.uint32(8 * q)) & np.uint32(255) > 0).astype(np.int32) << q
            t, found = np.concatenate([t, hot]), np.concatenate([found, every])
            open_ = found > 0
            doc, name, marks = (np.concatenate(x) for x in ((doc, t["doc"][open_]), (name, t["name"][open_]), (marks, found[open_])))
        return pa.table({"doc_id": doc.astype(np.int64), "name": np.ascontiguousarray(name).view(np.int64), "quarters": marks})

    return settle


def removed_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row; ids are integers.

    A bucket is opened for ``bucket_bytes`` of text, by default a 512th within ``BUCKET_BYTES``.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    total = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    bucket_bytes = bucket_bytes or min(max(total // 512, BUCKET_BYTES[0]), BUCKET_BYTES[1])
    buckets = max(8, -(-total // bucket_bytes))
    hot = hot_runs(rows, total, bucket_bytes)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws, _ in chunks(batches):
            number = np.array([-1 if d is None else d for d in ids], np.int64)
            for p in in_groups(ids, raws):
                if len(p.at):
                    check = np.ascontiguousarray(p.checks()).view("<u4")[:, 0]
                    yield sent(p.run, p.name, number[p.rows()], check, buckets, hot)

    schema = "bucket int, part int, block binary"
    named = rows.mapInArrow(sample, schema).groupBy("bucket").applyInArrow(settled(True), VERDICT)
    verdicts = named.groupBy("doc_id").agg(F.collect_list(F.struct("name", "quarters")).alias("names"))
    verdicts = verdicts.select(
        F.col("doc_id").alias("id1"),
        F.transform(F.filter("names", lambda x: x["quarters"] < 0), lambda x: x["name"]).alias("gone"),
        F.transform(F.filter("names", lambda x: x["quarters"] >= 0), lambda x: x["name"]).alias("open"),
        F.transform(F.filter("names", lambda x: x["quarters"] >= 0), lambda x: x["quarters"]).alias("marks"),
    )
    known = rows.join(verdicts, F.col("doc_id") == F.col("id1"), "left")

    def look_into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws, more in chunks(batches, ("open", "marks")):
            some = [i for i, (names, _) in enumerate(more) if names]
            number = np.array([-1 if d is None else d for d in ids], np.int64)
            keys, marks = pairs([more[i][0] for i in some], some), np.concatenate([[], *(more[i][1] for i in some)]).astype(np.int64)
            order = np.argsort(keys)
            keys, marks = keys[order], marks[order]
            chosen = set(some)
            for p in in_groups([d if i in chosen else None for i, d in enumerate(ids)], raws):
                own = p.name ^ salt(p.rows())
                which = np.flatnonzero(member(own, keys))
                place = np.searchsorted(keys, own[which])
                starts, owner = p.windows(which, marks[place])
                if len(starts):
                    yield sent(mixed(p.run[owner]), p.window[starts], number[p.rows()[owner]], None, buckets, hot)

    single = known.mapInArrow(look_into, schema).groupBy("bucket").applyInArrow(settled(False), VERDICT)
    late = single.groupBy("doc_id").agg(F.collect_list("name").alias("late")).withColumnRenamed("doc_id", "id2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws, more in chunks(batches, ("gone", "open", "late")):
            # Single windows that lost belong to positions that were looked into.
            gone, opened, windows = (pairs([m[k] or [] for m in more], range(len(more)), ordered=True) for k in (0, 1, 2))
            covered = [np.zeros(len(raw), bool) for raw in raws]
            for p in in_groups([d if m[0] or m[2] else None for d, m in zip(ids, more)], raws):
                own = p.name ^ salt(p.rows())
                lost = member(own, gone)
                _, starts = p.spread(np.flatnonzero(lost))
                owner, single = p.spread(np.flatnonzero(member(own, opened) & ~lost))
                hit = member(p.window[single] ^ salt(p.rows()[owner]), windows)
                starts = np.concatenate([starts, single[hit]])
                edge = np.bincount(starts, minlength=len(p.piece_of) + 1) - np.bincount(starts + LENGTH, minlength=len(p.piece_of) + 1)
                inside = np.cumsum(edge[:-1]) > 0
                for row, a, b, shift in p.pieces():
                    covered[row][a + shift : b + shift] |= inside[a:b]
            out = []
            for d, raw, gone_here in zip(ids, raws, covered):
                spans = int(np.count_nonzero(np.diff(gone_here.astype(np.int8), prepend=0) == 1))
                rest = np.frombuffer(raw, np.uint8)[~gone_here].tobytes() if spans else raw
                out.append((d, len(raw), int(gone_here.sum()), spans, hashlib.sha256(rest).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=RESULT)

    judged = known.join(late, F.col("doc_id") == F.col("id2"), "left").select("doc_id", "raw", "gone", "open", "late")
    return judged.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def hot_runs(rows: DataFrame, total: int, bucket_bytes: int) -> np.ndarray:
    """Runs, sorted, that would have over a 16th of a bucket's tuples, by a sample of the documents.

    They decide only where tuples meet, not the result. There are at most some 16 for each bucket.
    """
    share = max(1, min(32, total // SAMPLE_BYTES))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(share)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws, _ in chunks(batches):
            for p in in_groups(ids, raws):
                run, n = np.unique(p.run, return_counts=True)
                yield pa.RecordBatch.from_pydict({"run": run.view(np.int64), "n": n.astype(np.int64)})

    most = bucket_bytes / 16 / 16 / share
    found = sample.mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    return np.sort(np.array([r["run"] for r in found.select("run").collect()], np.int64).view(np.uint64))


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def salt(rows: np.ndarray) -> np.ndarray:
    """Tells equal names of different rows apart."""
    return mixed(rows.astype(np.uint64) + np.uint64(17))


def pairs(names: list[list[int]], rows, ordered: bool = False) -> np.ndarray:
    """Names with their rows' salt, as one array."""
    sizes = [len(x) for x in names]
    flat = np.fromiter((v for x in names for v in x), np.int64, sum(sizes)).view(np.uint64)
    out = flat ^ salt(np.repeat(np.array(list(rows), np.int64), sizes))
    return np.sort(out) if ordered else out


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x
