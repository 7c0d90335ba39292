"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

Base spans follow four patterns with their checks (``base_spans``). The random field works on
stretches: neighbouring chunks that hold a digit or an at sign, with any white space and lone
separators between them, cut into atoms (runs of letters and digits, runs of white space, or
single other characters). A candidate segment is up to ``MAX_ATOMS`` atoms with one type, at
least ``LEAST_DIGITS`` digits or an at sign and, without one, at most ``MOST_DIGITS`` digits;
features of the whole segment (its shape, digit count, checksum, octets, separators, neighbours)
and of the transition between types score it, and a dynamic program over atoms chooses
boundaries and types jointly. It is trained by likelihood (semi-Markov forward and backward
sums) on a bounded sample of stretches drawn by kind, where the base spans are the labels; so it
generalises their formats to spans that break a pattern in a detail. A decoded span that
overlaps no base span is added; base spans always stay.

A stretch without a candidate is not searched, as it has no span but a base one. The dynamic
program keeps the scores of the last ``MAX_ATOMS`` atoms and two small numbers for each atom and
type, so time and memory are linear in the text's length; a text is never cut. Null text counts
as empty and has no spans. Repeated rows are judged one by one. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, small_batches, texts

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
MAX_ATOMS = 24
#: Digits of a candidate without an at sign; cards, the longest kind, have 19.
LEAST_DIGITS, MOST_DIGITS = 4, 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits, with three more behind dots if they are there. Taking every run keeps it linear.
QUAD = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEED = re.compile(r"[0-9@]")
#: Chunks with a digit or an at sign; between two of them white space and chunks of one to three separators.
STRETCH = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\s++(?:[^\w\s@]{1,3}+\s++)*+[^\s0-9@]*+[0-9@]\S*+)*+")
ATOM = re.compile(r"[^\W_]+|\s+|.", re.S)
SPACE = re.compile(r"\s+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    """Four dotted numbers, each at most 255 (zeros in front don't count)."""
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() for p in parts):
        return False
    numbers = [p.lstrip("0") for p in parts]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in numbers)


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns, by kind and start."""
    found: list[Span] = []
    if not SEED.search(text):
        return found
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    found += [(1, *m.span()) for m in QUAD.finditer(text) if "." in m[0] and octets(m[0])]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where entities may be."""
    for m in STRETCH.finditer(text):
        if "@" in m[0] or sum(map(m[0].count, "0123456789")) >= LEAST_DIGITS:
            yield m.span()


def _class(c: str) -> str:
    return "^" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


RUNS = re.compile(r"[0-9]+|[^\W\d_]+")


def segment_features(text: str, left: str, right: str) -> list[str]:
    """What the whole candidate segment shows. White space of any length and kind counts as one space."""
    text = SPACE.sub(" ", text)
    digits = "".join(c for c in text if "0" <= c <= "9")
    shape = RUNS.sub(lambda m: "D" if m[0][0].isdigit() else "a", text)
    name, _, host = text.partition("@")
    return [
        "seg",
        f"shape {shape[:24]}",
        f"digits {min(len(digits), 20)}",
        f"sum {13 <= len(digits) <= 19 and luhn(digits)} {'@' in text}",
        f"quad {octets(text)}",
        f"mail {text.count('@')} {'.' in host} {bool(name)} {' ' in text}",
        f"left {_class(left)}",
        f"right {_class(right)}",
        f"plus {text[0] == '+'} {min(len(digits), 16)}",
        f"marks {''.join(sorted(set(shape) - set('Da')))[:8]}",
    ]


@dataclass
class Field:
    """Weights of (feature, type) and of (type before, type); small, so it travels with the tasks."""

    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((OTHER + 1, OTHER + 1)))


Segment = tuple[int, int, tuple[int, ...], list[str]]  # first atom, atom after, types, features


def segments(text: str, cuts: list[int], left: str, right: str) -> Iterator[Segment]:
    """The candidates by first atom, one after the other: each atom by itself, then entities from it on."""
    n = len(cuts) - 1
    for i in range(n):
        head = text[cuts[i]]
        before = text[cuts[i] - 1] if i else left
        yield i, i + 1, (OTHER,), ["atom " + _class(head) + _class(before)]
        if not (head.isalnum() or head in "+("):
            continue
        digits, at_sign = 0, False
        for j in range(i + 1, min(n, i + MAX_ATOMS) + 1):
            atom = text[cuts[j - 1] : cuts[j]]
            digits += sum(map(atom.count, "0123456789"))
            at_sign = at_sign or atom == "@"
            if atom[-1].isalnum() and (at_sign or LEAST_DIGITS <= digits <= MOST_DIGITS):
                shown = segment_features(text[cuts[i] : cuts[j]], before, text[cuts[j]] if j < n else right)
                yield i, j, (0,) if at_sign else (1, 2, 3), shown


def atoms(text: str) -> list[int]:
    """Where atoms start, and the end."""
    return [m.start() for m in ATOM.finditer(text)] + [len(text)]


def candidates(text: str, left: str, right: str) -> tuple[list[int], list[tuple[int, int, int, list[tuple[str, int]]]]]:
    """``atoms``, and each candidate with each of its types: first atom, atom after, type, features."""
    cuts = atoms(text)
    return cuts, [(i, j, y, [(f, y) for f in shown]) for i, j, kinds, shown in segments(text, cuts, left, right) for y in kinds]


def _scores(model: Field, cands) -> list[float]:
    get = model.weights.get
    return [sum(get(f, 0.0) for f in fs) for _, _, _, fs in cands]


def decode(model: Field, text: str, left: str = "", right: str = "") -> list[Span]:
    """The best segmentation's entities (Viterbi over atoms and types)."""
    cuts = atoms(text)
    n, types, get = len(cuts) - 1, range(OTHER + 1), model.weights.get
    moves = [[float(model.moves[k, y]) for k in types] for y in types]
    nothing = [-np.inf] * (OTHER + 1)
    best: dict[int, list[float]] = {0: [*nothing[:OTHER], 0.0]}  # of the atoms that a candidate can still reach
    # For each place and type: how many atoms the segment that ends there has, and the type before it.
    length, prior = array("b", bytes((n + 1) * (OTHER + 1))), array("b", bytes((n + 1) * (OTHER + 1)))
    at = -1
    for i, j, kinds, shown in segments(text, cuts, left, right):
        if i != at:
            here = best.pop(i)
            came = [max(types, key=lambda k, y=y: here[k] + moves[y][k]) for y in types]
            into = [here[k] + moves[y][k] for y, k in zip(types, came)]
            at = i
        row = best.get(j)
        if row is None:
            row = best[j] = nothing[:]
        for y in kinds:
            value = into[y] + sum(get((f, y), 0.0) for f in shown)
            if value > row[y]:
                row[y] = value
                length[j * (OTHER + 1) + y], prior[j * (OTHER + 1) + y] = j - i, came[y]
    at, y, found = n, max(types, key=best[n].__getitem__), []
    while at:
        place = at * (OTHER + 1) + y
        if y != OTHER:
            found.append((y, cuts[at - length[place]], cuts[at]))
        at, y = at - length[place], prior[place]
    return found[::-1]


def log_sum(x: np.ndarray) -> float:
    top = x.max()
    return top + np.log(np.exp(x - top).sum()) if np.isfinite(top) else -np.inf


def fit(samples: list[tuple[str, str, str]], rounds: int = 6, step: float = 0.5, l2: float = 1e-3) -> Field:
    """``samples``: stretch, character before, character behind. Adagrad ascent on the log likelihood."""
    model = Field()
    data = []
    for text, left, right in samples:
        cuts, cands = candidates(text, left, right)
        place = {c: k for k, c in enumerate(cuts)}
        gold, busy = {}, 0
        for y, a, b in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
            if a >= busy and a in place and b in place:
                gold[place[a]] = (place[b], y)
                busy = b
        have = {(i, j, y): k for k, (i, j, y, _) in enumerate(cands)}
        path, at = [], 0
        while at < len(cuts) - 1:
            j, y = gold.get(at, (at + 1, OTHER))
            if (at, j, y) not in have:
                j, y = at + 1, OTHER
            path.append(have[at, j, y])
            at = j
        cands_order = sorted(range(len(cands)), key=lambda k: cands[k][:3])
        data.append((len(cuts) - 1, cands, cands_order, path))
    size: dict[tuple[str, int], float] = {}
    move_size = np.full_like(model.moves, 1e-2)
    for _ in range(rounds):
        for n, cands, order, path in data:
            s = _scores(model, cands)
            alpha = np.full((n + 1, OTHER + 1), -np.inf)
            alpha[0, OTHER] = 0.0
            for k in order:
                i, j, y, _ = cands[k]
                alpha[j, y] = np.logaddexp(alpha[j, y], log_sum(alpha[i] + model.moves[:, y]) + s[k])
            total = log_sum(alpha[n])
            beta = np.full((n + 1, OTHER + 1), -np.inf)
            beta[n] = 0.0
            grad: dict[tuple[str, int], float] = {}
            move_grad = np.zeros_like(model.moves)
            for k in reversed(order):
                i, j, y, fs = cands[k]
                through = model.moves[:, y] + s[k] + beta[j, y]
                p = np.exp(alpha[i] + through - total)
                beta[i] = np.logaddexp(beta[i], through)
                move_grad[:, y] -= p
                share = p.sum()
                if share > 1e-6:
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) - share
            before = OTHER
            for k in path:
                _, _, y, fs = cands[k]
                move_grad[before, y] += 1
                before = y
                for f in fs:
                    grad[f] = grad.get(f, 0.0) + 1
            for f, g in grad.items():
                w = model.weights.get(f, 0.0)
                g -= l2 * w
                size[f] = size.get(f, 1e-2) + g * g
                model.weights[f] = w + step * g / size[f] ** 0.5
            move_size += move_grad**2
            model.moves += step * move_grad / np.sqrt(move_size)
    model.weights = {f: w for f, w in model.weights.items() if abs(w) > 1e-3}
    return model


#: What most texts with a span of each kind hold somewhere: cheap patterns, for drawing a sample only.
HINTS = (
    "@[A-Za-z0-9-]",
    r"\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]",
    r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}",
    r"\+[0-9]",
)
DRAWS = 1 << 40


def _drawn(docs: DataFrame, quota: int) -> DataFrame:
    """Ids of at most ``quota`` documents for each hint and as many of any, by the least hash of the id.

    Each kind's ids are counted first; only those with a hash below about twice the quota's share are ranked.
    """
    hinted = F.array_compact(F.array(*[F.when(F.col("text").rlike(h), F.lit(k)) for k, h in enumerate(HINTS)], F.lit(OTHER)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(DRAWS)).alias("draw")
    kinds = kept(docs.filter("doc_id is not null").select("doc_id", draw, F.explode(hinted).alias("kind")).distinct())
    below = F.lit(False)
    for kind, n in kinds.groupBy("kind").count().collect():
        below = below | ((F.col("kind") == kind) & (F.col("draw") < min(DRAWS, -(-2 * quota * DRAWS // n))))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("draw", "doc_id"))
    return kinds.filter(below).withColumn("rank", rank).filter(F.col("rank") <= quota).select("doc_id").distinct()


def train(docs: DataFrame, max_docs: int = 3_000, max_stretches: int = 500, max_chars: int = 160) -> Field:
    """Fits on at most ``max_stretches`` stretches of ``max_docs`` documents, by least hashes, drawn by kind.

    ``docs`` as of ``texts``. A fifth of the documents are drawn from those with each of ``HINTS`` and a fifth
    from all; an eighth of the stretches hold a base span of each kind and half hold none.
    Longer stretches than ``max_chars`` are not learnt from (all are decoded).
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:int,text:string,left:string,right:string>>")
    def cut(column: pd.Series) -> pd.Series:
        out = []
        for t in column:
            found = [(t[a:b], t[max(0, a - 1) : a], t[b : b + 1]) for a, b in stretches(t) if b - a <= max_chars]
            out.append([(min((s[0] for s in base_spans(x[0])), default=OTHER), *x) for x in found])
        return pd.Series(out)

    names = ["text", "left", "right"]
    ids = _drawn(docs, max_docs // (OTHER + 1))
    found = docs.join(F.broadcast(ids), "doc_id").select(F.explode(cut("text")).alias("s")).select("s.*").distinct()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64(*names), *names))
    quota = F.when(F.col("kind") == OTHER, max_stretches // 2).otherwise(max_stretches // (2 * OTHER))
    rows = found.withColumn("rank", rank).filter(F.col("rank") <= quota).select(*names).collect()
    return fit(sorted(tuple(r) for r in rows))


def all_spans(model: Field, text: str, base: list[Span]) -> list[Span]:
    """Base spans and the field's spans that overlap none of them, by kind and start."""
    if not SEED.search(text):
        return base
    added = []
    taken = sorted((a, b) for _, a, b in base)
    starts, reach, end = [a for a, _ in taken], [0], 0
    for _, b in taken:
        end = max(end, b)
        reach.append(end)
    for a, b in stretches(text):
        for y, s, e in decode(model, text[a:b], text[max(0, a - 1) : a], text[b : b + 1]):
            # Base spans that start before this one ends must have ended before it starts.
            if reach[bisect_left(starts, e + a)] <= s + a:
                added.append((y, s + a, e + a))
    return sorted(base + added)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _finder(model: Field):
    @F.pandas_udf(RESULT)
    def find(column: pd.Series) -> pd.DataFrame:
        rows = []
        for text in column:
            base = base_spans(text)
            n = [sum(s[0] == k for s in base) for k in range(OTHER)]
            rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans(model, text, base))))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return find


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Field | None = None) -> DataFrame:
    """doc_id, counts of base spans, their hash, and all spans as ``kind:start:end``, for every row."""
    rows = texts(docs, doc_id, text)
    model = model or train(rows)
    small_batches(docs.sparkSession)
    return rows.select("doc_id", _finder(model)("text").alias("x")).select("doc_id", "x.*")


def masked(model: Field, text: Column) -> Column:
    """The text with each span, or union of overlapping ones, replaced by ``<KIND>`` of its first."""

    @F.pandas_udf("string")
    def mask(column: pd.Series) -> pd.Series:
        out = []
        for t in column:
            spans = sorted((a, b, k) for k, a, b in all_spans(model, t, base_spans(t)))
            parts, at = [], 0
            for a, b, k in spans:
                if a >= at:
                    parts += [t[at:a], f"<{KINDS[k].upper()}>"]
                at = max(at, b)
            out.append("".join(parts) + t[at:])
        return pd.Series(out)

    return F.when(text.isNotNull(), mask(F.coalesce(text, F.lit(""))))
