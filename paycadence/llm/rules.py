"""Quality rules with suffix-array repetition.

Words are runs of characters other than space and U+0009 to U+000D. For each text a suffix
array over its words is built by prefix doubling, many texts at once (the document is the
leading sort key, so suffixes of different texts never mix), and the common prefixes of
neighbours give, for each word, the longest passage from there on that the text has elsewhere
too. The union of those of ``min_repeat`` words or more is the share under maximal repeats.

Texts: null counts as empty; an empty text has no words and fails the base rule. Repeated rows
are judged one by one. A text of any length is worked on whole, in O(words) memory.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of texts that are sorted together; a longer text is sorted alone.
WORDS_AT_ONCE = 300_000

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long"
)


def _ranked(keys: np.ndarray) -> np.ndarray:
    """For each key, how many keys are smaller."""
    order = np.argsort(keys)
    there = keys[order]
    head = np.empty(len(keys), bool)
    head[:1] = True
    np.not_equal(there[1:], there[:-1], out=head[1:])
    first = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
    rank = np.empty(len(keys), np.int64)
    rank[order] = first
    return rank


def _union(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(ids: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: is it in a 3-word window that its text has twice, and how long a passage from it on recurs.

    ``ids`` are word numbers, ``doc`` ascending text numbers. Lengths under ``least`` are given as 0.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, side="right")
    places = np.arange(n)
    width = np.int64(n + 1)

    def ahead(rank: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Rank of the suffix k words on, from 1; 0 behind the text's end."""
        there = at + k
        return np.where(there < end[at], rank[np.minimum(there, n - 1)] + 1, 0)

    one = _ranked(doc.astype(np.int64) * (int(ids.max()) + 1) + ids)
    two = _ranked(one * width + ahead(one, places, 1))

    whole = np.flatnonzero(places + 3 <= end)
    key = two[whole] * width + one[whole + 2]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(whole), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = whole[order[twice]]
    windows = _union(starts, starts + 3, n)

    # Prefix doubling, on the suffixes alone whose prefix isn't unique yet.
    levels, k = [(1, one), (2, two)], 2
    rank = two
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    kept = None  # the suffixes that share at least 4 words with another
    while len(active):
        key = rank[active] * width + ahead(rank, active, k)
        order = np.argsort(key)
        at, key = active[order], key[order]
        group = rank[at]
        new_group, new_key = np.ones(len(at), bool), np.ones(len(at), bool)
        new_group[1:] = group[1:] != group[:-1]
        new_key[1:] = key[1:] != key[:-1]
        spot = np.arange(len(at))
        offset = np.maximum.accumulate(np.where(new_key, spot, 0)) - np.maximum.accumulate(np.where(new_group, spot, 0))
        rank = rank.copy()
        rank[at] = group + offset
        k *= 2
        levels.append((k, rank))
        alone = new_key & np.append(new_key[1:], True)
        active = at[~alone]
        if kept is None or k <= least:
            kept = active
    length = np.zeros(n, np.int64)
    if kept is None or len(kept) < 2:
        return windows, length
    # Neighbours in the suffix array, and their common prefix by descent through the ranks.
    sa = kept[np.argsort(rank[kept])]
    a, b = sa[:-1].copy(), sa[1:].copy()
    prefix = np.zeros(len(a), np.int64)
    inside = (doc[a] == doc[b]).copy()
    for size, ranks in reversed(levels):
        equal = inside & (a + size <= end[sa[:-1]]) & (b + size <= end[sa[1:]])
        equal &= ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)]
        prefix += size * equal
        a += size * equal
        b += size * equal
    np.maximum.at(length, sa[:-1], prefix)
    np.maximum.at(length, sa[1:], prefix)
    length[length < least] = 0
    return windows, length


def stats(batch: list[str], least: int) -> pd.DataFrame:
    """One row of counts for each text."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in batch]
    rows = {
        "n_words": [len(x) for x in split],
        "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in batch],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in batch],
        "n_dup_lines": [],
        "n_repeat_words": [],
        "n_covered_words": [],
        "longest_repeat": [],
    }
    for t in batch:
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        rows["n_dup_lines"].append(len(lines) - len(set(lines)))
    at = 0
    while at < len(split):
        until, words = at, 0
        while until < len(split) and (until == at or words + len(split[until]) <= WORDS_AT_ONCE):
            words += len(split[until])
            until += 1
        number = defaultdict(count().__next__)
        sizes = np.array(rows["n_words"][at:until])
        ids = np.fromiter((number[w] for x in split[at:until] for w in x), np.int64, words)
        doc = np.repeat(np.arange(until - at), sizes)
        windows, length = repeats(ids, doc, least)
        spans = np.flatnonzero(length)
        covered = _union(spans, spans + length[spans], words)
        rows["n_repeat_words"] += np.bincount(doc[windows], minlength=until - at).tolist()
        rows["n_covered_words"] += np.bincount(doc[covered], minlength=until - at).tolist()
        longest = np.zeros(until - at, np.int64)
        np.maximum.at(longest, doc[spans], length[spans])
        rows["longest_repeat"] += longest.tolist()
        split[at:until] = [()] * (until - at)
        at = until
    return pd.DataFrame(rows)


def apply_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_repeat: int = 16,
    max_covered: float = 0.3,
    max_repeat: int = 120,
) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows.
    ``kept``: not base_failed, at most ``max_covered`` of the words under repeats of
    ``min_repeat`` words or more, and no repeat longer than ``max_repeat`` words.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(STATS)
    def measured(column: pd.Series) -> pd.DataFrame:
        return stats(column.tolist(), min_repeat)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("n_covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return (
        texts(docs, doc_id, text)
        .select("doc_id", measured("text").alias("s"))
        .select("doc_id", "s.*")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & fine)
    )
