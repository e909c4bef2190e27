"""Maximal periodic runs of words, found by internal pattern matching.

Texts are joined to one sequence of word numbers with an own separator after each. Prefix doubling names every block of
2^k words and ends in the suffix array, of which each block's occurrences are one interval. A wavelet tree over the
suffix array then answers range successors: the next occurrence of a block behind its place.

Let a run have period q and at least 4q words, and let m be the power of two with m/2 < q <= m. The run contains a block
of m words that starts at a multiple of m/2 and occurs again q words later, still inside the run. By the periodicity
lemma it has no occurrence in between: all occurrences in the neighbouring window of m words form one arithmetic
progression whose difference is q. So the first step of every block's progression gives all candidates, and each
candidate is the smallest period of what it is extended to. Extensions compare blocks of falling length.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.text import map_texts

#: Words of texts that are searched together; a longer text is searched on its own.
SEARCH_WORDS = 1 << 17


def block_names(symbols: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: the rank of the block of 2^k symbols at each place, until all blocks differ.

    A rank is the number of smaller blocks, so blocks of one name take the ranks from it on in the suffix array. Blocks
    that differ already are not sorted again. The last symbol must occur once.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    name = np.empty(n, np.int32)
    first = np.flatnonzero(np.diff(symbols[order], prepend=-1))
    name[order] = np.repeat(first, np.diff(first, append=n))
    names, step = [name], 1
    while True:
        size = np.bincount(name, minlength=n)
        shared = np.flatnonzero(size[name] > 1)
        if not len(shared):
            return names
        # a block that has a twin cannot reach the last symbol, so there is a name behind it
        key = name[shared].astype(np.int64) * n + name[shared + step]
        shared, key = shared[order := np.argsort(key, kind="stable")], key[order]
        place = np.arange(len(shared))
        group = np.maximum.accumulate(np.where(np.diff(key // n, prepend=-1) != 0, place, 0))
        equal = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, place, 0))
        name = name.copy()
        name[shared] += (equal - group).astype(np.int32)
        names.append(name)
        step *= 2


class WaveletTree:
    """A permutation of 0..n-1 cut by bits from the highest; each level counts the zeros before a place."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def less(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at lo..hi-1 are below x; x is less than 2^bits."""
        total = np.zeros(len(x), np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b, all_zeros = zeros[lo], zeros[hi], zeros[-1]
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            total += np.where(one, b - a, 0)
            lo, hi = np.where(one, lo - a + all_zeros, a), np.where(one, hi - b + all_zeros, b)
        return total

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values at lo..hi-1."""
        found = np.zeros(len(k), np.int64)
        for zeros in self.zeros:
            a, b, all_zeros = zeros[lo], zeros[hi], zeros[-1]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, lo - a + all_zeros, a), np.where(one, hi - b + all_zeros, b)
            found = 2 * found + one
        return found

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value at lo..hi-1 that is x or more; -1 where there is none."""
        k = self.less(lo, hi, x)
        found = np.full(len(x), -1, np.int64)
        some = np.flatnonzero(k < hi - lo)
        found[some] = self.kth(lo[some], hi[some], k[some])
        return found


def _common(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols agree from i and j on, or before them if ``back``."""
    i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step = 1 << k
        if back:
            same = (i >= step) & (names[k][np.maximum(i - step, 0)] == names[k][np.maximum(j - step, 0)])
        else:
            same = names[k][i] == names[k][j]
        moved = np.where(same, step, 0)
        total += moved
        i, j = (i - moved, j - moved) if back else (i + moved, j + moved)
    return total


def find_runs(symbols: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """(start, length, period) of all runs of at least ``min_length`` symbols and ``min_exponent`` periods, in order.

    The last symbol must occur once.
    """
    if min_exponent < 4:
        raise ValueError("blocks meet every run only from four periods on")
    names, n = block_names(symbols), len(symbols)
    suffixes = np.empty(n, np.int64)
    suffixes[names[-1]] = np.arange(n)
    tree = WaveletTree(suffixes)
    found = []
    for k, name in enumerate(names[:-1]):
        m = 1 << k
        size = np.bincount(name, minlength=n)
        at = np.arange(0, n, max(1, m // 2))
        at = at[size[name[at]] > 1]
        lo = name[at].astype(np.int64)
        # a block with a twin ends before the last symbol, so at + 1 is a place
        after = tree.successor(lo, lo + size[lo], at + 1)
        near = (after >= 0) & (after - at <= m) & (after - at > m // 2)
        at, after = at[near], after[near]
        start = at - _common(names, at, after, back=True)
        end = after + _common(names, at, after, back=False)
        long = (end - start >= min_length) & (end - start >= min_exponent * (after - at))
        found.append(np.stack([start, end - start, after - at], axis=1)[long])
    return np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found])[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _searched(texts: list[list[bytes]]) -> Iterator[np.ndarray]:
    """The runs of each text, as lists of words."""
    numbers: dict[bytes, int] = {}
    symbols = [numbers.setdefault(w, len(numbers)) for text in texts for w in [*text, None]]
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined = np.array(symbols, np.int64)
    joined[ends - 1] = len(numbers) + np.arange(len(texts))
    runs = find_runs(joined)
    owner = np.searchsorted(ends, runs[:, 0], side="right")
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        yield runs[cut[i] : cut[i + 1]] - [ends[i] - 1 - len(text), 0, 0]


def collapse(text: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains behind its first period."""
    if not len(runs):
        return text
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [text[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def best_run(runs: np.ndarray) -> int | None:
    """The place of the run with the most periods, exactly; of equal ones the first, then the shortest period."""
    return min(range(len(runs)), key=lambda i: (-Fraction(int(runs[i, 1]), int(runs[i, 2])), runs[i, 0], runs[i, 2]), default=None)


def search(texts: list[str | None]) -> dict:
    """Runs, the place of the best one, and the collapsed text, of each text."""
    split = [(t or "").encode().split() for t in texts]
    runs: list[np.ndarray] = []
    held, size = [], 0
    for i, text in enumerate(split):
        held.append(text)
        size += len(text) + 1
        if i + 1 == len(split) or size + len(split[i + 1]) >= SEARCH_WORDS:
            runs.extend(_searched(held))
            held, size = [], 0
    flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
    ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], ["start", "length", "period"])
    return {
        "runs": pa.ListArray.from_arrays(ends, fields),
        "best": [best_run(r) for r in runs],
        "collapsed": [b" ".join(collapse(t, r)).decode() for t, r in zip(split, runs)],
    }


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``runs`` (start word, length, period; by start, then period), ``best`` (the place
    in ``runs`` of the one with most periods) and ``collapsed`` (the text with each run cut to its first period).

    A run is a longest stretch of words with a smallest period q and at least 6 and 4q words. A null or empty text has
    no runs, no best one, and collapses to the empty string. Repeated rows and null ids are searched like any other; an
    empty table gives no rows; other columns are not read. A text is searched whole: it takes about 4 bytes times
    log2(words) for each word, and as much again where it repeats long stretches.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, lambda: search, "runs array<struct<start: long, length: long, period: long>>, best int, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Counts, the best run, and SHA-256 digests of what ``periodic_runs`` gave."""
    best = F.try_element_at("runs", F.col("best") + 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.try_divide(F.lit(1000) * best["length"] - F.pmod(F.lit(1000) * best["length"], best["period"]), best["period"])).cast("long").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def with_repeated_tail(doc_id: Column, text: Column, split: Column) -> Column:
    """The text of a tenth of the documents with its words from some place on made periodic, by the crc32 of the id.

    Documents without an id stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("int")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise(F.lit(""))

    # the array of one element names the words, so that they are cut once
    return F.when(h % 10 == 0, F.transform(F.array(split), repeat)[0]).otherwise(text)
