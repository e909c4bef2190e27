"""Near-duplicate passages by compact windows, without loss.

Two passages of ``width`` words are similar by the Jaccard similarity of their sets of five-word shingles. A passage can
only be similar to one of another text if enough of its shingles occur in other texts, so shingles are counted first, as
packed sorted arrays, and all other passages go at once. Under a min-hash function all passages around a position whose
shingle has the smallest value share that value: they form a compact window, and the windows of a text are the nodes of
the Cartesian tree over its hash values. They are found from sliding minima and cut what is left of a text into tiles,
ranges of starts with one minimum. Equal passages have the same minimum at the same place, so copies fall into equal
tiles, and a tile is worked on once however often it occurs. Nor do words matter that only one text has: tiles with the
same pattern, that is the same shared shingles at the same places, are linked with the same, and are compared once.

Different patterns with the same minimum are compared with the one that leads them, passage by passage. What this leaves is
found by prefixes: under one order of all shingles, rare ones first, similar passages share a shingle within the first
few of each. Patterns that share one are compared pair by pair, but for pairs that are in one class already and have no
passage without a partner, and for pairs that a map of their shingles rules out. No pair that may still tell something is
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trialloom.llm.components import connected
from trialloom.llm.hash_tables import BITS, Shelf, SortedTable, bucket_of, fill_gaps, mix, new_shelf, split_by_bucket, summed, unpack
from trialloom.llm.text import TextHashes as WordHashes
from trialloom.llm.text import hashed_blocks, small_batches
from trialloom.session import materialise

SHINGLE = 5
#: Min-hash functions; the passages of a run agree in the minima of a band of them. Tiles are cut by the first one alone.
BANDS = ((0, 1),)
CHUNK = 1_000_000
#: Most starts of a tile, which are known by the bits of a long.
STARTS = 60
#: Patterns that one task remembers to have sent.
SENT = 200_000
#: Passages whose prefixes are found together.
TOGETHER = 20_000
#: The order of shingles: how many texts have it, then its number.
NUMBER_BITS = 43
#: Bits of a shingle's number, moved up so that those of a tile's own are no less than 0.
ID_BITS = 44
#: Longs of a map of shingles.
SKETCH = 4
#: Pairs that are compared together, and cells of their matrices; the size of no passage.
PAIRS, CELLS, TOO_LARGE = 2_000, 1_000_000, 1 << 20


def shingles(h: np.ndarray) -> np.ndarray:
    value = np.zeros(max(0, len(h) - SHINGLE + 1), dtype=np.uint64)
    if not len(value):
        return value
    for k in range(SHINGLE):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SHINGLE + 1 + k])
    return value


def sliding_argmin(v: np.ndarray, t: int) -> np.ndarray:
    """For each window of ``t`` values the place of its smallest, leftmost in a tie."""
    n = len(v)
    bits = np.uint64(max(1, n.bit_length()))
    tagged = (v >> bits << bits) | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // t) * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = tagged
    blocks = blocks.reshape(-1, t)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - t + 1], ahead[t - 1 : n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def compact_windows(v: np.ndarray, t: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of every node of the Cartesian tree over ``v`` that spans ``t`` values or more, by c.

    All subsequences within l to r that hold c have their leftmost minimum at c. What bounds such a node is itself such
    a node, so the tree is built over the places of sliding minima alone.
    """
    if len(v) < t:
        return []
    places = np.unique(sliding_argmin(v, t)).tolist()
    values = v[places].tolist()
    left, right, stack = [0] * len(places), [len(v) - 1] * len(places), []
    for i, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            right[stack.pop()] = places[i] - 1
        left[i] = places[stack[-1]] + 1 if stack else 0
        stack.append(i)
    return list(zip(left, places, right))


def starts(windows: list[tuple[int, int, int]], t: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of starts that the windows give to passages of ``t``: first start of each, ascending, and its c.

    Together they tile all starts, as every passage has one minimum.
    """
    w = np.array(windows, dtype=np.int64).reshape(-1, 3)
    first, last = np.maximum(w[:, 0], w[:, 1] - t + 1), np.minimum(w[:, 1], w[:, 2] - t + 1)
    kept = first <= last
    order = np.argsort(first[kept])
    return first[kept][order], w[kept, 1][order]


@dataclass
class Block:
    """Several texts, worked on as one sequence. Positions are counted in words from the first text.

    The last words of each text begin no shingle; they get the smallest value, so no window of another text reaches
    over them and those that hold one are no passages.
    """

    offsets: np.ndarray
    words: np.ndarray
    width: int

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """The shingle at each position, and whether it is within one text."""
        value = shingles(self.words)
        ends = self.offsets[1:, None] - np.arange(1, SHINGLE)
        ends = ends[(ends >= self.offsets[:-1, None]) & (ends < len(value))]
        inside = np.ones(len(value), dtype=bool)
        inside[ends] = False
        return value, inside

    def bands(self, usable: np.ndarray | None = None, bands: tuple = BANDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each band (first start, last start, place of the first function's minimum, key) of its runs, by interval join.

        Shingles that are not ``usable`` are no minimum of a passage that has others.
        """
        n, t = len(self.words), self.width - SHINGLE + 1
        if n < self.width:
            return [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)] * len(bands)
        value, inside = self.shingles()
        tiles = {}
        for f in {f for band in bands for f in band}:
            v = mix(value ^ np.uint64(0x9E3779B97F4A7C15 * (2 * f + 1) & 0xFFFFFFFFFFFFFFFF))
            v = v >> np.uint64(2) | np.uint64(1 << 62)
            if usable is not None:
                v = np.where(usable, v, v | np.uint64(1 << 63))
            v = np.where(inside, v, np.uint64(0))
            first, c = starts(compact_windows(v, t), t)
            tiles[f] = (first, c, v[c])
        found = []
        for number, band in enumerate(bands):
            cuts = np.unique(np.concatenate([tiles[f][0] for f in band]))
            at = {f: np.searchsorted(tiles[f][0], cuts, "right") - 1 for f in band}
            place = tiles[band[0]][1][at[band[0]]]
            key = np.full(len(cuts), number, dtype=np.uint64)
            for f in band:
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + tiles[f][2][at[f]])
            last = np.append(cuts[1:], len(value) - t + 1) - 1
            kept = inside[place]
            found.append((cuts[kept], last[kept], place[kept], key[kept]))
        return found

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, position, "right") - 1

    def fingerprints(self) -> np.ndarray:
        """A hash of each window of ``width`` words, from one running sum."""
        return window_hashes(self.words, self.width)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    down = np.cumprod(np.concatenate([one, np.full(len(h) - 1, inverse, dtype=np.uint64)]), dtype=np.uint64)
    up = np.cumprod(np.concatenate([one, np.full(n - 1, base, dtype=np.uint64)]), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down, dtype=np.uint64)])
    return mix((total[width:] - total[:n]) * up)


def within(flag: np.ndarray, t: int) -> np.ndarray:
    """How many of each ``t`` neighbours are set."""
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[t:] - total[:-t]


def repeated(value: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) of places that hold the same value of the same text, each with the next such place."""
    own = mix(value.astype(np.uint64) ^ mix(who.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    ascending = np.sort(own)
    twice = ascending[1:][ascending[1:] == ascending[:-1]]
    if not len(twice):
        return (np.zeros(0, np.int64),) * 2
    may = np.zeros(1 << 20, dtype=bool)
    may[twice >> np.uint64(44)] = True
    places = np.flatnonzero(may[own >> np.uint64(44)])
    order = places[np.argsort(own[places], kind="stable")]
    same = np.flatnonzero(own[order[1:]] == own[order[:-1]])
    return order[same], order[same + 1]


def distinct_within(before: np.ndarray, after: np.ndarray, n: int, t: int) -> np.ndarray:
    """How many different values each ``t`` neighbours of ``n`` hold; ``before`` and ``after`` as from :func:`repeated`."""
    near = after - before < t
    step = np.bincount(before[near] + 1, minlength=n + 1) - np.bincount(np.maximum(after[near] - t + 1, 0), minlength=n + 1)
    return t + np.cumsum(step)[: n - t + 1]


@dataclass(frozen=True)
class Bound:
    """What similarity asks of the sets of ``t`` shingles."""

    t: int
    percent: int

    def alone(self, size):
        """Least number of shingles that a set has in common with a similar one of any size."""
        return -(-self.percent * size // 100)

    def both(self) -> int:
        """The same for two sets without repeats."""
        return -(-2 * self.t * self.percent // (100 + self.percent))


@dataclass
class Shingles:
    """The shingles that occur in two texts or more: their numbers, how many texts have them, and whether they stand in a
    passage that repeats a shingle."""

    shelf: Shelf
    offsets: np.ndarray

    def __post_init__(self) -> None:
        self.tables = {}

    def table(self, b: int) -> tuple[SortedTable, np.ndarray, np.ndarray]:
        if b not in self.tables:
            one = SortedTable(self.shelf, str(b))
            self.tables[b] = one, one.values("texts"), one.values("odd")
        return self.tables[b]

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each shingle, or -1, and its odd flag."""
        key = value >> np.uint64(64 - BITS)
        bucket = bucket_of(key, len(self.offsets) - 1)
        number, odd = np.full(len(key), -1, dtype=np.int64), np.zeros(len(key), dtype=bool)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, end in zip(at, [*at[1:], len(order)]):
            rows, b = order[a:end], int(bucket[order[a]])
            one, _, flags = self.table(b)
            place = one.find(key[rows])
            hit = place >= 0
            number[rows[hit]] = place[hit] + self.offsets[b]
            odd[rows[hit]] = flags[place[hit]]
        return number, odd

    def facts(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many texts each numbered shingle is, and its odd flag."""
        bucket = np.searchsorted(self.offsets, number, "right") - 1
        texts, odd = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=bool)
        for b in np.unique(bucket).tolist():
            at = np.flatnonzero(bucket == b)
            _, have, flags = self.table(b)
            texts[at], odd[at] = have[number[at] - self.offsets[b]], flags[number[at] - self.offsets[b]]
        return texts, odd


def shared_shingles(rows: DataFrame, width: int, per_bucket: int) -> Shingles:
    """Count in how many texts that have passages each shingle occurs, and write those of two or more as sorted tables."""
    t = width - SHINGLE + 1
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-letters // (6 * per_bucket)))
    shelf = new_shelf(rows.sparkSession, "shingles")
    odd_one = 1 << 32

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, weights, size = WordHashes(), [], [], 0

        def flush():
            (keys,), counts = summed([np.concatenate(held)], np.concatenate(weights))
            return pd.DataFrame(split_by_bucket(bucket_of(keys, buckets), [keys], counts), columns=["bucket", "part"])

        for batch in batches:
            for _, _, offsets, h in hashed_blocks(batch["text"].tolist(), hashes):
                if len(h) < width:
                    continue
                block = Block(offsets, h, width)
                value, inside = block.shingles()
                who = block.text_of(np.arange(len(value)))
                before, after = repeated(value, who)
                passage = within(inside, t) == t
                odd = np.flatnonzero(passage & (distinct_within(before, after, len(value), t) < t))
                step = np.zeros(len(value) + 1, dtype=np.int64)
                step[odd] += 1
                step[odd + t] -= 1
                odd = np.cumsum(step)[:-1] > 0
                kept = inside & (np.diff(offsets)[who] >= width)
                first = kept.copy()
                first[after] = False
                # equal values may begin inside a text and end on its last words, where no shingle is, never the other way;
                # one that comes again tells only whether it is odd there
                again = after[(odd & kept)[after]]
                held.append(np.concatenate([value[first], value[again]]) >> np.uint64(64 - BITS))
                weights.append(np.concatenate([1 + odd[first].astype(np.int64) * odd_one, np.full(len(again), odd_one)]))
                size += len(held[-1])
                if size >= CHUNK:
                    yield flush()
                    held, weights, size = [], [], 0
        if size:
            yield flush()

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        found = [unpack(p, 1) for p in parts["part"]]
        (keys,), counts = summed([np.concatenate([f[0][0] for f in found])], np.concatenate([f[1] for f in found]))
        texts = counts % odd_one
        kept = texts > 1
        SortedTable.write(shelf, str(key[0]), keys[kept], texts=texts[kept].astype(np.uint32), odd=counts[kept] >= odd_one)
        return pd.DataFrame({"bucket": [key[0]], "n": [int(kept.sum())]})

    made = rows.select("text").mapInPandas(count, "bucket int, part binary").groupBy("bucket").applyInPandas(merge, "bucket int, n bigint").toPandas()
    fill_gaps(shelf, buckets, made["bucket"], texts=np.zeros(0, np.uint32), odd=np.zeros(0, bool))
    sizes = np.zeros(buckets, dtype=np.int64)
    sizes[made["bucket"].to_numpy(dtype=np.int64)] = made["n"].to_numpy(dtype=np.int64)
    return Shingles(shelf, np.concatenate([[0], np.cumsum(sizes)]))


def ragged(begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of ``counts`` successive numbers from each of ``begin``."""
    row = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return row, np.arange(len(row)) + (begin - ends + counts)[row]


def tiles_of(block: Block, shared: Shingles, bound: Bound) -> dict[str, np.ndarray] | None:
    """The tiles of passages that may have a partner: text, first start, starts, times, key, tile, and their shingle numbers.

    A tile is known by a hash of its words. It is given once for all times that it follows itself. Shingles that no other text
    has are numbered from -1 down within a tile. The numbers of tile k are ids[offsets[k]:offsets[k + 1]].
    """
    t = bound.t
    if len(block.words) < block.width:
        return None
    value, inside = block.shingles()
    number, odd = shared.find(value)
    number[~inside] = -1
    before, after = repeated(value, block.text_of(np.arange(len(value))))
    size = distinct_within(before, after, len(value), t)
    some = within(number >= 0, t)
    plain = size == t
    may = np.where(plain, (some >= bound.both()) | (within(odd & (number >= 0), t) >= bound.alone(t)), some >= bound.alone(size))
    s = np.flatnonzero(may & (within(inside, t) == t))
    if not len(s):
        return None
    # windows are sought in the stretches of such starts alone; the last words of a stretch begin no shingle within it
    split = np.flatnonzero(np.diff(s, prepend=-2) != 1)
    lengths = np.diff(np.append(split, len(s)))
    _, words = ragged(s[split], lengths + block.width - 1)
    apart = Block(np.concatenate([[0], np.cumsum(lengths + block.width - 1)]), block.words[words], block.width)
    moved = np.repeat(np.arange(len(split)), lengths) * (block.width - 1) + np.arange(len(s))
    ((first, _, place, key),) = apart.bands((number >= 0)[np.minimum(words, len(number) - 1)][: len(words) - SHINGLE + 1], ((0,),))
    at = np.searchsorted(first, moved, "right") - 1
    piece = (place[at] - moved) // STARTS
    cut = np.ones(len(s), dtype=bool)
    cut[1:] = (s[1:] != s[:-1] + 1) | (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
    cut = np.flatnonzero(cut)
    a, n = s[cut], np.diff(np.append(cut, len(s)))
    prints = block.fingerprints()
    tile = mix(mix(prints[a] + n.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + prints[a + n - 1]).view(np.int64)
    text = block.text_of(a)
    new = np.ones(len(a), dtype=bool)
    new[1:] = (tile[1:] != tile[:-1]) | (text[1:] != text[:-1]) | (a[1:] != a[:-1] + n[:-1])
    new = np.flatnonzero(new)
    times, key = np.diff(np.append(new, len(a))), key[at[cut]][new].view(np.int64)
    a, n, text, tile = a[new], n[new], text[new], tile[new]

    offsets = np.concatenate([[0], np.cumsum(n + t - 1)])
    row, where = ragged(a, n + t - 1)
    ids = number[where]
    own = ids < 0
    count = np.cumsum(own)
    ids[own] = (np.concatenate([[0], count])[offsets[row]] - count)[own]
    # one that was in the tile before has the number it had there, which that place got from the one before it
    back = np.full(len(value), -1)
    back[after] = before
    again = np.flatnonzero(own & (back[where] >= a[row]))
    if len(again):
        point = np.arange(len(ids))
        point[again] = offsets[row[again]] + back[where[again]] - a[row[again]]
        while (point[point[again]] != point[again]).any():
            point[again] = point[point[again]]
        ids[again] = ids[point[again]]
    return {"text": text, "first": a - block.offsets[text], "n": n, "times": times, "key": key, "tile": tile, "ids": ids, "offsets": offsets}


def place_bits(t: int) -> int:
    return (STARTS + t).bit_length()


@dataclass
class Side:
    """The shingles of one tile of each of several pairs, by pair, number and place.

    Each place stands for the passages, by their first and last start, that have the shingle there for the first time.
    """

    ids: np.ndarray
    offsets: np.ndarray
    t: int

    def __post_init__(self) -> None:
        lengths = np.diff(self.offsets)
        self.starts = lengths - self.t + 1
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(self.ids)) - self.offsets[row]
        bits = place_bits(self.t)
        # one sort of single values
        packed = np.sort(((row << ID_BITS) + self.ids + (1 << bits)) << bits | place)
        place = packed & ((1 << bits) - 1)
        self.key = packed >> bits
        self.row = self.key >> ID_BITS
        self.new = np.ones(len(packed), dtype=bool)
        self.new[1:] = self.key[1:] != self.key[:-1]
        self.low = np.maximum(place - self.t + 1, 0)
        again = np.flatnonzero(~self.new)
        self.low[again] = np.maximum(self.low[again], place[again - 1] + 1)
        self.high = np.minimum(place, self.starts[self.row] - 1)
        self.common = (self.key & ((1 << ID_BITS) - 1)) >= 1 << bits
        self.plain = np.ones(len(lengths), dtype=bool)
        self.plain[self.row[again]] = False

    def sizes(self) -> np.ndarray:
        """How many different shingles each passage has: a row of passages for each tile, the rest of it too large to be similar."""
        n, most = len(self.starts), int(self.starts.max()) + 1
        has = np.flatnonzero(self.low <= self.high)
        at = self.row[has] * most
        step = np.bincount(at + self.low[has], minlength=n * most) - np.bincount(at + self.high[has] + 1, minlength=n * most)
        out = np.cumsum(step.reshape(n, most), axis=1)
        out[np.arange(most) >= self.starts[:, None]] = TOO_LARGE
        return out

    def passages(self, row: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.ids[(self.offsets[row] + start)[:, None] + np.arange(self.t)]


def compare(x: Side, y: Side, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """(rows, facts) of the pairs that have similar passages. The facts from either side are the passages with a partner as
    bits, the first and the last of them, one that the first is similar to, and whether the two are equal."""
    none = np.zeros(0, np.int64), np.zeros((0, 10), np.int64)
    mine = np.flatnonzero(x.common)
    from_, to = np.searchsorted(y.key, x.key[mine], "left"), np.searchsorted(y.key, x.key[mine], "right")
    met = to > from_
    mine, from_, times = mine[met], from_[met], (to - from_)[met]
    if not len(mine):
        return none
    shared = np.bincount(x.row[mine[x.new[mine]]], minlength=len(x.starts))
    x_size, y_size = x.sizes(), y.sizes()
    least = np.where(x.plain & y.plain, bound.both(), bound.alone(np.maximum(x_size.min(axis=1), y_size.min(axis=1))))
    area = np.where(shared >= least, np.maximum(x.starts, y.starts) ** 2, 0)
    rows = np.argsort(area, kind="stable")
    rows = rows[area[rows] > 0]
    if not len(rows):
        return none
    a = np.repeat(mine, times)
    b = np.repeat(from_ - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(len(a))
    has = (x.low[a] <= x.high[a]) & (y.low[b] <= y.high[b])
    a, b = a[has], b[has]
    ends = np.searchsorted(x.row[a], np.arange(len(x.starts) + 1))
    found, facts = [], []
    first = 0
    while first < len(rows):
        last = first + 1 + int(np.searchsorted(np.arange(2, len(rows) - first + 1) * area[rows[first + 1 :]], CELLS, "right"))
        part, first = rows[first:last], last
        counts = ends[part + 1] - ends[part]
        at = np.repeat(ends[part] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        pair, p, q = np.repeat(np.arange(len(part)), counts), a[at], b[at]
        n, m = int(x.starts[part].max()), int(y.starts[part].max())
        # each two places with one shingle are a rectangle of pairs of passages
        cell = lambda i, j: (pair * (n + 1) + i) * (m + 1) + j
        more = np.concatenate([cell(x.low[p], y.low[q]), cell(x.high[p] + 1, y.high[q] + 1)])
        less = np.concatenate([cell(x.high[p] + 1, y.low[q]), cell(x.low[p], y.high[q] + 1)])
        cells = len(part) * (n + 1) * (m + 1)
        both = (np.bincount(more, minlength=cells) - np.bincount(less, minlength=cells)).reshape(len(part), n + 1, m + 1)
        both = both.cumsum(axis=1).cumsum(axis=2)[:, :n, :m]
        xs, ys = x_size[part][:, :n], y_size[part][:, :m]
        near = 100 * both >= bound.percent * (xs[:, :, None] + ys[:, None, :] - both)
        hit = np.flatnonzero(near.any(axis=(1, 2)))
        if len(hit):
            part, near, both, xs, ys = part[hit], near[hit], both[hit], xs[hit], ys[hit]
            found.append(part)
            facts.append(np.concatenate([one_side(x, y, part, near, both, xs, ys), one_side(y, x, part, near.transpose(0, 2, 1), both.transpose(0, 2, 1), ys, xs)], axis=1))
    return (np.concatenate(found), np.concatenate(facts)) if found else none


def one_side(x: Side, y: Side, part: np.ndarray, near: np.ndarray, both: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    each = np.arange(len(part))
    mine = near.any(axis=2)
    mask = mine @ (np.int64(1) << np.arange(mine.shape[1]))
    i, z = mine.argmax(axis=1), mine.shape[1] - 1 - mine[:, ::-1].argmax(axis=1)
    size = xs[each, i][:, None]
    k, j = np.nonzero(near[each, i] & (both[each, i] == size) & (ys == size))
    own = x.passages(part[k], i[k])
    same = ((own >= 0) & (own == y.passages(part[k], j))).all(axis=1)
    with_, exact = near[each, i].argmax(axis=1), np.zeros(len(part), dtype=np.int64)
    # the first of several is written last
    k, j = k[same][::-1], j[same][::-1]
    with_[k], exact[k] = j, 1
    return np.stack([mask, i, z, with_, exact], axis=1)


def prefixes(tiles: list[np.ndarray], shared: Shingles, bound: Bound) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(tile, key, family, repeats, starts) of the shingles by which the passages of some tiles are found.

    Rare shingles come first. A passage without repeats and another such one share a shingle among the first ``t`` -
    ``both()`` + 1 (family 0); if one has repeats, among the first size - ``alone(size)`` + 1 of each (family 1).
    ``starts`` are the passages of the tile, as bits, that have the shingle there.
    """
    t = bound.t
    lengths = np.array([len(x) for x in tiles])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.concatenate(tiles)
    who = np.repeat(np.arange(len(tiles)), lengths)
    size = distinct_within(*repeated(ids.view(np.uint64), who), len(ids), t)
    rank = -ids
    seen = np.flatnonzero(ids >= 0)
    texts, flags = shared.facts(ids[seen])
    rank[seen] = np.minimum(texts, (1 << 19) - 1) << NUMBER_BITS | ids[seen]
    odd = np.zeros(len(ids), dtype=bool)
    odd[seen] = flags
    s = np.flatnonzero(np.arange(len(ids)) <= begin[who + 1] - t)
    view = np.lib.stride_tricks.sliding_window_view(rank, t)
    bit = np.int64(1) << (s - begin[who[s]])
    plain = size[s] == t
    long = bound.alone(t)
    by_odd = plain & (within(odd, t)[s] >= long)
    for family, repeats, rows, n in ((0, False, plain, t - bound.both() + 1), (1, False, by_odd, t - long + 1), (1, True, ~plain, 0)):
        mask = np.zeros(len(ids), dtype=np.int64)
        chosen = np.flatnonzero(rows)
        for k in range(0, len(chosen), TOGETHER):
            part = chosen[k : k + TOGETHER]
            at, window = s[part], view[s[part]]
            if repeats:
                limit = np.empty(len(part), dtype=np.int64)
                for i, (row, d) in enumerate(zip(window, size[at].tolist())):
                    limit[i] = np.unique(row)[d - bound.alone(d)]
            else:
                limit = np.partition(window, n - 1, axis=1)[:, n - 1]
            taken = (window <= limit[:, None]) & (window >= 1 << NUMBER_BITS)
            for c in range(t):
                hit = taken[:, c]
                # starts differ, so no place is met twice
                mask[at[hit] + c] |= bit[part[hit]]
        p = np.flatnonzero(mask if not family else np.where(odd, mask, 0))
        yield who[p], ids[p], np.full(len(p), family), np.full(len(p), repeats), mask[p]


def repeated_passages(docs: DataFrame, width: int = 50, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 1_000_000, report: dict | None = None) -> DataFrame:
    """Passages of ``width`` words or more of a text that occur, word for word or nearly, in another, with their classes.

    ``width`` words in a row are linked with those of another text whose set of five-word shingles has a Jaccard similarity
    of ``percent`` / 100 or more with theirs. A passage is all linked words of a text that hang together: its stretches of
    ``width`` words start less than ``width`` apart. One row for each: ``doc_id``, ``first_word``, ``last_word``
    (inclusive, from 0), and the class of passages that links join, known by the id and first word of the first of them,
    ``class_id`` and ``class_word``. ``other_id`` and ``other_word`` say what the first ``width`` words are linked with,
    ``exact`` whether word for word. Every link counts; no pairs are listed. Words are lower-cased. Shorter, empty and null
    texts have no passages. Rows that repeat an id count as texts of their own. An empty table gives no rows. Other
    columns are not read. ``report`` is given the numbers of compared pairs.
    """
    spark, bound = docs.sparkSession, Bound(width - SHINGLE + 1, percent)
    report = {} if report is None else report
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(spark)
    shared = shared_shingles(rows, width, per_bucket)

    # numbered as they are written, so the numbers stay
    numbered = rows.withColumn("text_no", F.monotonically_increasing_id())
    schema = StructType([*numbered.select("doc_id", "text_no").schema.fields, *StructType.fromDDL("first int, n int, times int, key bigint, tile bigint, pattern bigint, ids array<bigint>").fields])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = WordHashes(), set()
        for batch in batches:
            for begin, _, offsets, h in hashed_blocks(batch.column("text").to_pylist(), hashes):
                if (tiles := tiles_of(Block(offsets, h, width), shared, bound)) is None:
                    continue
                ids, ends = tiles["ids"], tiles["offsets"].tolist()
                pattern = np.array([xxhash.xxh3_64_intdigest(ids[a:b]) for a, b in zip(ends, ends[1:])], dtype=np.uint64).view(np.int64)
                # what a task has sent once is in its output, with the first of its tiles
                known = np.zeros(len(pattern), dtype=bool)
                for i, x in enumerate(pattern.tolist()):
                    if x in sent:
                        known[i] = True
                    elif len(sent) < SENT:
                        sent.add(x)
                lengths = np.where(known, 0, np.diff(tiles["offsets"]))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids[np.repeat(~known, np.diff(tiles["offsets"]))], pa.int64()), mask=pa.array(known)
                )
                at = pa.array(tiles["text"] + begin)
                made = [batch.column("doc_id").take(at), batch.column("text_no").take(at), *(pa.array(tiles[c]) for c in ("first", "n", "times", "key", "tile")), pa.array(pattern), lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    # places ascend by text and first word
    found = materialise(numbered.mapInArrow(cut, schema).withColumn("place", F.monotonically_increasing_id()), "tiles")
    # a tile that follows itself reaches further; its linked passages hang together, as it has no more starts than one passage words
    at = found.select("doc_id", "text_no", "first", "tile", ((F.col("times") - 1) * F.col("n")).alias("reach"))
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lo_text").alias("lo_text"), F.max("hi_text").alias("hi_text"), F.max("n").alias("n"), F.max("key").alias("key")]
    each = found.select("tile", "pattern", "n", "key", F.col("place").alias("lo"), F.col("place").alias("hi"), F.col("text_no").alias("lo_text"), F.col("text_no").alias("hi_text"))
    kinds = each.groupBy("tile").agg(*ends, F.max("pattern").alias("pattern"))
    kinds = materialise(kinds.withColumn("copied", F.col("lo_text") < F.col("hi_text")), "kinds")
    patterns = kinds.groupBy("pattern").agg(*ends, F.min_by("tile", "lo").alias("lo_tile"), F.max_by("tile", "hi").alias("hi_tile"))
    patterns = patterns.join(found.where("ids is not null").select(F.col("place").alias("lo"), "ids"), "lo")
    patterns = materialise(patterns.withColumn("spread", F.col("lo_text") < F.col("hi_text")), "patterns")

    full = F.expr("shiftleft(1L, n) - 1")
    links = kinds.where("copied").select("tile", F.col("tile").alias("other"), full.alias("mask"), F.lit(0).alias("i"), (F.col("n") - 1).alias("z"), F.lit(0).alias("j"), F.lit(True).alias("exact"))
    heads = patterns.groupBy("key").agg(F.max(F.struct("spread", "n", "pattern")).alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.col("head.pattern").alias("head"))
    pairs = patterns.select("key", "pattern").join(heads, "key").where("pattern <> head").select(F.least("pattern", "head").alias("a"), F.greatest("pattern", "head").alias("b"))
    # tiles of one pattern are equal if all their shingles are shared, and have to be compared otherwise
    alike = patterns.where("spread and array_min(ids) < 0").select(F.col("pattern").alias("a"), F.col("pattern").alias("b"))
    compared = materialise(pairs.unionAll(alike), "pairs")
    report["under one minimum"] = compared.count()
    links = links.unionAll(_verified(compared, patterns, kinds, bound))
    known = _labelled(None, links, at, width)
    entries = _entries(patterns, shared, bound)
    entries = _open_entries(entries, patterns, kinds, known)
    more = materialise(_candidates(entries, patterns, bound).join(compared, ["a", "b"], "left_anti"), "pairs")
    report["all that is left"] = more.count()
    if report["all that is left"]:
        links = links.unionAll(_verified(more, patterns, kinds, bound))
        known = _labelled(known, links, at, width)
    return _passages(found, at, known, links, kinds, width)


def _verified(pairs: DataFrame, patterns: DataFrame, kinds: DataFrame, bound: Bound) -> DataFrame:
    """(tile, other, mask, i, z, j, exact) of tiles whose patterns are a pair a, b with similar passages, from both sides: the
    tile's linked passages as bits, the first and last of them, and a passage of the other that the first is linked with.

    A tile is linked with all of the other pattern that other texts have. Two of these stand for them, in the first and in
    the last text that has the pattern: what links join is the same.
    """

    def side(short: str) -> DataFrame:
        same = F.when(~F.col("spread"), F.col("lo_text"))
        return patterns.select(F.col("pattern").alias(short), same.alias(f"{short}_only"), F.col("ids").alias(f"{short}_ids"))

    schema = StructType.fromDDL("a bigint, b bigint, h array<bigint>")
    arrow = to_arrow_schema(schema)
    together = min(PAIRS, 1 << (62 - ID_BITS - place_bits(bound.t)))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, together):
                batch = whole.slice(k, together)
                sides = []
                for name in ("a_ids", "b_ids"):
                    ids = batch.column(name)
                    ends = ids.offsets.to_numpy().astype(np.int64)
                    sides.append(Side(ids.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0], bound.t))
                rows, facts = compare(*sides, bound)
                if len(rows):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 10, pa.int32()), pa.array(facts.ravel(), pa.int64()))
                    pair = [batch.column(c).take(pa.array(rows)) for c in "ab"]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*pair, lists], arrow)], schema=arrow)

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    # both within one and the same text: no other text is involved
    joined = joined.where(~F.coalesce(F.col("a_only") == F.col("b_only"), F.lit(False)))
    hits = materialise(joined.select("a", "b", "a_ids", "b_ids").mapInArrow(similar, schema), "links")

    def seen(pattern: str, other: str, k: int) -> DataFrame:
        numbers = [F.col("h")[k + c] for c in range(5)]
        return hits.select(
            F.col(pattern).alias("pattern"), F.col(other).alias("with"), numbers[0].alias("mask"), numbers[1].cast("int").alias("i"),
            numbers[2].cast("int").alias("z"), numbers[3].cast("int").alias("j"), (numbers[4] == 1).alias("exact"),
        )

    both = seen("a", "b", 0).unionAll(seen("b", "a", 5))
    end = lambda x: F.struct(F.col(f"{x}_text").alias("text_no"), F.col(f"{x}_tile").alias("tile"))
    ends = patterns.select(F.col("pattern").alias("with"), F.array_distinct(F.array(end("lo"), end("hi"))).alias("ends"))
    only = F.when(~F.col("copied"), F.col("lo_text")).alias("only")
    tiles = both.join(ends, "with").join(kinds.select("pattern", "tile", only), "pattern").withColumn("end", F.explode("ends"))
    tiles = tiles.where(F.col("only").isNull() | (F.col("only") != F.col("end.text_no")))
    return materialise(tiles.select("tile", F.col("end.tile").alias("other"), "mask", "i", "z", "j", "exact"), "tile-links")


def _labelled(known: DataFrame | None, links: DataFrame, at: DataFrame, width: int) -> DataFrame:
    """(tile, mask, i, z, label) of the linked tiles. Tiles of one label are joined by links, or by linked words that hang
    together in a text."""
    linked = materialise(links.groupBy("tile").agg(F.expr("bit_or(mask)").alias("mask"), F.min("i").alias("i"), F.max("z").alias("z")), "linked")
    along = Window.partitionBy("text_no").orderBy("from")
    spans = at.join(linked, "tile").select("text_no", "tile", (F.col("first") + F.col("i")).alias("from"), (F.col("first") + F.col("reach") + F.col("z")).alias("to"))
    spans = spans.withColumn("new", F.coalesce((F.col("from") - F.lag("to").over(along) >= width).cast("int"), F.lit(1)))
    spans = spans.withColumn("part", F.sum("new").over(along))
    # all tiles of a passage are joined with its smallest, so that no chain is as long as a passage
    spans = spans.select("tile", F.min("tile").over(Window.partitionBy("text_no", "part")).alias("least")).where("tile <> least")
    edges = links.select(F.col("tile").alias("a"), F.col("other").alias("b")).unionAll(spans.select(F.col("tile").alias("a"), F.col("least").alias("b"))).where("a <> b")
    if known is not None:
        # what had a label stands for all that have it
        old = known.select("tile", "label")
        edges = edges.join(old.select(F.col("tile").alias("a"), F.col("label").alias("a_label")), "a", "left").join(old.select(F.col("tile").alias("b"), F.col("label").alias("b_label")), "b", "left")
        edges = edges.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
        linked = linked.join(old, "tile", "left").withColumn("node", F.coalesce("label", "tile")).drop("label")
    else:
        linked = linked.withColumn("node", F.col("tile"))
    joined = connected(edges).withColumnRenamed("component", "label")
    return materialise(linked.join(joined, "node", "left").select("tile", "mask", "i", "z", F.coalesce("label", "node").alias("label")), "labels")


def _entries(patterns: DataFrame, shared: Shingles, bound: Bound) -> DataFrame:
    """What :func:`prefixes` finds for every pattern."""
    schema = StructType.fromDDL("pattern bigint, shingle bigint, family int, repeats boolean, mask bigint")
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pattern, ids = batch.column("pattern").to_numpy(zero_copy_only=False), batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            for who, shingle, family, repeats, mask in prefixes([values[a:b] for a, b in zip(ends, ends[1:])], shared, bound):
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip((pattern[who], shingle, family, repeats, mask), arrow)], schema=arrow)

    return materialise(patterns.select("pattern", "ids").mapInArrow(work, schema), "entries")


def _open_entries(entries: DataFrame, patterns: DataFrame, kinds: DataFrame, known: DataFrame) -> DataFrame:
    """The entries of shingles by which something may still be found: with the least and largest class of the pattern's tiles,
    and whether a passage that has the shingle there is not linked yet."""
    label = F.coalesce("label", "tile")
    state = kinds.select("tile", "pattern").join(known.select("tile", "mask", "label"), "tile", "left").groupBy("pattern")
    state = state.agg(F.expr("bit_and(coalesce(mask, 0L))").alias("linked"), F.min(label).alias("low"), F.max(label).alias("high"))
    state = state.join(patterns.select("pattern", "lo_text", "hi_text"), "pattern")
    open_ = F.col("mask").bitwiseAND(F.bitwise_not("linked")) != 0
    told = ["pattern", "repeats", "low", "high", "open", "lo_text", "hi_text"]
    by = ["family", "shingle"]
    entries = entries.join(state, "pattern").withColumn("open", open_).select(*by, *told)
    groups = entries.groupBy(*by).agg(
        F.min("low").alias("least"), F.max("high").alias("most"), F.max("open").alias("some"), F.max("repeats").alias("odd"), F.count(F.lit(1)).alias("m"),
        F.min("lo_text").alias("from"), F.max("hi_text").alias("to"),
    )
    # nothing is to be found in one text, nor in one class that has no passage left
    groups = groups.where("m > 1 and (least <> most or some) and (family = 0 or odd) and from < to").select(*by)
    return materialise(entries.join(groups, by, "left_semi"), "entries-left")


def _candidates(entries: DataFrame, patterns: DataFrame, bound: Bound) -> DataFrame:
    """Pairs a < b of patterns that share a shingle of their prefixes and may still tell something: their tiles are not of one
    class, or a passage that has the shingle there is not linked yet. Pairs within one text and pairs that lack too many of
    each other's shingles are none."""
    left = entries.join(materialise(_sketches(entries, patterns, bound), "sketches"), "pattern")
    x, y = left.alias("x"), left.alias("y")
    # of two passages without repeats each lacks at most t - both() shingles of the other
    lacks = lambda u, v, most: sum(F.bit_count(F.col(f"{u}.s{k}").bitwiseAND(F.bitwise_not(f"{v}.s{k}"))) for k in range(SKETCH)) + F.col(f"{u}.lacks") <= most
    may = (F.col("x.low") != F.col("y.high")) | (F.col("x.high") != F.col("y.low")) | F.col("x.open") | F.col("y.open")
    apart = (F.col("x.lo_text") != F.col("y.hi_text")) | (F.col("x.hi_text") != F.col("y.lo_text"))
    tell = lambda most: (F.col("x.shingle") == F.col("y.shingle")) & may & apart & lacks("x", "y", most) & lacks("y", "x", most)
    plain = x.where("family = 0").join(y.where("family = 0"), tell(bound.t - bound.both()) & (F.col("x.pattern") < F.col("y.pattern")))
    odd = x.where("family = 1 and repeats").join(y.where("family = 1"), tell(bound.t - bound.alone(bound.t)) & (F.col("x.pattern") != F.col("y.pattern")))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return plain.unionAll(odd).select(*pair("x.pattern", "y.pattern")).distinct()


def _sketches(some: DataFrame, patterns: DataFrame, bound: Bound) -> DataFrame:
    """(pattern, lacks, s0, s1, ...): a map of the shared shingles of each of some patterns, and how many different ones are its
    own, less those that a passage in it need not have."""
    schema = StructType.fromDDL("pattern bigint, lacks int, " + ", ".join(f"s{k} bigint" for k in range(SKETCH)))
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy().astype(np.int64)
            values = ids.values.to_numpy()[ends[0] : ends[-1]]
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            shared = values >= 0
            flags = np.zeros((batch.num_rows, 64 * SKETCH), dtype=bool)
            flags[row[shared], (mix(values[shared].view(np.uint64)) % np.uint64(64 * SKETCH)).astype(np.int64)] = True
            maps = np.packbits(flags, axis=1, bitorder="little").view(np.int64)
            own = np.unique(row[~shared] << 32 | -values[~shared])
            lacks = np.bincount(own >> 32, minlength=batch.num_rows) - (np.diff(ends) - bound.t)
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip((batch.column("pattern"), lacks, *maps.T), arrow)], schema=arrow)

    return patterns.join(some.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "ids").mapInArrow(work, schema)


def _passages(found: DataFrame, at: DataFrame, known: DataFrame, links: DataFrame, kinds: DataFrame, width: int) -> DataFrame:
    ends = lambda: kinds.select(F.col("tile").alias("other"), "lo", "hi", "lo_text")
    # what the first linked passage of a tile goes with: word for word if there is such a link, a copy of the tile before all
    best = links.groupBy("tile").agg(F.min(F.struct("i", (~F.col("exact")).alias("near"), (F.col("other") != F.col("tile")).alias("from_other"), "other", "j")).alias("w"))
    best = best.select("tile", F.col("w.other").alias("other"), F.col("w.j").alias("j"), F.col("w.near").alias("near")).join(ends(), "other")
    spans = at.join(known.select("tile", "i", "z", "label"), "tile").join(best.select("tile", "j", "near", "lo", "hi", "lo_text"), "tile")
    # an occurrence of the other in another text
    to = F.when(F.col("lo_text") == F.col("text_no"), F.col("hi")).otherwise(F.col("lo"))
    spans = spans.select("text_no", "doc_id", (F.col("first") + F.col("i")).alias("from"), (F.col("first") + F.col("reach") + F.col("z")).alias("to"), "label", to.alias("other"), "j", "near")
    along = Window.partitionBy("text_no").orderBy("from")
    spans = spans.withColumn("new", F.coalesce((F.col("from") - F.lag("to").over(along) >= width).cast("int"), F.lit(1)))
    spans = spans.withColumn("part", F.sum("new").over(along))
    whole = spans.groupBy("text_no", "part").agg(
        F.first("doc_id").alias("doc_id"), F.min("from").alias("from"), F.max("to").alias("to"), F.min("label").alias("label"), F.min(F.struct("from", "other", "j", "near")).alias("w")
    )
    whole = materialise(whole, "passages")
    classes = whole.groupBy("label").agg(F.min(F.struct("doc_id", "from")).alias("head"))
    others = found.select(F.col("place").alias("other"), F.col("doc_id").alias("other_id"), F.col("first").alias("other_first"))
    return whole.withColumn("other", F.col("w.other")).join(others, "other").join(classes, "label").select(
        "doc_id",
        F.col("from").cast("long").alias("first_word"),
        (F.col("to") + width - 1).cast("long").alias("last_word"),
        F.col("head.doc_id").alias("class_id"),
        F.col("head.from").cast("long").alias("class_word"),
        "other_id",
        (F.col("other_first") + F.col("w.j")).cast("long").alias("other_word"),
        (~F.col("w.near")).alias("exact"),
    )
