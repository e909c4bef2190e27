"""Phrases whose words go together more than their parts do, from counting quotient filters.

1. One pass over the texts turns words into numbers local to a *chunk* (the texts of one language that a task has read
   until a fixed number of words) and writes numbers and word counts.
2. Word counts are summed over chunks. A phrase that is frequent enough has only frequent words, so these alone get
   global numbers; a join brings them to the chunks.
3. A chunk packs the numbers of each phrase side by side, permutes the packed number invertibly (so that frequent
   words do not crowd any range) and counts. The upper bits of the result are the quotient, which a filter knows by
   place; the lower bits are the remainder, which it stores in full. Nothing is lost: the permutation can be undone.
4. Filters are sorted by construction. Those of equal buckets (the top bits) are merged, in two rounds where there are
   many, and the phrases that are frequent over all chunks come out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.llm.text import small_batches
from trialloom.session import materialise

#: Words of one language that make a chunk, and words of all languages that a task holds.
CHUNK_WORDS, HELD_WORDS = 500_000, 1_000_000
#: Distinct phrases that one merge is meant to hold, and the most buckets that a round of merging deals to.
BUCKET_ENTRIES, ROUND_BUCKETS = 2_000_000, 512
#: Lanes by the hash of a phrase in which the best phrases of a language are found before they meet.
LANES = 64
#: Ranges of the hash of a word within which words are numbered.
NUMBER_RANGES = 1024

_pieces = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+")
#: What ends a piece, as the first byte of a token; such a token has number 0 in a chunk.
_BREAKS = b".,;:!?\n\x0b\x0c\r"


# packed numbers and filters ------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Packing:
    """Packs ``size`` numbers of ``bits`` bits into one of at most 128 and permutes the result invertibly.

    The two halves of the packed number go through four rounds in which one half is changed by a function of the other
    (a Feistel network); any function will do, and the inverse runs the rounds backwards. Results are pairs of
    64-bit words, the upper one first.
    """

    size: int
    bits: int
    rounds = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)

    def __post_init__(self) -> None:
        if self.half > 63:
            raise ValueError("phrases of this length do not fit into 126 bits")

    @property
    def half(self) -> int:
        return max(4, -(-self.size * self.bits // 2))

    @property
    def total(self) -> int:
        return 2 * self.half

    def _round(self, x: np.ndarray, k: int) -> np.ndarray:
        x = (x ^ (x >> np.uint64(29))) * np.uint64(self.rounds[k]) + np.uint64(k + 1)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(31))) & np.uint64((1 << self.half) - 1)

    def pack(self, numbers: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left = right = np.zeros(len(numbers[0]), np.uint64)
        mask, one, rest = np.uint64((1 << self.half) - 1), np.uint64(self.bits), np.uint64(self.half - self.bits)
        for x in numbers:
            left = ((left << one) | (right >> rest)) & mask
            right = ((right << one) & mask) | x.astype(np.uint64)
        for k in range(4):
            left, right = right, left ^ self._round(right, k)
        return left >> np.uint64(64 - self.half), (left << np.uint64(self.half)) | right

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        mask, one, rest = np.uint64((1 << self.half) - 1), np.uint64(self.bits), np.uint64(self.half - self.bits)
        left, right = ((high << np.uint64(64 - self.half)) | (low >> np.uint64(self.half))) & mask, low & mask
        for k in range(3, -1, -1):
            left, right = right ^ self._round(left, k), left
        out = []
        for _ in range(self.size):
            out.append((right & np.uint64((1 << self.bits) - 1)).astype(np.int64))
            right = (right >> one) | ((left << rest) & mask)
            left = left >> one
        return out[::-1]


def _shifted(high: np.ndarray, low: np.ndarray, by: int) -> np.ndarray:
    """The lower 64 bits of a pair shifted right."""
    if by >= 64:
        return high >> np.uint64(by - 64)
    return low if by == 0 else (low >> np.uint64(by)) | (high << np.uint64(64 - by))


def counted(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order with summed counts. The sort is one that merges runs which are in order already."""
    order = np.lexsort((low, high)) if high.any() else np.argsort(low, kind="stable")
    high, low, counts = high[order], low[order], counts[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    at = np.flatnonzero(new)
    return high[at], low[at], np.add.reduceat(counts, at) if len(at) else counts


def make_filter(high: np.ndarray, low: np.ndarray, counts: np.ndarray, total: int, bucket_bits: int) -> bytes:
    """A counting quotient filter of distinct pairs in order that share their upper ``bucket_bits``.

    Below the bucket come the quotient, then the remainder of whole bytes. Stored are one bit for each quotient
    (occupied or not), one bit for each entry (last of its quotient or not), the remainders, one bit for each entry
    (counted more than once or not), and for the latter the count less two in one byte, or eight more where it is large.
    """
    n, rest = len(low), total - bucket_bits
    stored = min(rest // 8, -(-max(0, rest - n.bit_length() + 1) // 8))
    slots = rest - 8 * stored
    quotient = (_shifted(high, low, 8 * stored) & np.uint64((1 << slots) - 1)).astype(np.int64)
    occupied = np.zeros(1 << slots, bool)
    occupied[quotient] = True
    words = np.stack([low, high], axis=1).view(np.uint8).reshape(n, 16)
    more = counts > 1
    extra = (counts[more] - 2).astype(np.uint64)
    large = extra >= 255
    return b"".join(
        (
            np.array([n, stored, slots], np.int64).tobytes(),
            np.packbits(occupied).tobytes(),
            np.packbits(np.diff(quotient, append=-1) != 0).tobytes(),
            words[:, :stored].T.tobytes(),
            np.packbits(more).tobytes(),
            np.minimum(extra, 255).astype(np.uint8).tobytes(),
            extra[large].tobytes(),
        )
    )


def read_filter(blob: bytes, total: int, bucket_bits: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a filter in order, and their counts."""
    n, stored, slots = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    raw, at = np.frombuffer(blob, np.uint8), 24

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return raw[at - size : at]

    occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << slots) // 8)), count=1 << slots))
    last = np.flatnonzero(np.unpackbits(take(-(-n // 8)), count=n))
    words = np.zeros((n, 16), np.uint8)
    words[:, :stored] = take(n * stored).reshape(stored, n).T
    more = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
    extra = take(int(more.sum())).astype(np.uint64)
    extra[extra == 255] = np.frombuffer(take(8 * int((extra == 255).sum())).tobytes(), np.uint64)
    counts = np.ones(n, np.int64)
    counts[more] = extra.astype(np.int64) + 2
    pairs = words.view(np.uint64)
    low, high = pairs[:, 0].copy(), pairs[:, 1].copy()
    quotient = np.repeat(occupied, np.diff(last, prepend=-1)).astype(np.uint64) | np.uint64(bucket << slots)
    shift = 8 * stored
    if shift >= 64:
        high |= quotient << np.uint64(shift - 64)
    else:
        low |= quotient << np.uint64(shift)
        high |= quotient >> np.uint64(64 - shift) if shift else np.uint64(0)
    return high, low, counts


def by_bucket(high: np.ndarray, low: np.ndarray, counts: np.ndarray, total: int, bucket_bits: int) -> Iterator[tuple[int, bytes]]:
    """One filter for each bucket of distinct pairs in order."""
    bucket = _shifted(high, low, total - bucket_bits).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(at, [*at[1:], len(bucket)]):
        yield int(bucket[a]), make_filter(high[a:b], low[a:b], counts[a:b], total, bucket_bits)


def merge_filters(blobs: Sequence[bytes], total: int, bucket_bits: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [read_filter(b, total, bucket_bits, bucket) for b in blobs]
    return counted(*(np.concatenate(c) for c in zip(*parts)))


# the passes over the corpus ------------------------------------------------------------------------------------------
class _LocalNumbers(dict):
    """Numbers of a chunk's words from 1 on; 0 for what ends a piece."""

    def __init__(self) -> None:
        self.words: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        if token[0] in _BREAKS:
            self[token] = 0
            return 0
        self.words.append(token)
        self[token] = len(self.words)
        return len(self.words)


CHUNKS = "chunk string, lang string, words array<string>, counts array<bigint>, numbers binary"


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of numbered words; every text ends a piece."""
    part, made = TaskContext.get().partitionId(), 0
    open_: dict[str, tuple[_LocalNumbers, list[np.ndarray]]] = {}
    size: dict[str, int] = {}

    def close(lang: str) -> pa.RecordBatch:
        nonlocal made
        known, parts = open_.pop(lang)
        size.pop(lang)
        numbers = np.concatenate(parts)
        counts = np.bincount(numbers, minlength=len(known.words) + 1)[1:]
        made += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f"{part}-{made}"]),
                pa.array([lang]),
                pa.array([[w.decode() for w in known.words]], pa.list_(pa.string())),
                pa.array([counts.tolist()], pa.list_(pa.int64())),
                pa.array([zstandard.compress(numbers.tobytes(), 1)], pa.binary()),
            ],
            names=["chunk", "lang", "words", "counts", "numbers"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            if lang not in open_:
                open_[lang], size[lang] = (_LocalNumbers(), []), 0
            known, parts = open_[lang]
            numbers = np.fromiter(map(known.__getitem__, [*_pieces.findall(text.encode().lower()), b"."]), np.int32)
            parts.append(numbers)
            size[lang] += len(numbers)
            if size[lang] >= CHUNK_WORDS:
                yield close(lang)
            elif sum(size.values()) >= HELD_WORDS:
                yield close(max(size, key=size.get))
    for lang in list(open_):
        yield close(lang)


def _numbered(words: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """Frequent words of each language with numbers from 1 on that leave no gaps, and how many there are.

    A number is the place within a range of the hash plus the words of earlier ranges; of the latter there is a fixed
    number of sums.
    """
    span = F.pmod(F.xxhash64("lang", "word"), F.lit(NUMBER_RANGES)).cast("int")
    frequent = materialise(words.where(F.col("f") >= min_count).withColumn("span", span), "frequent-words")
    sizes = {r["span"]: r["n"] for r in frequent.groupBy("span").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(NUMBER_RANGES)])]).tolist()
    place = F.row_number().over(Window.partitionBy("span").orderBy("lang", "word"))
    start = F.element_at(F.lit(before), F.col("span") + 1)
    return frequent.withColumn("number", place + start).select("lang", "word", "f", "number"), before[-1]


def _chunk_filters(packings: Sequence[Packing], bucket_bits: int):
    """Filters of the phrases of each chunk, one for each length and bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, blob, local, number in batch.itertuples(index=False):
                numbers = np.frombuffer(zstandard.decompress(blob), np.int32)
                known = np.zeros(int(numbers.max(initial=0)) + 1, np.int64)
                known[np.asarray(local)] = number
                numbers = known[numbers]
                rows = []
                for p in packings:
                    inside = len(numbers) - p.size + 1
                    windows = [numbers[i : i + inside] for i in range(p.size)] if inside > 0 else []
                    at = np.flatnonzero(np.logical_and.reduce([w > 0 for w in windows])) if windows else []
                    if len(at):
                        found = counted(*p.pack([w[at] for w in windows]), np.ones(len(at), np.int64))
                        rows += [(chunk, p.size, b, f) for b, f in by_bucket(*found, p.total, bucket_bits)]
                yield pd.DataFrame(rows, columns=["chunk", "size", "bucket", "filter"])

    return run


FILTERS = "chunk string, size int, bucket long, filter binary"


def _merged_again(packings: dict[int, Packing], bucket_bits: int, next_bits: int):
    """Filters of one lane and bucket as filters of the finer buckets of the next round."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = packings[int(key[0])].total
        found = merge_filters(rows["filter"], total, bucket_bits, int(key[1]))
        return pd.DataFrame([(str(key[2]), key[0], b, f) for b, f in by_bucket(*found, total, next_bits)], columns=["chunk", "size", "bucket", "filter"])

    return run


def _frequent(packings: dict[int, Packing], bucket_bits: int, min_count: int):
    """The phrases of a bucket that all filters together count often enough."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = packings[int(key[0])]
        high, low, counts = merge_filters(rows["filter"], p.total, bucket_bits, int(key[1]))
        kept = counts >= min_count
        numbers = np.stack(p.unpack(high[kept], low[kept]), axis=1)
        return pd.DataFrame({"ids": pd.Series(list(numbers), dtype=object), "a": counts[kept]})

    return run


def frequent_phrases(docs: DataFrame, max_words: int, min_count: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (``ids``, ``a``), the frequent words (``lang``, ``word``, ``f``, ``number``), and words per
    language (``lang``, ``n``); all written in the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    chunks = materialise(texts.mapInArrow(_read_texts, CHUNKS), "chunks")
    each = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w"))
    each = each.select("chunk", "lang", (F.col("local") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    words = each.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    lengths = materialise(each.groupBy("lang").agg(F.sum("f").alias("n")), "language-sizes")
    vocabulary, distinct = _numbered(words, min_count)
    vocabulary = materialise(vocabulary, "numbered-words")

    packings = [Packing(size, distinct.bit_length()) for size in range(2, max_words + 1)]
    entries = (lengths.agg(F.sum("n")).first()[0] or 0) * (max_words - 1)
    bits = max(5, (entries // BUCKET_ENTRIES).bit_length())
    most = ROUND_BUCKETS.bit_length() - 1
    rounds = [*range(min(most, bits), bits, most), bits]

    own = each.join(vocabulary.select("lang", "word", "number"), ["lang", "word"])
    own = own.groupBy("chunk").agg(F.collect_list(F.struct("local", "number")).alias("own"))
    rows = chunks.select("chunk", "numbers").join(own, "chunk").select("chunk", "numbers", F.col("own.local").alias("local"), F.col("own.number").alias("number"))
    filters = rows.mapInPandas(_chunk_filters(packings, rounds[0]), FILTERS)
    packed = {p.size: p for p in packings}
    for now, then in zip(rounds, rounds[1:]):
        lane = F.pmod(F.xxhash64("chunk"), F.lit(1 << (bits - now))).alias("lane")
        filters = filters.groupBy("size", "bucket", lane).applyInPandas(_merged_again(packed, now, then), FILTERS)
    phrases = filters.groupBy("size", "bucket").applyInPandas(_frequent(packed, bits, min_count), "ids array<bigint>, a bigint")
    return materialise(phrases, "phrases"), vocabulary, lengths


# scores --------------------------------------------------------------------------------------------------------------
def exact_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole decimal numbers."""
    d = lambda c, digits: f"cast({c} as decimal({digits}, 0))"
    # any two longs have a product of 38 digits at most; a million times a square has them up to 15 digits
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * {d(a, 15)} * {d(a, 15)}) div ({d(left, 19)} * {d(right, 19)})")


def _scored(phrases: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """Phrases of one length with their words and their weakest cut."""
    rows = phrases.where(F.size("ids") == size)
    for i in range(size):
        word = vocabulary.select(F.col("number").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("f").alias(f"f0{i}1"), *([F.col("lang")] if i == 0 else []))
        rows = rows.withColumn(f"w{i}", F.col("ids")[i]).join(word, f"w{i}")
    part = lambda start, length: f"f0{start}{length}"
    for length in range(2, size):
        for start in {0, size - length}:
            name = part(start, length)
            shorter = phrases.where(F.size("ids") == length).select(F.col("ids").alias(f"p{name}"), F.col("a").alias(name))
            rows = rows.withColumn(f"p{name}", F.slice("ids", start + 1, length)).join(shorter, f"p{name}")
    cuts = [
        F.struct(exact_score("a", part(0, k), part(k, size - k)).alias("score"), F.lit(k).alias("k"), F.col(part(0, k)).alias("l"), F.col(part(k, size - k)).alias("r"))
        for k in range(1, size)
    ]
    return rows.select("lang", "ids", F.concat_ws(" ", *[f"t{i}" for i in range(size)]).alias("phrase"), "a", F.array_min(F.array(*cuts)).alias("cut"))


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, inside_percent: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs.
    ``a`` counts a phrase of 2 to ``max_words`` words, ``l`` and ``r`` the two parts of its weakest cut, ``n`` the
    words of its language; score is 1,000,000 a^2 / (l r), rounded down. Phrases seen less than ``min_count`` times are
    no candidates; those inside a longer candidate that has ``inside_percent`` of their count or more are left out. Order:
    score, then a, both falling, then the phrase by its bytes.

    A null language counts as ``und``; null and empty texts hold no words; repeated rows count as often as they occur; an
    empty table gives no rows. Other columns are not read.
    """
    phrases, vocabulary, lengths = frequent_phrases(docs, max_words, min_count, lang_col, text_col)
    scored = None
    for size in range(2, max_words + 1):
        rows = _scored(phrases, vocabulary, size)
        longer = None
        for more in range(size + 1, max_words + 1):
            parts = F.array(*[F.slice("ids", start + 1, size) for start in range(more - size + 1)])
            found = phrases.where(F.size("ids") == more).select(F.explode(parts).alias("ids"), F.col("a").alias("over"))
            longer = found if longer is None else longer.unionByName(found)
        if longer is not None:
            rows = rows.join(longer.groupBy("ids").agg(F.max("over").alias("over")), "ids", "left")
            rows = rows.where(F.coalesce(100 * F.col("over") < inside_percent * F.col("a"), F.lit(True))).drop("over")
        scored = rows if scored is None else scored.unionByName(rows)
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    # the best of each of a fixed number of lanes first, so that what one task gets of a language has a bound
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    lane = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(LANES))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(lane)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(lengths, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
