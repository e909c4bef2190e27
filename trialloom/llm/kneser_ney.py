"""An interpolated modified Kneser-Ney bigram model for scoring texts.

Tasks count the n-grams of their documents into sorted arrays and send one packed array per bucket; one task per bucket
merges them, so what is shuffled are n-gram types, not tokens. The merged counts are written as sorted hash arrays to
the shared folder and memory-mapped by the workers that score. The number of buckets grows with the corpus, so a bucket
does not. The followers of very frequent words are dealt over all buckets.

Words are known by 48 bits of their hash. A text is scored as its words and one end mark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.hash_tables import BITS, Shelf, SortedTable, bucket_of, mix, new_shelf, split_by_bucket, summed, unpack
from trialloom.llm.text import WordHashes, held_out, lower_words, map_texts, small_batches

BEGIN, END = 1, 2
#: Tokens counted together by a task before they are sent, tokens per bucket, and tokens scored together at least.
CHUNK, PER_BUCKET, BLOCK = 2_000_000, 1_000_000, 200_000
#: Tables that one task keeps mapped, below the 65,530 mappings that Linux allows a process by default.
MAPPED = 30_000


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(64 - BITS)


def token_keys(text: str | None, hashes: WordHashes) -> np.ndarray:
    found = hashes(lower_words(text)) >> np.uint64(64 - BITS)
    return np.append(found, np.uint64(END))


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts for counts 1, 2 and more, from the numbers of types with count 1 to 4."""
    if not (n[0] and n[1]):
        return (0.5, 0.75, 0.9)
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.9 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in zip((1, 2, 3), found))


@dataclass(frozen=True)
class Bigrams:
    """Where the arrays are, and the numbers that hold for all of them."""

    shelf: Shelf
    buckets: int
    tokens: int
    types: int
    pair_types: int
    word_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    word_gamma: float
    hot: np.ndarray
    hot_totals: np.ndarray

    def reader(self):
        tables: dict[tuple[str, int], tuple] = {}

        def opened(kind: str, number: int, names: tuple[str, ...]) -> tuple:
            """A table that stays mapped; those beyond the limit are mapped anew each time."""
            found = tables.get((kind, number))
            if found is None:
                t = SortedTable(self.shelf, f"{kind}/{number}")
                found = t, [t.values(n) for n in names]
                if len(tables) < MAPPED:
                    tables[kind, number] = found
            return found

        def look(kind: str, route: np.ndarray, keys: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
            """Values of keys, 0 where a key is unknown."""
            out = [np.zeros(len(keys), dtype=np.int64) for _ in names]
            bucket = bucket_of(route, self.buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for a, b in zip(at, [*at[1:], len(order)]):
                rows = order[a:b]
                t, arrays = opened(kind, int(bucket[rows[0]]), names)
                place = t.find(keys[rows])
                hit = place >= 0
                for o, v in zip(out, arrays):
                    o[rows[hit]] = v[place[hit]]
            return out

        return look

    def score(self, keys: np.ndarray, before: np.ndarray, look) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of tokens after their predecessors, and raw counts of the tokens."""
        words, at = np.unique(keys, return_inverse=True)
        (raw,) = look("words", words, words, ("count",))
        (left,) = look("left", words, words, ("count",))
        d = np.array([0.0, *self.word_discounts])
        low = np.maximum(left - d[np.minimum(left, 3)], 0.0) / max(1, self.pair_types) + self.word_gamma / (self.types + 1)
        pairs = pair_key(before, keys)
        is_hot = _is_in(before, self.hot)
        (count,) = look("pairs", np.where(is_hot, pairs, before), pairs, ("count",))
        count[count == 255] = look("many", np.where(is_hot, pairs, before)[count == 255], pairs[count == 255], ("count",))[0]
        contexts, where = np.unique(before, return_inverse=True)
        stats = np.stack(look("contexts", contexts, contexts, ("total", "once", "twice", "more")), axis=1)
        if len(self.hot):
            place = np.searchsorted(self.hot, contexts)
            hit = _is_in(contexts, self.hot)
            stats[hit] = self.hot_totals[place[hit]]
        d = np.array([0.0, *self.pair_discounts])
        total = stats[:, 0].astype(float)
        gamma = np.where(total > 0, stats[:, 1:] @ d[1:] / np.maximum(total, 1), 1.0)
        high = np.maximum(count - d[np.minimum(count, 3)], 0.0) / np.maximum(total, 1)[where]
        return np.log10(high + gamma[where] * low[at]), raw[at]


def _is_in(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(x), dtype=bool)
    return found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x


def fit(docs: DataFrame, text_col: str = "text", per_bucket: int = PER_BUCKET) -> Bigrams:
    """Count the bigrams of all texts and write the model. An empty table gives a model that knows no word."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // (6 * per_bucket)))
    shelf = new_shelf(spark, "bigrams")

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hashes, held, size = WordHashes(), [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append(token_keys(text, hashes))
                size += len(held[-1])
                if size >= CHUNK:
                    yield _with_before(held)
                    held, size = [], 0
        if held:
            yield _with_before(held)

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, _ in chunks(batches):
            found, counts = np.unique(keys, return_counts=True)
            yield pd.DataFrame(split_by_bucket(bucket_of(found, buckets), [found], counts), columns=["bucket", "part"])

    def merge_words(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        found = [unpack(p, 1) for p in parts["part"]]
        (keys,), counts = summed([np.concatenate([f[0][0] for f in found])], np.concatenate([f[1] for f in found]))
        SortedTable.write(shelf, f"words/{key[0]}", keys, count=narrow(counts))
        often = counts > per_bucket // 2
        return pd.DataFrame(
            {"bucket": key[0], "tokens": [counts.sum()], "types": [len(keys)], "hot": [keys[often].astype(np.int64)], "begins": [int(counts[keys == END].sum())]}
        )

    made = rows.mapInPandas(count_words, "bucket int, part binary").groupBy("bucket")
    made = made.applyInPandas(merge_words, "bucket int, tokens long, types long, hot array<bigint>, begins long").toPandas()
    # words with more than half a bucket of tokens: at most two for each bucket
    hot = np.array(sorted({int(h) for part in made["hot"] for h in part}), dtype=np.uint64)
    if made["begins"].sum() > per_bucket // 2:
        hot = np.unique(np.append(hot, np.uint64(BEGIN)))

    def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, before in chunks(batches):
            (first, second), counts = summed([before, keys], np.ones(len(keys), dtype=np.int64))
            route = np.where(_is_in(first, hot), pair_key(first, second), first)
            yield pd.DataFrame(split_by_bucket(bucket_of(route, buckets), [first, second], counts), columns=["bucket", "part"])

    def merge_pairs(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        found = [unpack(p, 2) for p in parts["part"]]
        (first, second), counts = summed([np.concatenate([f[0][k] for f in found]) for k in (0, 1)], np.concatenate([f[1] for f in found]))
        del found
        pairs = pair_key(first, second)
        order = np.argsort(pairs)
        SortedTable.write(shelf, f"pairs/{key[0]}", pairs[order], count=np.minimum(counts[order], 255).astype(np.uint8))
        many = order[counts[order] >= 255]
        SortedTable.write(shelf, f"many/{key[0]}", pairs[many], count=narrow(counts[many]))
        contexts, at = np.unique(first, return_inverse=True)
        stats = [np.bincount(at, weights=w, minlength=len(contexts)).astype(np.int64) for w in (counts, counts == 1, counts == 2, counts > 2)]
        own = ~_is_in(contexts, hot)
        SortedTable.write(shelf, f"contexts/{key[0]}", contexts[own], **{n: narrow(s[own]) for n, s in zip(("total", "once", "twice", "more"), stats)})
        words, lefts = np.unique(second, return_counts=True)
        out = pd.DataFrame(split_by_bucket(bucket_of(words, buckets), [words], lefts), columns=["bucket", "part"])
        extra = pd.DataFrame(
            {"bucket": [key[0]], "part": [None], "counts": [_counts_of_counts(counts)], "pairs": [len(counts)], "hot": [contexts[~own].astype(np.int64)], "stats": [np.concatenate([s[~own] for s in stats])]}
        )
        return pd.concat([out.assign(counts=None, pairs=0, hot=None, stats=None), extra])

    def merge_left(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        blobs = [p for p in parts["part"] if p is not None]
        found = [unpack(p, 1) for p in blobs] or [([np.zeros(0, np.uint64)], np.zeros(0, np.int64))]
        (keys,), counts = summed([np.concatenate([f[0][0] for f in found])], np.concatenate([f[1] for f in found]))
        SortedTable.write(shelf, f"left/{key[0]}", keys, count=narrow(counts))
        rest = parts[parts["part"].isna()].drop(columns="part")
        return pd.concat([rest.assign(left=None, left_more=0), pd.DataFrame({"bucket": [key[0]], "counts": [None], "pairs": [0], "hot": [None], "stats": [None], "left": [_counts_of_counts(counts)], "left_more": [int((counts > 2).sum())]})])

    numbers = "counts array<bigint>, pairs long, hot array<bigint>, stats array<bigint>"
    merged = rows.mapInPandas(count_pairs, "bucket int, part binary").groupBy("bucket").applyInPandas(merge_pairs, f"bucket int, part binary, {numbers}")
    # every bucket needs its file of left counts, also one without words
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast("binary").alias("part"), F.lit(None).cast("array<bigint>").alias("counts"), F.lit(0).cast("long").alias("pairs"), F.lit(None).cast("array<bigint>").alias("hot"), F.lit(None).cast("array<bigint>").alias("stats"))
    done = merged.unionAll(every).groupBy("bucket").applyInPandas(merge_left, f"bucket int, {numbers}, left array<bigint>, left_more long").toPandas()
    for kind, names in (("words", ("count",)), ("pairs", ("count",)), ("many", ("count",)), ("contexts", ("total", "once", "twice", "more"))):
        there = set(made["bucket"]) if kind == "words" else set(done.loc[done["pairs"] > 0, "bucket"])
        for b in set(range(buckets)) - {int(x) for x in there}:
            SortedTable.write(shelf, f"{kind}/{b}", np.zeros(0, np.uint64), **{n: np.zeros(0, np.uint32) for n in names})

    add = lambda column, width: sum((np.array(x, dtype=np.int64) for x in done[column] if x is not None), np.zeros(width, np.int64))
    pair_counts, left_counts = add("counts", 4).tolist(), add("left", 4).tolist()
    totals = {int(h): np.zeros(4, np.int64) for h in hot}
    for keys, stats in zip(done["hot"], done["stats"]):
        if keys is not None and len(keys):
            for h, s in zip(keys, np.array(stats, dtype=np.int64).reshape(4, -1).T):
                totals[int(h)] += s
    pair_types, word_d = int(done["pairs"].sum()), discounts(left_counts)
    gamma = (word_d[0] * left_counts[0] + word_d[1] * left_counts[1] + word_d[2] * int(done["left_more"].sum())) / pair_types if pair_types else 1.0
    return Bigrams(
        shelf, int(buckets), int(made["tokens"].sum()), int(made["types"].sum()), pair_types, word_d, discounts(pair_counts), float(gamma),
        hot, np.array([totals[int(h)] for h in hot], dtype=np.int64).reshape(-1, 4),
    )


def _with_before(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of several texts, and the token before each."""
    keys = np.concatenate(held)
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[np.cumsum([0, *[len(h) for h in held[:-1]]])] = BEGIN
    return keys, before


def perplexities(docs: DataFrame, model: Bigrams, id_col: str = "doc_id", text_col: str = "text", mod: int = 10) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``.

    ``score`` is the model's log10 probability of the text, ``base_score`` that of an additive word model. Null and empty
    texts are one end mark. Repeated rows and null ids are scored like any other; an empty table gives no rows.
    """
    n, v = model.tokens, model.types
    # tokens scored together look into most buckets, so their number grows with these
    block = max(BLOCK, 400 * model.buckets)

    def start():
        hashes, look = WordHashes(), model.reader()

        def work(texts: list) -> dict:
            out = {c: [] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")}
            held, size = [], 0
            for i, text in enumerate(texts):
                held.append(token_keys(text, hashes))
                size += len(held[-1])
                if size < block and i + 1 < len(texts):
                    continue
                logs, raw = model.score(*_with_before(held), look)
                base = np.log10((raw + 0.1) / (n + 0.1 * (v + 1)))
                lengths = np.array([len(h) for h in held])
                at = np.cumsum(lengths) - lengths
                score = np.add.reduceat(logs, at)
                for c, values in (("n_tokens", lengths), ("n_known", np.add.reduceat((raw > 0).astype(np.int64), at)), ("train_tokens", np.full(len(at), n)), ("base_score", np.add.reduceat(base, at)), ("score", score), ("perplexity", 10.0 ** (-score / lengths))):
                    out[c] += values.tolist()
                held, size = [], 0
            return out

        return work

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, mod).alias("held_out"), F.col(text_col).alias("text"))
    return map_texts(rows, start, "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
