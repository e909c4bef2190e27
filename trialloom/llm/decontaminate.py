"""Benchmark passages in documents, found by spaced-seed hashing; built-in functions only.

A seed is a fixed mask over a few consecutive words: the words at its kept positions are hashed, the others may differ.
Seeds of the documents and of the benchmark are joined on mask and hash. A hit fixes how document and item line up; on
this line the words are compared, and the pair counts when some ``WINDOW`` consecutive words hold ``MATCHED`` equal
ones. The masks are chosen so that every such window holds the kept words of at least one mask unharmed (checked in the
tests), so the seeds lose nothing.

Before hashing, windows are passed over whose kept words are not all in the benchmark's vocabulary. The vocabulary is a
bit table of fixed size; false positives cost a hash and nothing else.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.text import fresh, words

WINDOW, MATCHED = 13, 11
#: Kept positions of each mask.
MASKS = ((0, 1, 3, 4, 5, 6, 7), (0, 1, 2, 4, 6, 9, 10), (0, 1, 2, 3, 6, 7, 9))
VOCABULARY_BITS = 1 << 18


def _vocabulary(items: DataFrame) -> Column:
    """The bit table of all words of the benchmark, as a constant array of VOCABULARY_BITS / 64 numbers."""
    bit = F.pmod("word", F.lit(VOCABULARY_BITS)).cast("int")
    rows = items.select(F.explode("words").alias("word")).select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at"))
    rows = rows.agg(F.expr("bit_or(shiftleft(1L, bit & 63))").alias("bits")).collect()
    table = [0] * (VOCABULARY_BITS // 64)
    for r in rows:
        table[r["at"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _hashes(text: str) -> Column:
    return F.transform(words(text, lower=True), lambda w: F.xxhash64(w))


def _seeds_of(hashes: str, allowed: str | None, number: int, mask: tuple[int, ...]) -> Column:
    last = F.size(hashes) - (mask[-1] + 1)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    if allowed:
        # most windows fail at the first or second kept word
        places = F.filter(places, lambda i: reduce(and_, [F.get(allowed, i + k) for k in mask]))
    seed = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in mask])
    return F.transform(places, lambda i: F.struct(F.lit(number).alias("mask"), i.alias("pos"), seed(i).alias("seed")))


def _seeds(hashes: str, allowed: str | None = None) -> Column:
    """(mask, pos, seed) of every window of a text whose kept words are allowed."""
    return F.concat(*[_seeds_of(hashes, allowed, number, mask) for number, mask in enumerate(MASKS)])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: ``doc_id``, ``item_id``, ``n_lines``, ``n_matched``.

    ``n_lines`` counts the ways to line them up that qualify, ``n_matched`` is the most equal words on one of them.
    Texts shorter than WINDOW words on either side never overlap; null texts are empty. Rows that repeat an id are
    taken together; null ids are an id of their own. Empty tables give no rows. Other columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), _hashes(text_col).alias("words")).where(F.size("words") >= WINDOW).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "words"))
    rows = docs.select(F.col(id_col).alias("doc_id"), _hashes(text_col).alias("words")).where(F.size("words") >= WINDOW)
    table = _vocabulary(items)

    def known(h):
        bit = F.pmod(h, F.lit(VOCABULARY_BITS)).cast("int")
        return F.getbit(F.get(table, F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1

    seeds = rows.withColumn("allowed", F.transform("words", known)).select("doc_id", F.inline(_seeds("words", "allowed")))
    targets = items.select("item", F.inline(_seeds("words"))).withColumnRenamed("pos", "item_pos")
    lines = seeds.join(targets, ["mask", "seed"]).select("doc_id", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    lines = lines.join(items.withColumnRenamed("words", "theirs"), "item")
    wanted = lines.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "theirs", "shift")).alias("lines")).withColumnRenamed("doc_id", "found_id")

    def compared(line):
        theirs, shift = line["theirs"], line["shift"]
        places = F.sequence(F.lit(0), F.size(theirs) - 1)
        matched = F.filter(places, lambda i: F.get("words", i + shift) == F.get(theirs, i))
        shared = F.least(F.size(theirs), F.size("words") - shift) - F.greatest(F.lit(0), -shift)
        return F.struct(line["item_id"].alias("item_id"), matched.alias("matched"), shared.alias("shared"))

    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("found_id"))).select("doc_id", F.inline(F.transform("lines", compared)))
    found = found.where((F.col("shared") >= WINDOW) & (F.size("matched") >= MATCHED))
    firsts = F.sequence(F.lit(0), F.size("matched") - MATCHED)
    dense = F.exists(firsts, lambda j: F.get("matched", j + (MATCHED - 1)) - F.get("matched", j) < WINDOW)
    found = found.where(dense).groupBy("doc_id", "item_id")
    return found.agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.size("matched")).cast("long").alias("n_matched"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names: str) -> DataFrame:
    """The rows of ``docs`` whose id has no overlap with the benchmark, columns as they were."""
    hit = overlaps(docs, benchmark, id_col, **names).select(F.col("doc_id").alias(gone := fresh(docs, "contaminated"))).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col(gone)), "left_anti")
