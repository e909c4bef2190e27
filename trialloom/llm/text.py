"""Words, hold-out rule and small helpers shared by the text operators.

A word is a run of characters other than the six ASCII blanks; lower-casing touches A-Z only. Null texts count as
empty texts everywhere.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall
#: Words remembered with their hash by one task; the memory is emptied when full.
CACHE_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most ``rows``, so that a worker's memory does not follow the session's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def words(text: Column | str, lower: bool = False) -> Column:
    """The words of a text as an array, by built-in functions; empty for a null text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if lower:
        text = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def held_out(id_col: Column | str, mod: int = 5) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of ``mod``.

    A null id counts as held out: no label can belong to it.
    """
    key = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    return F.coalesce(F.crc32(key.cast("binary")) % mod == 0, F.lit(True))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}{k}"
    return name


def map_texts(rows: DataFrame, start: Callable[[], Callable[[list], dict]], added: str, text_col: str = "text") -> DataFrame:
    """``rows`` with the text column replaced by the columns that ``added`` declares.

    ``start`` is called once for each task and gives a function from a list of texts to a dict of columns. The other
    columns go through as Arrow arrays, so ids keep their type and their nulls.
    """
    small_batches(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != text_col]
    schema = StructType([*kept, *StructType.fromDDL(added).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            made = work(batch.column(text_col).to_pylist())
            same = [batch.column(f.name).cast(arrow.field(f.name).type) for f in kept]
            new = [made[f.name].cast(f.type) if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in list(arrow)[len(kept) :]]
            yield pa.RecordBatch.from_arrays([*same, *new], schema=arrow)

    return rows.mapInArrow(run, schema)


def lower_words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as bytes: ``bytes.lower`` and ``bytes.split`` know just A-Z and the six blanks."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, with a bounded memory of the words seen last."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, found: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


#: Words that are worked on together.
BLOCK_WORDS = 200_000


def word_blocks(texts: list, hashes: WordHashes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, offsets, word hashes) of runs of texts of about BLOCK_WORDS words."""
    first, held, lengths, size = 0, [], [], 0
    for i, text in enumerate(texts):
        found = lower_words(text)
        held += found
        lengths.append(len(found))
        size += len(found)
        if size >= BLOCK_WORDS or i + 1 == len(texts):
            yield first, i + 1, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), hashes(held)
            first, held, lengths, size = i + 1, [], [], 0


_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: Longer words are hashed one by one.
LONG_WORD = 32


class TextHashes:
    """64-bit hashes of the words of several texts, all words at once."""

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return self.split(texts)[1]

    def split(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, hashes): the words of text i are those from offsets[i] up to offsets[i + 1]."""
        joined = b" ".join([*texts, b" " * 8])
        letters = np.frombuffer(joined, dtype=np.uint8)
        blank = _BLANKS[letters]
        change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            change = np.concatenate([[0], change])
        begin, length = change[::2], change[1::2] - change[::2]
        eight = np.ndarray(len(joined) - 7, dtype="<u8", buffer=joined, strides=(1,))
        value, open_ = length.astype(np.uint64), np.flatnonzero(length <= LONG_WORD)
        for k in range(0, LONG_WORD, 8):
            left = length[open_] - k
            part = eight[begin[open_] + k]
            part &= ~np.uint64(0) >> (np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64))
            value[open_] = mixed(value[open_] * np.uint64(0x9E3779B97F4A7C15) + part)
            open_ = open_[left > 8]
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            value[i] = xxhash.xxh3_64_intdigest(joined[begin[i] : begin[i] + length[i]])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        return np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)])).astype(np.int64), value


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of each value spread over all of it, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_blocks(texts: list, hashes: TextHashes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What :func:`word_blocks` gives, with the hashes of :class:`TextHashes`; a block has about as many words."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.encode().lower() if text else b"")
        size += len(held[-1])
        if size >= 6 * BLOCK_WORDS or i + 1 == len(texts):
            yield first, i + 1, *hashes.split(held)
            first, held, size = i + 1, [], 0


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", mod: int = 5
) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled training documents of each class, by hash of their id: (id, text, label),
    and how many labels of each class there are to learn from.

    The choice depends on ids alone, so a rerun takes the same rows. Ids with several labels count by the largest,
    ids with several texts by the smallest text; rows without id or label are no examples.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id", mod))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit("sample"), "id")
    # two lists of at most per_class ids: a size fixed by a parameter, so they can be broadcast
    chosen = known.where("label = 0").orderBy(order, "id").limit(per_class).unionAll(known.where("label = 1").orderBy(order, "id").limit(per_class))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return found.select("id", "text", "label"), totals
