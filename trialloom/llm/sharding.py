"""Rendezvous hashing of record keys over weighted shards.

Every shard bids ``-ln(u) / weight`` for a key, with ``u`` from the md5 of key and shard number; the lowest bid wins. A
key's shard depends on the key and the shard weights alone, each shard gets its share of the weights, and a further
shard only takes keys that now bid lowest for it.

Slots number the rows of a shard without gaps. A shard may be very large, so it is cut into cells by the hash of key
and text; a row's slot is the number of rows in earlier cells plus its place in its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.llm.text import fresh

ROWS_PER_CELL = 50_000


def unit(value: Column) -> Column:
    """A number strictly between 0 and 1 from the md5 of a string (52 bits)."""
    return (F.conv(F.substring(F.md5(value.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def record_key(id_col: Column | str) -> Column:
    """The id as text; null ids share one key of their own."""
    return F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit("null id"))


def winning_shard(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard with the lowest bid; the lower number in a tie. Weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    shares = F.array(*[F.lit(float(w)) for w in weights])
    bids = F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda s: F.struct((-F.log(unit(F.concat(key, F.lit(":"), s.cast("string")))) / F.get(shares, s)).alias("bid"), s.alias("shard")),
    )
    return F.array_min(bids)["shard"]


def rendezvous(
    docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", rows_per_cell: int = ROWS_PER_CELL, grown_weight: float | None = None
) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``, replacing columns of these names.

    ``size`` is the UTF-8 length of the text (null: none) plus 8, ``grown_shard`` the shard after one more of weight
    ``grown_weight`` (the mean by default) has been added. A null text has the checksum of the empty text. Null ids
    share a shard, equal ids too; rows equal in id and text take neighbouring slots. An empty table gives no rows.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    more = grown_weight or sum(weights) / len(weights)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = record_key(id_col)
    order, cell, before, count, its_shard, its_cell = (fresh(docs, n) for n in ("order", "cell", "before", "count", "shard", "its_cell"))
    cells = max(1, math.ceil(docs.count() / (len(weights) * rows_per_cell)))
    rows = docs.withColumns(
        {
            "size": (F.length(text) + 8).cast("long"),
            "text_crc32": F.crc32(text),
            "law": F.lit("key"),
            "shard": winning_shard(key, weights),
            "grown_shard": winning_shard(key, [*weights, more]),
            order: unit(F.concat(key, F.lit("/"), F.md5(text))),
        }
    ).withColumn(cell, F.floor(F.col(order) * cells).cast("int"))
    placed = Window.partitionBy("shard", cell).orderBy(order, "text_crc32", "size")
    earlier = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each shard and cell: the running sum is over counts, not over documents
    counts = rows.groupBy("shard", cell).agg(F.count(F.lit(1)).alias(count))
    counts = counts.select(F.col("shard").alias(its_shard), F.col(cell).alias(its_cell), F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    numbered = rows.withColumn("slot", (F.row_number().over(placed) - 1).cast("long"))
    joined = numbered.join(counts, (F.col("shard") == F.col(its_shard)) & (F.col(cell) == F.col(its_cell)))
    return joined.withColumn("slot", F.col("slot") + F.col(before)).select(*docs.columns, *added)


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], **names) -> None:
    """Write one folder of Parquet files for each shard, rows in slot order within a file."""
    rows = rendezvous(docs, weights, **names)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
