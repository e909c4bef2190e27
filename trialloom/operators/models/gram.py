"""Cross products of design columns as distributed aggregates.

Everything a linear model needs from the rows is a sum of products. The sums are formed around the column means,
which keeps them accurate, and only arrays whose size depends on the design leave the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

@dataclass
class ColumnSums:
    """Row count, means and cross products of centred columns."""

    rows: float
    means: np.ndarray
    products: np.ndarray


def cell_totals(df: DataFrame, columns: Sequence[str], cells: Sequence[str] = ()) -> DataFrame:
    """One row per cell: ``n`` and the column sums ``s_<i>``. A cell of any size is combined map-side."""
    return df.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c)).alias(f"s_{i}") for i, c in enumerate(columns)]
    )


def centred_products(df: DataFrame, columns: Sequence[str], means: Sequence[float] | None = None) -> DataFrame:
    """One row of ``p_<i>_<j>``: sums of products of centred columns, i <= j.

    Ungrouped on purpose: the many accumulators then stay in the fields of the generated code instead of being
    looked up per row in a hash table. Without ``means`` they are a scalar subquery over the same rows.
    """
    if means is None:
        found = df.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).alias("m")).scalar()
        centres = [found.getField(f"m{i}") for i in range(len(columns))]
    else:
        centres = [F.lit(float(m)) for m in means]
    centred = df.select(*[(F.col(c) - m).alias(f"_c{i}") for i, (c, m) in enumerate(zip(columns, centres))])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return centred.agg(*[F.expr(f"sum(_c{i} * _c{j}) AS p_{i}_{j}") for i, j in pairs])


def upper_matrix(row, size: int) -> np.ndarray:
    """The symmetric matrix of a row's ``p_<i>_<j>``, i <= j."""
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = [row[f"p_{i}_{j}"] for i in range(size) for j in range(i, size)]
    return out + np.triu(out, 1).T


def column_sums(df: DataFrame, columns: Sequence[str]) -> ColumnSums:
    """Two passes over the rows; one row of sums each reaches the driver."""
    found = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    means = np.array([found[f"s_{i}"] for i in range(len(columns))], dtype=float) / found["n"]
    return ColumnSums(float(found["n"]), means, upper_matrix(centred_products(df, columns, means).first(), len(columns)))


def sum_arrays(df: DataFrame, partial) -> dict[int, np.ndarray]:
    """Sum fixed-length float arrays over all rows of ``df``.

    ``partial`` maps an iterator of pandas batches to ``(key, array)`` pairs, one per key and task. A task's
    rows are reduced before anything is shuffled, and at most 16 arrays per key reach the driver.
    """

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(partial(batches))
        if found:
            yield pd.DataFrame(
                {"key": [k for k, _ in found], "value": [np.asarray(v, dtype=float).tobytes() for _, v in found]}
            )

    def combine(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in part["value"]], axis=0)
        return pd.DataFrame({"key": part["key"].iloc[:1], "value": [total.tobytes()]})

    schema = "key int, value binary"
    partials = df.mapInPandas(in_task, schema)
    # two levels, so that many tasks' arrays do not meet in one combiner
    spread = partials.withColumn("_lane", F.pmod(F.xxhash64("value"), F.lit(16)).cast("int"))
    lanes = spread.groupBy("key", "_lane").applyInPandas(lambda d: combine(d[["key", "value"]]), schema)
    totals: dict[int, np.ndarray] = {}
    for r in lanes.collect():
        value = np.frombuffer(r["value"])
        totals[r["key"]] = totals[r["key"]] + value if r["key"] in totals else value.copy()
    return totals


def wide_gram(df: DataFrame, columns: Sequence[str], codes: Sequence[str], sizes: Sequence[int]) -> np.ndarray:
    """Cross products of ``[1, columns..., one-hot of each code]`` for designs too wide for SQL sums.

    ``codes`` are integer columns in ``0..size-1``; tasks form dense partial products with numpy.
    """
    columns, codes, sizes = list(columns), list(codes), list(sizes)
    width = 1 + len(columns) + sum(sizes)

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            block = np.zeros((len(batch), width))
            block[:, 0] = 1.0
            block[:, 1 : 1 + len(columns)] = batch[columns].to_numpy(dtype=float)
            at = 1 + len(columns)
            for code, size in zip(codes, sizes):
                block[np.arange(len(batch)), at + batch[code].to_numpy(dtype=int)] = 1.0
                at += size
            total += block.T @ block
        yield 0, total.ravel()

    return sum_arrays(df.select(*columns, *codes), partial)[0].reshape(width, width)
