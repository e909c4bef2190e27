"""Frequencies and two-way tables over declared levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.nulls import join_same, ordinal


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value"):
    """Wide to long over columns of one common type; NULL values are kept."""
    return df.unpivot(list(ids), list(columns), name, value)


def _level_frame(df: DataFrame, levels: Sequence[str], column: str) -> DataFrame:
    rows = [(level, i) for i, level in enumerate(levels, start=1)]
    return df.sparkSession.createDataFrame(rows, f"`{column}` string, ordinal int")


def crosstab_pct(
    df: DataFrame, row: str, row_levels: Sequence[str], col: str, col_levels: Sequence[str], prefix: str = "pct_"
) -> DataFrame:
    """Share of each row level within each column level, one output column per column level.

    Every declared level appears, with 0 where nothing was counted; rows with an undeclared or NULL level on
    either side are left out.
    """
    names = {level: f"{prefix}{level}" for level in col_levels}
    kept = df.filter(F.col(row).isin(list(row_levels)) & F.col(col).isin(list(col_levels)))
    counts = kept.groupBy(row).agg(*[F.count_if(F.col(col) == level).alias(n) for level, n in names.items()])
    full = _level_frame(df, row_levels, "_level").join(counts, F.col("_level") == F.col(row), "left")
    # at most one row per declared level reaches this window
    everything = Window.partitionBy(F.lit(0))
    return full.select(
        F.col("_level").alias(row),
        "ordinal",
        *[
            F.try_divide(F.coalesce(F.col(n), F.lit(0)), F.sum(F.coalesce(F.col(n), F.lit(0))).over(everything)).alias(n)
            for n in names.values()
        ],
    )


def crosstab_long(
    df: DataFrame, row: str, row_levels: Sequence[str], col: str, col_levels: Sequence[str]
) -> DataFrame:
    """The same table as ``(row, ordinal, group_label, pct)``."""
    wide = crosstab_pct(df, row, row_levels, col, col_levels)
    long = wide.unpivot([row, "ordinal"], [f"pct_{c}" for c in col_levels], "group_label", "pct")
    return long.withColumn("group_label", F.substr("group_label", F.lit(len("pct_") + 1)))


def frequency(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Value, n and percent; NULL is a row of its own. Totals are a second aggregate, of the counts."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
        return join_same(counts, totals, by).withColumn("percent", F.col("n") / F.col("_total")).drop("_total")
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.col("n") / total)


def with_midpoint(df: DataFrame, levels: Sequence[str], column: str, by: Sequence[str] = ()) -> DataFrame:
    """Running total of ``percent`` in level order less half the row's own: where a label goes in a pie.

    One row per declared level (and group) is expected.
    """
    ranked = df.withColumn("ordinal", ordinal(column, levels)).filter(F.col("ordinal").isNotNull())
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("midpoint", F.sum("percent").over(upto) - F.col("percent") / 2)
