"""Balance of an assignment: proportions per stratum, their tests, and multiplicity corrections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.nulls import as_col, strict_mean
from trialloom.functions.tails import chi_square_1df_tail
from trialloom.operators.ranks import ROWS_PER_CELL, running_extremes


def proportion_statistic(x: Column | str, n: Column | str, p: float) -> Column:
    """Chi-square (1 df) of a one-sample proportion test with continuity correction."""
    x, n = as_col(x), as_col(n)
    gap = F.abs(x - n * p)
    corrected = gap - F.least(F.lit(0.5), gap)
    return F.try_divide(corrected * corrected, n * (p * (1 - p)))


def proportion_test(x: Column | str, n: Column | str, p: float) -> Column:
    """Two-sided p-value of the same test; meant for aggregated rows."""
    return chi_square_1df_tail(proportion_statistic(x, n, p))


def balance_table(
    df: DataFrame, strata: Sequence[str], arms: Mapping[str, float], p_values: bool = True
) -> DataFrame:
    """Per stratum and arm (long form): share, expected share, test statistic and p-value."""
    wide = df.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(a).alias(f"x_{a}") for a in arms],
        *[strict_mean(a).alias(f"m_{a}") for a in arms],
    )
    packed = F.array(
        *[
            F.struct(
                F.lit(a).alias("arm"),
                F.lit(p).alias("expected"),
                F.col(f"m_{a}").alias("share"),
                # a missing arm spoils the test as it spoils the share
                F.when(F.col(f"m_{a}").isNotNull(), proportion_statistic(f"x_{a}", "n", p)).alias("statistic"),
            )
            for a, p in arms.items()
        ]
    )
    long = wide.select(*strata, "n", F.explode(packed).alias("_r")).select(*strata, "n", "_r.*")
    if not p_values:
        return long
    return long.withColumn("p_value", chi_square_1df_tail("statistic"))


def adjust_p(
    df: DataFrame, p: str = "p_value", by: Sequence[str] = (), tie_break: Sequence[str] = (), rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg values within each family of tests.

    Expects one row per test; ``tie_break`` tells tests of one family apart. A family of any size is scanned range by
    range. Tests without a p-value are not counted and get none.
    """
    one, known = F.lit(1.0), F.col(p).isNotNull()
    holm = F.least(one, (F.col("total") - F.col("rank") + 1) * F.col(p))
    bh = F.least(one, F.col("total") / F.col("rank") * F.col(p))
    scanned = running_extremes(df, p, {"p_holm": holm}, {"p_bh": bh}, list(tie_break) or [p], by, rows_per_cell)
    bonferroni = F.when(known, F.least(one, F.col("total") * F.col(p)))
    return scanned.withColumn("p_bonferroni", bonferroni).select(*df.columns, "p_bonferroni", "p_holm", "p_bh")
