"""Ordinary least squares from cross products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions.tails import f_tail, f_upper, t_tail, t_two_sided
from trialloom.operators.models.design import Design, complete_rows, design_frame
from trialloom.operators.models.gram import column_sums

RESULT = (
    "model string, outcome string, sample string, family string, term string, estimate double, "
    "std_error double, statistic double, p_value double"
)


def result_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple(_plain(v) for v in r) for r in rows], RESULT)


def _plain(v):
    if isinstance(v, (float, np.floating)):
        return None if np.isnan(v) else float(v)
    return v


def independent_columns(products: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns, in order, that are no combination of earlier ones (centred, so constants go too)."""
    work = np.array(products, dtype=float)
    scale = np.diag(products).copy()
    kept = []
    for j in range(len(work)):
        if work[j, j] <= tolerance * max(scale[j], 1e-300) or scale[j] <= 1e-12:
            continue
        kept.append(j)
        work = work - np.outer(work[:, j], work[j, :]) / work[j, j]
    return kept


def ols_factor(df: DataFrame, outcome: str, factor: str, reference: str | None = None) -> DataFrame:
    """Regression on one factor with treatment contrasts, from one grouped aggregate.

    The alphabetically first level is the reference. Rows with a NULL on either side drop out. Each row of the
    result carries the fit's R squared and F statistic.
    """
    y = F.col(outcome).cast("double")
    groups = (
        df.filter(F.col(factor).isNotNull() & y.isNotNull())
        .groupBy(F.col(factor).cast("string").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var"))
    )
    base = F.min("level") if reference is None else F.lit(reference)
    # one row: the fit as a whole, over as many rows as the factor has levels
    whole = groups.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("var")).alias("rss"),
        base.alias("base"),
    )
    first = whole.select(F.struct("*").alias("w")).scalar()
    with_fit = groups.withColumn("w", first)
    reference_row = with_fit.filter(F.col("level") == F.col("w.base")).select(F.struct("n", "mean").alias("r")).scalar()
    between = with_fit.agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("w.grand"), F.lit(2)))).scalar()
    fitted = with_fit.withColumn("r", reference_row)
    is_base = F.col("level") == F.col("w.base")
    df_resid = F.col("w.rows") - F.col("w.k")
    s2 = F.try_divide(F.col("w.rss"), df_resid)
    spread = F.when(is_base, F.lit(1.0) / F.col("n")).otherwise(F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("r.n"))
    out = fitted.select(
        F.when(is_base, F.lit("(Intercept)")).otherwise(F.concat(F.lit(f"{factor}"), "level")).alias("term"),
        F.when(is_base, F.col("mean")).otherwise(F.col("mean") - F.col("r.mean")).alias("estimate"),
        F.sqrt(s2 * spread).alias("std_error"),
        df_resid.alias("df"),
        (F.col("w.k") - 1).alias("df_model"),
        F.try_divide(between, between + F.col("w.rss")).alias("r_squared"),
        F.try_divide(between / (F.col("w.k") - 1), s2).alias("f_statistic"),
    )
    return out.withColumn("statistic", F.try_divide("estimate", "std_error"))


def with_p_values(fit: DataFrame) -> DataFrame:
    """Student and F tail probabilities on the few rows of a factor regression."""
    return fit.withColumns(
        {"p_value": t_tail("statistic", "df"), "f_p_value": f_tail("f_statistic", "df_model", "df")}
    )


def ols(
    df: DataFrame, outcome: str, design: Design, model: str = "ols", sample: str = "all"
) -> tuple[DataFrame, dict[str, float | list[str]]]:
    """Coefficient table and fit summary; terms that add nothing are dropped and named in the summary."""
    rows = complete_rows(df, [outcome, *design.columns])
    frame = design_frame(rows, design, [F.col(outcome).cast("double").alias("_y")])
    x = [f"x{i}" for i in range(len(design.terms))]
    sums = column_sums(frame, [*x, "_y"])
    p = len(x)
    kept = independent_columns(sums.products[:p, :p])
    xtx, xty, yty = sums.products[np.ix_(kept, kept)], sums.products[kept, p], sums.products[p, p]
    inverse = np.linalg.inv(xtx)
    beta = inverse @ xty
    n, k = sums.rows, len(kept)
    rss = float(yty - beta @ xty)
    s2 = rss / (n - k - 1)
    centre = sums.means[kept]
    intercept = sums.means[p] - centre @ beta
    estimates = [intercept, *beta]
    errors = [np.sqrt(s2 * (1 / n + centre @ inverse @ centre)), *np.sqrt(s2 * np.diag(inverse))]
    names = ["(Intercept)", *(design.names[i] for i in kept)]
    table = result_frame(
        df.sparkSession,
        [
            (model, outcome, sample, "gaussian", t, b, e, b / e, t_two_sided(b / e, n - k - 1))
            for t, b, e in zip(names, estimates, errors)
        ],
    )
    r2 = 1 - rss / yty
    f = (r2 / k) / ((1 - r2) / (n - k - 1)) if k else float("nan")
    summary = {
        "n": n,
        "sigma": float(np.sqrt(s2)),
        "r_squared": float(r2),
        "adj_r_squared": float(1 - (1 - r2) * (n - 1) / (n - k - 1)),
        "f_statistic": float(f),
        "f_p_value": f_upper(f, k, n - k - 1) if k else float("nan"),
        "dropped": [design.names[i] for i in range(p) if i not in kept],
    }
    return table, summary
