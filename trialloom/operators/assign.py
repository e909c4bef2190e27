"""Stratified permuted-block assignment and what follows from an arm."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.nulls import as_col, case_when, flag
from trialloom.functions.scalars import int_div, md5_of, modulo, paste
from trialloom.operators.ranks import ROWS_PER_CELL, with_rank


def banded(x: Column | str, *cuts: float) -> Column:
    """Number of cut points strictly below ``x`` (0, 1, 2, ...), NULL kept."""
    x = as_col(x)
    ordered = sorted(cuts, reverse=True)
    branches = [(x > c, F.lit(len(ordered) - i)) for i, c in enumerate(ordered)]
    return case_when(*branches, (x <= ordered[-1], F.lit(0)))


def strata_bins(df: DataFrame) -> DataFrame:
    """The four stratification levels and the stratum key (education before it is reversed)."""
    educ = F.col("educ")
    return df.withColumns(
        {
            "strata_intent_assess": banded("intent_assess", 2),
            "strata_hours": banded("hours", 5),
            "strata_crs_finish": banded("crs_finish", 0, 3),
            "strata_educ": case_when((educ < 4, F.lit(2)), (educ == 4, F.lit(1)), (educ > 4, F.lit(0))),
        }
    ).withColumn("strata", paste("strata_intent_assess", "strata_hours", "strata_crs_finish", "strata_educ"))


def block_of(position: Column | str, size: int) -> Column:
    """1-based block number of a 1-based position."""
    return (int_div(as_col(position) - 1, size) + 1).cast("long")


def block_draw(position: Column | str, arms: int, *seeded_by: Column | str | int) -> Column:
    """The arm a row gets in its block: the block's own random order of all arms, read at the row's place.

    A full block holds every arm once and a short last block holds distinct arms. The order is sorted
    out of hashes inside the row, so no arm table has to be joined.
    """
    shuffled = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), F.lit(arms)), lambda a: F.struct(md5_of(*seeded_by, a).alias("h"), a.alias("arm"))
        )
    )
    place = modulo(as_col(position) - 1, arms) + 1
    return F.element_at(shuffled, place.cast("int"))["arm"]


def permuted_blocks(
    df: DataFrame,
    strata: str,
    unique_key: Sequence[str],
    arms: int = 6,
    seed: int = 2138,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Add block number ``c`` and arm ``cond`` (1..arms) per stratum.

    Positions come from a hash order, so a retried task assigns the same arms; a stratum of any
    size is handled, and a very large one is spread over many tasks.
    """
    ranked = with_rank(df, None, unique_key, [strata], rows_per_cell, seed=seed)
    return (
        ranked.withColumn("c", block_of("rank", arms))
        .withColumn("cond", block_draw("rank", arms, seed, F.col(strata), F.col("c")).cast("int"))
        .drop("rank", "total")
    )


def decode_factors(df: DataFrame, cell: str = "cond") -> DataFrame:
    """2 x 3 design cell to its two factors and their indicators."""
    return df.withColumns(
        {"affirm": flag(F.col(cell) > 3), "plans": modulo(cell, 3).cast("int")}
    ).withColumns(
        {
            "plans_long": flag(F.col("plans") == 2),
            "plans_short": flag(F.col("plans") == 1),
            "plans_any": flag(F.col("plans") > 0),
        }
    )


def even_randomizer(
    df: DataFrame,
    unique_key: Sequence[str],
    arms: int,
    output: str,
    seed: int,
    rows_per_cell: int = ROWS_PER_CELL,
    store: bool = False,
) -> DataFrame:
    """Unstratified draw of 0..arms-1 with counts that differ by at most one.

    ``store`` writes ``df`` once before it is ranked, which pays if it is itself the result of a draw.
    """
    ranked = with_rank(df, None, unique_key, (), rows_per_cell, seed=seed, store=store)
    return ranked.withColumn(output, modulo(F.col("rank") - 1, arms).cast("int")).drop("rank", "total")


def with_service_override(df: DataFrame, assigned: Mapping[str, str], fallback: Mapping[str, str], ok: str) -> DataFrame:
    """Arms of the assignment service where its call succeeded, else the survey's own draw."""
    done = F.coalesce(F.col(ok) == 1, F.lit(False))
    return df.withColumns(
        {arm: F.coalesce(F.when(done, F.col(assigned[arm])), F.col(fallback[arm])) for arm in assigned}
    )


def mask_where(df: DataFrame, pattern: str, unseen: Column) -> DataFrame:
    """Null every column whose name matches ``pattern`` on rows where ``unseen`` holds."""
    hit = [c for c in df.columns if re.search(pattern, c)]
    return df.withColumns({c: F.when(~F.coalesce(unseen, F.lit(False)), F.col(c)) for c in hit})


def remove_counterfactual(df: DataFrame) -> DataFrame:
    """Null the answers of arms a learner did not see."""
    df = mask_where(df, "affirm_", F.col("affirm") == 0)
    df = mask_where(df, "longplans", F.col("plans") != 2)
    return mask_where(df, "shortplans", F.col("plans") != 1)
