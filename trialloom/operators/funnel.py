"""Participation funnel and percentile profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.nulls import case_when, lookup
from trialloom.operators.describe import stack_rows, with_interval
from trialloom.operators.ranks import ROWS_PER_CELL, tile, with_rank

# fixed values: funnel stages in order
STAGES = ["viewed", "explored", "completed", "certified", "blended"]
PERCENTILES = {
    "percentile_nevents": "Number of Events",
    "percentile_nvideo": "Number of Video Actions",
    "percentile_ndays_act": "Number of Days Participated in Course",
    "percentile_forums": "Number of Forum Posts",
    "percentile_grade": "Course Grade",
}


def clean_flag(column: str) -> Column:
    """True only where the flag is known and set."""
    return F.coalesce(F.col(column) == 1, F.lit(False))


def participant_type(stages: Sequence[str] = STAGES) -> Column:
    """The last stage reached, if the 0/1 stage flags are nested; any other pattern gives NULL."""

    def exactly(depth: int) -> Column:
        hit = F.lit(True)
        for i, stage in enumerate(stages):
            hit = hit & (F.col(stage) == (1 if i <= depth else 0))
        return hit

    return case_when(*[(exactly(i), F.lit(stage)) for i, stage in enumerate(stages)])


def percentile_long(
    df: DataFrame,
    measures: Mapping[str, str],
    unique_key: Sequence[str],
    carry: Sequence[str],
    within: Sequence[str] = (),
    k: int = 100,
    legacy: bool = False,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """``carry + (variable, value, tile)``: the k-tile of each measure, over all rows or within groups.

    ``measures`` maps a column to the name its percentile goes by. All measures share one long frame and one ranked
    shuffle, the measure being part of the group.
    """
    long = stack_rows(
        df.select(*{*unique_key, *carry, *within, *measures}),
        list(dict.fromkeys([*unique_key, *carry, *within])),
        [{"variable": F.lit(name), "value": F.col(c).cast("double")} for c, name in measures.items()],
    )
    ranked = with_rank(long, "value", list(unique_key), ["variable", *within], rows_per_cell, store=True)
    return ranked.withColumn("tile", tile(k, legacy=legacy)).drop("rank", "total")


def percentile_profile(
    long: DataFrame, kind: str = "group_cat", by: Sequence[str] = (), labels: Mapping[str, str] = PERCENTILES
) -> DataFrame:
    """Mean, sd, n, median, se and 99 % interval of the tiles per participant type and variable.

    ``n`` counts rows without a tile too. The exact median aggregate keeps one counter per distinct tile, at most
    ``k`` of them, whatever the group size.
    """
    keys = [*by, "variable", kind]
    stats = (
        long.filter(F.col(kind).isNotNull())
        .groupBy(*keys)
        .agg(
            F.avg("tile").alias("mean"),
            F.stddev_samp("tile").alias("sd"),
            F.count(F.lit(1)).alias("n"),
            F.median("tile").alias("median"),
        )
    )
    out = with_interval(stats)
    return out.withColumn("variable_label", lookup("variable", labels)) if labels else out
