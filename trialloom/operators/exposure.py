"""Exposure history per learner and the intention-to-treat sample.

One learner may own a large share of all rows, so nothing here puts all rows of an id into one task. The
first two exposures come from a ``row_number() <= 2`` filter, which Spark turns into a per-task limit
*before* the shuffle; counts are combined map-side; and the flags reach every row by a join on the id, whose
hot partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.nulls import join_same
from trialloom.functions.scalars import days_between, hours_between


@dataclass(frozen=True)
class ExposureSpec:
    """Column names (times in epoch seconds) and thresholds."""

    id: str = "id"
    exposed_at: str = "survey_timestamp"
    first_activity: str = "first_activity_timestamp"
    course_start: str = "course_start_timestamp"
    self_paced: str = "course_selfpaced"
    tie_break: Sequence[str] = field(default=())
    analysis_at: float = 1487145600
    clean_gap_days: float = 29
    max_delay_hours: float = 1
    min_days_to_analysis: float = 29
    max_days_from_start: float = 15

    @property
    def order(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in (self.exposed_at, *self.tie_break)]


def assigned(df: DataFrame, service_flag: str = "webservice_call_complete", arms: Sequence[str] = ("affirm", "plans")):
    """Rows whose assignment call succeeded and whose arms are known."""
    keep = F.col(service_flag) == 1
    for arm in arms:
        keep = keep & F.col(arm).isNotNull()
    return df.filter(keep)


def first_exposures(df: DataFrame, spec: ExposureSpec = ExposureSpec()) -> DataFrame:
    """The first row of each id with ``days_to_next_exposure`` and ``clean_exposure``."""
    by_id = Window.partitionBy(spec.id).orderBy(*spec.order)
    firsts = df.withColumn("_nth", F.row_number().over(by_id)).filter(F.col("_nth") <= 2)
    paired = firsts.withColumns(
        {
            "_has_next": F.lead(F.lit(True)).over(by_id).isNotNull(),
            "_next_at": F.lead(spec.exposed_at).over(by_id),
        }
    ).filter(F.col("_nth") == 1)
    gap = F.when(F.col("_has_next"), days_between(F.col("_next_at"), F.col(spec.exposed_at))).otherwise(F.lit(0.0))
    return (
        paired.withColumn("days_to_next_exposure", gap)
        .withColumn("clean_exposure", ~F.col("_has_next") | (F.col("days_to_next_exposure") > spec.clean_gap_days))
        .drop("_nth", "_has_next", "_next_at")
    )


def eligibility(df: DataFrame, spec: ExposureSpec = ExposureSpec()) -> DataFrame:
    """Delay, distance from the start and to the analysis, and ``itt_sample`` from ``clean_exposure``."""
    first = F.col(spec.first_activity)
    spans = df.withColumns(
        {
            "survey_delay": hours_between(F.col(spec.exposed_at), first),
            "days_from_start": days_between(first, F.col(spec.course_start)),
            "days_to_analysis": days_between(F.lit(spec.analysis_at), first),
        }
    )
    paced = F.col(spec.self_paced)
    in_time = (paced & (F.col("days_to_analysis") > spec.min_days_to_analysis)) | (
        ~paced & (F.col("days_from_start") < spec.max_days_from_start)
    )
    prompt = F.col("survey_delay") < spec.max_delay_hours
    return spans.withColumn("itt_sample", F.col("clean_exposure") & prompt & in_time)


def itt_sample(df: DataFrame, spec: ExposureSpec = ExposureSpec()) -> DataFrame:
    """Only the rows of the sample. Each map task sends at most two rows per id to the shuffle."""
    return eligibility(first_exposures(df, spec), spec).filter(F.col("itt_sample"))


def exposure_flags(df: DataFrame, spec: ExposureSpec = ExposureSpec()) -> DataFrame:
    """Every row with ``first_exposure``, ``num_exposures``, ``days_to_next_exposure``, ``clean_exposure`` and
    the eligibility columns. ``tie_break`` must make the order within an id total."""
    marks = [spec.exposed_at, *spec.tie_break]
    # a struct is never NULL itself, so a missing id is one more key of plain equality, and the count and the
    # window share one hash partitioning; ids are unique on both sides of their join
    keyed = df.select(F.struct(spec.id).alias("_key"), *marks)
    firsts = first_exposures(keyed, replace(spec, id="_key")).select(
        "_key", F.struct(*marks).alias("_first"), "days_to_next_exposure", F.col("clean_exposure").alias("_clean")
    )
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("num_exposures"))
    spans = sizes.join(firsts, "_key").withColumn(spec.id, F.col("_key")[spec.id]).drop("_key")
    # this join gets an exchange of its own on both sides, which is what lets adaptive execution split a hot id
    joined = join_same(df, spans, [spec.id])
    is_first = F.struct(*marks).eqNullSafe(F.col("_first"))
    flagged = joined.withColumns({"first_exposure": is_first, "clean_exposure": is_first & F.col("_clean")})
    return eligibility(flagged.drop("_first", "_clean"), spec)
