"""Outcomes from tracking logs: course progress and later sign-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.nulls import join_same


def course_progress(
    watched: DataFrame, learner: str, course: str, item: str, catalogue: DataFrame | None = None, total: str = "total"
) -> DataFrame:
    """Distinct items a learner used, in percent of the course's items.

    ``catalogue`` gives the number of items of each course (one row each) in ``total``; without it, or for a course it
    does not list, items that nobody used cannot be counted and the distinct items used by anyone are taken. Repeats
    are removed map-side first; both counts then come from the deduplicated triples.
    """
    used = watched.select(learner, course, item).filter(F.col(item).isNotNull()).distinct()
    totals = used.select(course, item).distinct().groupBy(course).agg(F.count(F.lit(1)).alias("items"))
    if catalogue is not None:
        listed = catalogue.select(F.col(course).alias("_course"), F.col(total).alias("_listed"))
        totals = totals.join(listed, F.col(course).eqNullSafe(F.col("_course")), "left")
        totals = totals.select(course, F.coalesce("_listed", "items").alias("items"))
    mine = used.groupBy(learner, course).agg(F.count(F.lit(1)).alias("used"))
    joined = join_same(mine, totals, [course])
    return joined.withColumn("progress", F.col("used") * 100.0 / F.col("items"))


def later_signups(exposures: DataFrame, signups: DataFrame, learner: str, exposed_at: str, started_at: str) -> DataFrame:
    """Sign-ups of each exposed learner that start after the exposure, 0 where there is none.

    ``exposures`` has one row per learner. The matching is an inner join, whose hot learners adaptive
    execution may split on the sign-up side; learners without a match come back in a join of unique keys.
    """
    signups = signups.filter(F.col(learner).isNotNull())
    starts = exposures.select(F.col(learner).alias("_learner"), F.col(exposed_at).alias("_exposed_at"))
    # keyed by structs, so that both sides get an exchange of their own however they were partitioned before:
    # only then can a hot key be split
    hit = (F.struct(learner) == F.struct("_learner")) & (F.col(started_at) > F.col("_exposed_at"))
    counts = signups.join(starts, hit).groupBy("_learner").agg(F.count(F.lit(1)).alias("_later"))
    return exposures.join(counts, F.col(learner) == F.col("_learner"), "left").select(
        learner, exposed_at, F.coalesce("_later", F.lit(0)).alias("later_signups")
    )
