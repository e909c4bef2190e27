"""Subgroup indicators, learner background features, standardising and the composite index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.nulls import flag, join_same, member, row_mean, strict_mean
from trialloom.functions.scalars import age_from_birth_year, cut, logistic, reverse_code

# fixed values: development-index bands
HDI_BREAKS = (0, 0.55, 0.7, 0.8, 1)
HDI_LABELS = ("low", "medium", "high", "v.high")


def subgroup_indicators(df: DataFrame) -> DataFrame:
    white_or_asian = (F.col("us_race_1") == 1) | (F.col("us_race_4") == 1)
    return df.withColumns(
        {
            "highHDI": flag(F.col("HDI") > 0.7),
            "HDI4": cut("HDI", HDI_BREAKS, HDI_LABELS),
            "is_fluent": flag(F.col("fluent") == 5),
            "gender_female": flag(F.col("sex") == 2),
            "gender_other": flag(F.col("sex") == 3),
            "us_majority": flag(white_or_asian & (F.col("us_ethnicity") == 1)),
            "course_selfpaced": member("course", range(1, 6)),
            "educ": reverse_code("educ"),
            "educ_parents": reverse_code("educ_parents"),
        }
    )


def background_features(df: DataFrame, year: int = 2017) -> DataFrame:
    """Fifteen learner features (education already reversed)."""
    school = F.col("school") == 1
    emp = F.col("empstatus")
    return df.withColumns(
        {
            "age": age_from_birth_year("yob", year),
            "educ_phd": F.col("educ") == 9,
            "educ_ma_prof": member("educ", (7, 8)),
            "educ_ba": F.col("educ") == 6,
            "educ_some_he": member("educ", (4, 5)),
            "more_educ_than_parents": F.col("educ") > F.col("educ_parents"),
            "is_teacher": F.col("teach") == 1,
            "is_employed": emp == 1,
            "is_unemployed": emp == 2,
            "is_ft_student": emp == 3,
            "is_pt_student": school & (F.col("school_ftpt") == 0),
            "is_blended": school & (F.col("school_online") > 2),
            "is_hs_student": school & member("school_lev", (1, 2, 3)),
            "is_college_student": school & member("school_lev", (4, 5, 6)),
            "born_in_US": F.col("pob") == 187,
        }
    )


def group_flag(df: DataFrame, group: str, value: str, below: float, output: str) -> DataFrame:
    """Flag rows whose group's strict mean is below a limit.

    One row per group is joined back; the group side carries two columns, and the row side is never
    gathered by group, so a dominant group stays spread out.
    """
    means = df.groupBy(group).agg((strict_mean(value) < below).alias(output))
    return join_same(df, means, [group])


def standardised(df: DataFrame, columns: Sequence[str], over: DataFrame | None = None) -> Mapping[str, Column]:
    """z-scores of ``columns`` with moments taken over ``over`` (default: the same rows).

    The moments are one scalar subquery, computed once and inlined, not a window over all rows.
    """
    base = df if over is None else over
    moments = base.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        ).alias("moments")
    ).scalar()
    return {
        c: F.try_divide(F.col(c) - moments.getField(f"m_{c}"), moments.getField(f"s_{c}")) for c in columns
    }


def with_zscores(df: DataFrame, columns: Sequence[str], prefix: str = "z_", over: DataFrame | None = None) -> DataFrame:
    return df.withColumns({f"{prefix}{c}": z for c, z in standardised(df, columns, over).items()})


def composite_index(df: DataFrame, columns: Sequence[str], output: str = "sig") -> DataFrame:
    """Row mean of z-scores through a logistic curve."""
    return df.withColumn(output, logistic(row_mean(*standardised(df, columns).values())))
