"""Grouped summaries. All aggregates combine map-side, so group size does not matter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.nulls import join_same, member, proportion, strict_mean
from trialloom.functions.scalars import age_from_birth_year, detect, to_number
from trialloom.operators.ranks import ROWS_PER_CELL, exact_median

# fixed value: normal quantile used for the 99 % interval
Z99 = 2.58


def with_interval(df: DataFrame, mean: str = "mean", sd: str = "sd", n: str = "n") -> DataFrame:
    """Standard error and 99 % limits from an aggregate; ``n`` counts missing rows too."""
    return df.withColumn("se", F.try_divide(F.col(sd), F.sqrt(n))).withColumns(
        {"hi_int": F.col(mean) + Z99 * F.col("se"), "low_int": F.col(mean) - Z99 * F.col("se")}
    )


def summarise(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Null-skipping mean, sd, min, max and the row count."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(F.lit(1)).alias("n"),
    )


def median_interval(df: DataFrame, keys: Sequence[str], value: str, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Mean, sd, n, exact median, se and interval per group."""
    base = summarise(df, keys, value).drop("min", "max")
    medians = exact_median(df, value, keys, rows_per_cell)
    return with_interval(join_same(base, medians, keys))


def condition_descriptives(df: DataFrame, keys: Sequence[str] = ("affirm", "plans"), year: int = 2017) -> DataFrame:
    """Twelve statistics per condition; pass the sample rows."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("N"),
        F.count_if(member("institution", ["Harvard", "MIT"])).alias("N_harvardMIT"),
        strict_mean("cert_basic").alias("cert_basic"),
        F.avg("cert_verified").alias("cert_verified"),
        F.avg("enroll_verified").alias("enroll_verified"),
        F.avg("upgrade_verified").alias("upgrade_verified"),
        strict_mean("course_progress").alias("avg_course_progress"),
        strict_mean(age_from_birth_year("yob", year)).alias("avg_age"),
        proportion(F.col("sex") == 2).alias("prop_women"),
        strict_mean("is_fluent").alias("prop_fluent"),
        proportion(F.col("intent_assess") == 4).alias("prop_intent_assess_all"),
        strict_mean("highHDI").alias("prop_highHDI"),
    )


def numeric_answers(df: DataFrame, answer: str, keys: Sequence[str]) -> DataFrame:
    """Mean, sd and n of a text answer, over the rows whose text has a digit."""
    digits = df.filter(detect(answer, "[0-9]")).withColumn("_x", to_number(answer))
    return digits.groupBy(*keys).agg(
        strict_mean("_x").alias("mean"),
        F.when(F.count("_x") == F.count(F.lit(1)), F.stddev_samp("_x")).alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )


def stack_rows(df: DataFrame, keep: Sequence[str], rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn each row into several: one per mapping of output column to expression."""
    packed = F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows])
    return df.select(*keep, F.explode(packed).alias("_r")).select(*keep, "_r.*")


def activity_profile(
    df: DataFrame, measures: Sequence[str], populations: Mapping[str, Column], group: Column, group_name: str
) -> DataFrame:
    """Mean, sd, min, max, n and se of every measure, per population flag and group.

    One scan and one partial aggregate: moments are taken per combination of population flags, wide over the
    measures, and the few resulting rows are stacked and merged into populations. Each row is read once, however
    many populations it belongs to, and no row is copied.
    """
    flags = {f"_p{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(populations.values())}
    stats = {"n": F.count, "mean": F.avg, "var": F.var_pop, "min": F.min, "max": F.max}
    typed = df.select(
        group.alias(group_name),
        *[c.alias(n) for n, c in flags.items()],
        *[F.col(m).cast("double").alias(m) for m in measures],
    ).filter(reduce(lambda a, b: a | b, [F.col(n) for n in flags]))
    wide = typed.groupBy(group_name, *flags).agg(
        *[fn(m).alias(f"{stat}_{i}") for i, m in enumerate(measures) for stat, fn in stats.items()]
    )
    rows = [
        {
            "population": F.when(F.col(p), F.lit(name)),
            "variable": F.lit(m),
            **{stat: F.col(f"{stat}_{i}") for stat in stats},
        }
        for p, name in zip(flags, populations)
        for i, m in enumerate(measures)
    ]
    long = stack_rows(wide, [group_name], rows).filter(F.col("population").isNotNull() & (F.col("n") > 0))
    keys = ["population", "variable", group_name]
    # merge of partial moments: the few flag combinations of one cell, around their common mean
    merged = long.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.col("var")).alias("_within"),
        F.collect_list(F.struct("n", "mean")).alias("_parts"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    between = F.aggregate(
        "_parts", F.lit(0.0), lambda acc, p: acc + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean"))
    )
    spread = F.when(F.col("n") > 1, F.sqrt((F.col("_within") + between) / (F.col("n") - 1)))
    return merged.withColumn("sd", spread).select(
        *keys, "mean", "sd", "min", "max", "n", F.try_divide("sd", F.sqrt("n")).alias("se")
    )


def country_share(
    df: DataFrame, group: str = "group_cat", country: str = "cc_by_ip", countries: Sequence[str] = ("US", "CN")
) -> DataFrame:
    """Share of rows from the given countries per participant type; unclassified rows are left out."""
    share = df.filter(F.col(group).isNotNull()).groupBy(group)
    return share.agg(F.avg(F.col(country).isin(list(countries)).cast("int")).alias("pct"))
