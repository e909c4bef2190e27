"""Response quality: arm integrity, validation rules and recoding by codebook."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.scalars import to_number


def unseen_answers(df: DataFrame, blocks: Mapping[str, tuple[Sequence[str], Column]]) -> DataFrame:
    """Flag rows with an answer in a block their arm never showed.

    ``blocks`` maps an output name to (answer columns, condition under which the block is shown).
    """

    def answered(columns: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])

    flags = {
        name: answered(columns) & ~F.coalesce(shown, F.lit(False)) for name, (columns, shown) in blocks.items()
    }
    return df.withColumns(flags).withColumn("any_unseen", reduce(lambda a, b: a | b, [F.col(n) for n in flags]))


def answer_missing(column: str) -> Column:
    """Breach of a requested response."""
    return F.col(column).isNull() | (F.trim(F.col(column)) == "")


def not_numeric(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Breach of a number rule: given, but no number or out of range."""
    value = to_number(column)
    bad = value.isNull()
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return ~answer_missing(column) & F.coalesce(bad, F.lit(True))


def too_short(column: str, min_chars: int) -> Column:
    return ~answer_missing(column) & (F.char_length(column) < min_chars)


def choice_count_off(columns: Sequence[str], low: int, high: int) -> Column:
    """Breach of a bound on the number of 0/1 choices ticked."""
    ticked = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in columns])
    return (ticked < low) | (ticked > high)


def with_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One boolean per rule and the number of rules broken."""
    flagged = df.withColumns(dict(checks))
    total = reduce(lambda a, b: a + b, [F.col(n).cast("int") for n in checks])
    return flagged.withColumn("failures", total)


def failure_counts(df: DataFrame, checks: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c)).alias(c) for c in checks],
        F.count_if(F.col("failures") > 0).alias("any_failure"),
    )


def recode(
    df: DataFrame, columns: Sequence[str], choices: DataFrame, survey: str = "survey", prefix: str = ""
) -> DataFrame:
    """Raw choice ids to analysis codes by the codebook's ``choices(survey, tag, choice_id, recode)``.

    Every column is joined to the choices of its own tag, so a row costs the same however many choices a survey has, and
    responses stay wide. Choices that a codebook lists twice count once, with the smallest code; an answer that is no
    choice, or whose choice has no code, gives NULL.
    """
    coded = choices.filter(F.col("tag").isin(list(columns)) & F.col("recode").isNotNull())
    book = coded.groupBy("survey", "tag", "choice_id").agg(F.min("recode").alias("_code"))
    found = {}
    for i, c in enumerate(columns):
        own = book.filter(F.col("tag") == c).select(F.col("survey").alias("_survey"), F.col("choice_id").alias("_choice"), F.col("_code").alias(f"_code{i}"))
        # an answer takes part in the key, so the responses of a dominant survey are spread over its choices, and those of
        # a dominant choice can be split
        df = df.join(own, F.struct(survey, F.col(c).cast("string")) == F.struct("_survey", "_choice"), "left").drop("_survey", "_choice")
        found[f"{prefix}{c}"] = F.col(f"_code{i}").try_cast("double")
    return df.withColumns(found).drop(*[f"_code{i}" for i in range(len(columns))])
