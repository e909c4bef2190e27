"""Likert scales: scores, diverging shares, top-two boxes and high-intent shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.nulls import if_else, lookup, ordinal
from trialloom.functions.scalars import detect
from trialloom.operators.crosstab import to_long
from trialloom.operators.describe import stack_rows

# fixed values: answer scales, lowest first
IMPORTANCE = ["Not Important", "Slightly Important", "Somewhat Important", "Very Important", "Extremely Important"]
FREQUENCY = ["Never", "Rarely", "Sometimes", "Most of the time", "Always"]
FAMILIARITY = [
    "Not at all familiar", "Slightly familiar", "Somewhat familiar", "Very familiar", "Extremely familiar",
]
REASONS = {
    "mrmi_mrmi_1": "Lifelong learning",
    "mrmi_mrmi_2": "Curiosity about online learning",
    "mrmi_mrmi_3": "Advancing my career",
    "mrmi_mrmi_4": "Advancing my formal education",
    "mrmi_mrmi_5": "Best professors and universities",
    "mrmi_mrmi_6": "Serve my community",
    "mrmi_mrmi_7": "Access learning opportunities not otherwise available",
    "mrmi_mrmi_8": "Earn a certificate",
    "mrmi_mrmi_9": "Participate in online community",
    "mrmi_mrmi_10": "Learn about course content",
}
INDICATORS = {
    "intent_lecture": "Participate in all lectures",
    "intent_assess": "Participate in all assessments",
    "forums": "Participate frequently in the forums",
}


def drawing_order(k: int) -> dict[int, int]:
    """Score to drawing position: a diverging stack draws its two top levels the other way round."""
    order = {i: i for i in range(1, k + 1)}
    order[k - 1], order[k] = k, k - 1
    return order


def with_scores(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """``score`` (1..k) and ``draw_order``, kept apart."""
    scored = df.withColumn("score", ordinal(column, levels))
    return scored.withColumn("draw_order", lookup("score", drawing_order(len(levels))))


def diverging_shares(
    df: DataFrame,
    items: Sequence[str],
    group: str,
    levels: Sequence[str],
    groups: Mapping[object, str] | None = None,
    negative_upto: int | None = None,
    item_name: str = "variable",
) -> DataFrame:
    """Column percent per item, group and level; levels up to ``negative_upto`` count as negative.

    ``top2`` marks the positive side and ``pct_top2`` is the sum of the shares on the row's side. All items go
    through one unpivot and one aggregate of at most items x groups x levels rows.
    """
    cut = len(levels) - 2 if negative_upto is None else negative_upto
    label = F.col(group) if groups is None else lookup(F.col(group), groups)
    long = to_long(df.withColumn("_g", label), ["_g"], items, item_name, "level")
    scored = long.withColumn("score", ordinal("level", levels)).filter(
        F.col("score").isNotNull() & F.col("_g").isNotNull()
    )
    counts = scored.groupBy(item_name, F.col("_g").alias("group_label"), "level", "score").agg(
        F.count(F.lit(1)).alias("n")
    )
    # a declared level nobody chose still has its row with share 0
    per_group = counts.groupBy(item_name, "group_label").agg(
        F.sum("n").alias("_total"), F.map_from_entries(F.collect_list(F.struct("score", "n"))).alias("_by_score")
    )
    full = per_group.select(
        item_name,
        "group_label",
        "_total",
        "_by_score",
        F.posexplode(F.array(*[F.lit(level) for level in levels])).alias("_i", "level"),
    ).withColumn("score", F.col("_i") + 1)
    share = F.coalesce(F.try_element_at("_by_score", F.col("score")), F.lit(0)) / F.col("_total")
    signed = full.withColumn("pct", if_else(F.col("score") <= cut, -share, share)).withColumn(
        "top2", F.col("pct") > 0
    )
    side = Window.partitionBy(item_name, "group_label", "top2")
    return signed.select(
        item_name,
        "group_label",
        "level",
        "score",
        lookup("score", drawing_order(len(levels))).alias("draw_order"),
        "pct",
        "top2",
        F.sum("pct").over(side).alias("pct_top2"),
    )


def high_intent(
    df: DataFrame,
    indicators: Sequence[str],
    group: str,
    answered: str = ".",
    high: Sequence[str] = ("All", "frequently"),
) -> DataFrame:
    """Share of answers naming high intent, per group and indicator, with the number of answers.

    Counted wide in one aggregate and stacked afterwards, so rows are never multiplied.
    """
    wide = df.groupBy(group).agg(
        *[F.count_if(detect(c, answered)).alias(f"n_{c}") for c in indicators],
        *[
            F.count_if(detect(c, answered) & detect(c, "|".join(high))).alias(f"high_{c}")
            for c in indicators
        ],
    )
    rows = [
        {
            "indicator": F.lit(c),
            "pct_high": F.try_divide(F.col(f"high_{c}"), F.col(f"n_{c}")),
            "n": F.col(f"n_{c}"),
        }
        for c in indicators
    ]
    return stack_rows(wide, [group], rows).filter(F.col("n") > 0)
