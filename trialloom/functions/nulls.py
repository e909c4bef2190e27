"""Column helpers for the null rules of the analyses.

The source analyses mix two kinds of mean (one spoiled by any missing value, one skipping them), treat a
membership test on a missing value as false, and let a conditional on a missing value stay missing.
Each rule has one helper here so that a call site says which one it wants.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_mean(x: Column | str) -> Column:
    """Mean that is NULL as soon as one value of the group is NULL."""
    x = as_col(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def proportion(predicate: Column, strict: bool = True) -> Column:
    """Share of rows for which ``predicate`` holds."""
    x = predicate.cast("int")
    return strict_mean(x) if strict else F.avg(x)


def member(x: Column | str, values: Iterable) -> Column:
    """Set membership that is false, never NULL, for a NULL input."""
    return F.coalesce(as_col(x).isin(list(values)), F.lit(False))


def if_else(condition: Column, yes, no) -> Column:
    """Two-way conditional that stays NULL where the condition is NULL."""
    return F.when(condition, yes).when(~condition, no)


def case_when(*branches: tuple[Column, object]) -> Column:
    """First branch that holds wins; no branch gives NULL."""
    (condition, value), *rest = branches
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out


def flag(condition: Column) -> Column:
    """0/1 indicator, NULL kept."""
    return condition.cast("int")


def clamp(x: Column | str, low: float, high: float) -> Column:
    """Limit to ``[low, high]``; NULL stays NULL although ``greatest`` would skip it."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def lookup(x: Column | str, mapping: Mapping) -> Column:
    """Value from a literal map; unseen and NULL keys give NULL."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), as_col(x))


def ordinal(x: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in an ordered level list; anything else gives NULL."""
    return lookup(x, {level: i for i, level in enumerate(levels, start=1)})


def level_name(code: Column | str, levels: Sequence[str]) -> Column:
    """Label of a 1-based level code."""
    return lookup(code, dict(enumerate(levels, start=1)))


def row_mean(*cols: Column | str) -> Column:
    """Mean across columns of one row, NULL if any is NULL."""
    xs = [as_col(c) for c in cols]
    return reduce(lambda a, b: a + b, xs) / F.lit(len(xs))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys``, NULL equal to NULL, keeping one copy of the keys.

    The right keys are renamed first, so both sides may stem from one frame.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])
