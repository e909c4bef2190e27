"""Choosing columns by name and place, and sorting by an ordered scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.nulls import ordinal


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    """Columns whose name begins with one of the prefixes, in table order."""
    return [c for c in df.columns if c.startswith(prefixes)]


def from_to(df: DataFrame, first: str, last: str) -> list[str]:
    """The columns from ``first`` to ``last``, both included, by their place in the table."""
    a, b = df.columns.index(first), df.columns.index(last)
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return df.columns[a : b + 1]


def except_for(df: DataFrame, *names: str) -> list[str]:
    """All columns but the named ones; a name that is not there is an error, as it is for a choice."""
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return [c for c in df.columns if c not in names]


def by_level(column: str, levels: Sequence[str], descending: bool = False) -> Column:
    """Sort key of an ordered scale; answers outside the scale come last either way."""
    key = ordinal(column, levels)
    return key.desc_nulls_last() if descending else key.asc_nulls_last()


def sorted_by_level(df: DataFrame, column: str, levels: Sequence[str], descending: bool = False, then: Sequence[str] = ()) -> DataFrame:
    """Rows in the order of a scale, ties by the columns in ``then``."""
    return df.orderBy(by_level(column, levels, descending), *[F.col(c) for c in then])
