"""Joins that follow the null and duplicate rules of the analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from trialloom.functions.nulls import join_same


def natural_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Left join on all shared columns; NULL keys match each other and duplicate right keys multiply rows."""
    on = [c for c in left.columns if c in right.columns] if keys is None else list(keys)
    return join_same(left, right, on)


def attribute_join(facts: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Add the columns of an attribute table; adaptive execution broadcasts it if its size allows."""
    return facts.join(attributes, key, "left")
