"""Model designs as data: which columns, products and standardised columns enter a model."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trialloom.functions.nulls import ordinal
from trialloom.operators.features import standardised
from trialloom.session import small_frame

Term = tuple[str, ...]


def main(*columns: str) -> list[Term]:
    return [(c,) for c in columns]


def crossed(*factors: str | Sequence[str]) -> list[Term]:
    """Main effects and all interactions of the factors; a factor may be a sum of columns."""
    sides = [[f] if isinstance(f, str) else list(f) for f in factors]
    terms: list[Term] = []
    for size in range(1, len(sides) + 1):
        for chosen in combinations(sides, size):
            combos: list[Term] = [()]
            for side in chosen:
                combos = [c + (x,) for c in combos for x in side]
            terms += combos
    return terms


def distinct_terms(terms: Iterable[Term]) -> list[Term]:
    """First mention of each term, lower orders first."""
    seen: dict[frozenset, Term] = {}
    for t in terms:
        seen.setdefault(frozenset(t), t)
    return sorted(seen.values(), key=len)


@dataclass(frozen=True)
class Design:
    """Fixed-effect terms (the intercept is implied) and the columns to standardise on the model's rows."""

    terms: tuple[Term, ...]
    scaled: tuple[str, ...] = ()

    @classmethod
    def of(cls, *groups: Iterable[Term], scaled: Sequence[str] = ()) -> Design:
        return cls(tuple(distinct_terms(t for g in groups for t in g)), tuple(scaled))

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for t in self.terms for c in t))

    @property
    def names(self) -> list[str]:
        return [":".join(f"scale({c})" if c in self.scaled else c for c in t) for t in self.terms]


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a NULL in any model column."""
    return df.dropna(subset=list(dict.fromkeys(columns)))


def design_frame(df: DataFrame, design: Design, keep: Sequence[str]) -> DataFrame:
    """``keep`` and one double column per term, named ``x0``, ``x1``, ... in design order."""
    base = {c: F.col(c).cast("double") for c in design.columns}
    if design.scaled:
        typed = df.withColumns({c: base[c] for c in design.scaled})
        base.update(standardised(typed, design.scaled))
    terms = [reduce(lambda a, b: a * b, [base[c] for c in t]) for t in design.terms]
    return df.select(*keep, *[t.alias(f"x{i}") for i, t in enumerate(terms)])


def level_codes(df: DataFrame, levels: dict[str, Sequence], codes: Sequence[str]) -> DataFrame:
    """Replace each group column by its 0-based position in the group's levels; NULL stays NULL.

    A table of codes has a known size, by which Spark decides whether it is broadcast.
    """
    for (group, values), code in zip(levels.items(), codes):
        schema = StructType([df.schema[group], StructField(code, IntegerType())])
        table = small_frame(df.sparkSession, [(v, i) for i, v in enumerate(values)], schema)
        df = df.join(table, group, "left").drop(group)
    return df


def numeric_code(df: DataFrame, columns: Sequence[str], levels: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """All-numeric coding: level numbers for ordered labels, 0/1 for booleans."""
    levels = levels or {}
    return df.withColumns(
        {c: (ordinal(c, levels[c]) if c in levels else F.col(c)).cast("double") for c in columns}
    )
