"""Random-intercept systems from sums per level and per pair of levels.

With one random intercept per level of each factor the normal equations need nothing of the rows but sums over the rows
of a level and weights shared by two levels of different factors. Levels of one factor never meet, so their block is
diagonal and is eliminated without ever being written as a matrix. What the elimination leaves on the other levels is
kept sparse; a factor that contains the eliminated one (courses in an institution) stays diagonal and goes the same way.
Only levels whose factors really cross end in a dense block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of couplings that an elimination may write down; denser crossings are solved densely at once.
FILL_PAIRS = 30_000_000


# sums of the rows ----------------------------------------------------------------------------------------------------
def _grouped(df: DataFrame, sets: Sequence[Sequence[str]], groups: Sequence[str], keys: Sequence[str], sums: dict[str, Column]) -> pa.Table:
    """Sums for several sets of grouping columns from one pass; ``_set`` tells them apart."""
    wanted = [[F.col(c) for c in (*keys, *s)] for s in sets]
    every = [F.col(c) for c in (*keys, *groups)]
    return df.groupingSets(wanted, *every).agg(F.grouping_id().alias("_set"), *[c.alias(n) for n, c in sums.items()]).toArrow()


def set_number(chosen: Sequence[str], groups: Sequence[str]) -> int:
    """The number Spark gives to a grouping set: a bit for each column that is rolled up."""
    return sum(1 << (len(groups) - 1 - i) for i, g in enumerate(groups) if g not in chosen)


def level_totals(df: DataFrame, groups: Sequence[str], sums: dict[str, Column], keys: Sequence[str] = ()) -> list[pa.Table]:
    """For each factor a table of its levels with the sums; all factors share one pass."""
    found = _grouped(df, [[g] for g in groups], groups, keys, sums)
    return [found.filter(pc.equal(found["_set"], set_number([g], groups))).select([*keys, g, *sums]) for g in groups]


def pair_totals(df: DataFrame, groups: Sequence[str], weight: Column, keys: Sequence[str] = ()) -> list[tuple[int, int, pa.Table]]:
    """For each two factors a table of the levels that meet, with the summed weight."""
    pairs = list(combinations(range(len(groups)), 2))
    if not pairs:
        return []
    found = _grouped(df, [[groups[f], groups[g]] for f, g in pairs], groups, keys, {"w": weight})
    return [
        (f, g, found.filter(pc.equal(found["_set"], set_number([groups[f], groups[g]], groups))).select([*keys, groups[f], groups[g], "w"]))
        for f, g in pairs
    ]


# elimination ---------------------------------------------------------------------------------------------------------
@dataclass
class _Step:
    """Elimination of the levels ``rows``: their couplings (``row``, ``other``, ``slot``) and where products of two go."""

    rows: np.ndarray
    row: np.ndarray
    other: np.ndarray
    slot: np.ndarray
    first: np.ndarray
    second: np.ndarray
    target: np.ndarray


@dataclass
class Structure:
    """Which levels meet. ``sizes`` are levels per factor, numbered through; ``left`` and ``right`` are the pairs.

    Entries of the system are numbered: first one for each level, then one for each pair; eliminations may add more.
    """

    sizes: Sequence[int]
    left: np.ndarray
    right: np.ndarray
    steps: list[_Step] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.q = int(sum(self.sizes))
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        a, b = np.minimum(self.left, self.right), np.maximum(self.left, self.right)
        slot = np.arange(self.q, self.q + len(a))
        self.entries = self.q + len(a)
        open_ = list(np.argsort([-s for s in self.sizes], kind="stable"))
        while open_:
            f = open_[0]
            mine_a, mine_b = self.owner[a] == f, self.owner[b] == f
            if (mine_a & mine_b).any():
                break
            touch = mine_a | mine_b
            row, other = np.where(mine_a, a, b)[touch], np.where(mine_a, b, a)[touch]
            order = np.argsort(row, kind="stable")
            row, other, own = row[order], other[order], slot[touch][order]
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            degree = np.diff(begin, append=len(row))
            if (degree * (degree + 1) // 2).sum() > FILL_PAIRS:
                break
            # of every level, each coupling with itself and with those behind it
            later = np.repeat(degree, degree) - (np.arange(len(row)) - np.repeat(begin, degree))
            first = np.repeat(np.arange(len(row)), later)
            second = first + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
            u, v = np.minimum(other[first], other[second]), np.maximum(other[first], other[second])
            a, b, slot = a[~touch], b[~touch], slot[~touch]
            crossed = u != v
            old, new = a * self.q + b, np.unique((u * self.q + v)[crossed])
            fill = new[~np.isin(new, old)]
            a, b = np.concatenate([a, fill // self.q]), np.concatenate([b, fill % self.q])
            slot = np.concatenate([slot, self.entries + np.arange(len(fill))])
            self.entries += len(fill)
            target = u.copy()
            if crossed.any():
                keys = a * self.q + b
                by = np.argsort(keys)
                target[crossed] = slot[by[np.searchsorted(keys[by], (u * self.q + v)[crossed])]]
            self.steps.append(_Step(np.flatnonzero(self.owner == f), row, other, own, first, second, target))
            open_.pop(0)
        self.dense = np.flatnonzero(np.isin(self.owner, open_))
        place = np.full(self.q, -1)
        place[self.dense] = np.arange(len(self.dense))
        self.dense_pairs = place[a], place[b], slot


@dataclass
class Solved:
    """What is left on the fixed columns, the log determinant of the eliminated block, and how to go back."""

    fixed: np.ndarray
    log_det: float
    back: object


def eliminate(structure: Structure, scale: np.ndarray, diagonal: np.ndarray, pairs: np.ndarray, rhs: np.ndarray, fixed: np.ndarray) -> Solved:
    """Eliminate all levels from the penalised system ``[S W S + I, R; R', F]``.

    ``scale`` is S (one number for each level), ``diagonal`` and ``pairs`` are W, ``rhs`` is R (levels by columns, already
    scaled) and ``fixed`` is F.
    """
    s = structure
    value = np.zeros(s.entries)
    value[: s.q] = scale * scale * diagonal + 1.0
    value[s.q : s.q + len(pairs)] = scale[s.left] * scale[s.right] * pairs
    rhs, fixed = rhs.copy(), fixed.copy()
    log_det, undo = 0.0, []
    for step in s.steps:
        pivot = value[step.rows]
        log_det += float(np.log(pivot).sum())
        coupling = value[step.slot]
        share = coupling / value[step.row]
        if len(step.target):
            value -= np.bincount(step.target, coupling[step.first] * share[step.second], s.entries)
        own = rhs[step.rows]
        for j in range(rhs.shape[1]):
            if len(step.row):
                rhs[:, j] -= np.bincount(step.other, share * rhs[step.row, j], s.q)
        fixed -= own.T @ (own / pivot[:, None])
        undo.append((step, pivot, coupling, own))
    factor = None
    if len(s.dense):
        block = np.diag(value[s.dense])
        at_a, at_b, slot = s.dense_pairs
        block[at_a, at_b] = block[at_b, at_a] = value[slot]
        factor = np.linalg.cholesky(block)
        log_det += 2 * float(np.log(np.diag(factor)).sum())
        half = np.linalg.solve(factor, rhs[s.dense])
        fixed -= half.T @ half

    def back(beta: np.ndarray) -> np.ndarray:
        """The scaled intercepts for given values of all columns but the last, which is the right-hand side."""
        u = np.zeros(s.q)
        combine = np.append(-beta, 1.0)
        if factor is not None:
            u[s.dense] = np.linalg.solve(factor.T, half @ combine)
        for step, pivot, coupling, own in reversed(undo):
            met = np.bincount(step.row, coupling * u[step.other], s.q)[step.rows] if len(step.row) else 0.0
            u[step.rows] = (own @ combine - met) / pivot
        return u

    return Solved(fixed, log_det, back)
