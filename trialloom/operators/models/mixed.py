"""Mixed models with random intercepts, fitted from distributed sums.

The likelihood of a linear model with random intercepts depends on the rows only through cross products of the fixed
terms, sums per level and row counts per pair of levels (Bates, Maechler, Bolker and Walker 2015, J. Stat. Softw. 67(1)).
The logistic model asks for the same sums with weights, again for each step; they are grouped aggregates over the
distinct covariate patterns. What leaves the cluster grows with the levels and with the pairs of levels that meet.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.nulls import member
from trialloom.operators.models.design import Design, complete_rows, design_frame, level_codes
from trialloom.operators.models.gram import centred_products, upper_matrix
from trialloom.operators.models.levels import Solved, Structure, eliminate, level_totals, pair_totals, set_number
from trialloom.operators.models.linear import independent_columns, result_frame
from trialloom.operators.models.optimise import batched_quadratic, nelder_mead
from trialloom.session import materialise

#: Intercepts of all points that may be written into a query; more go through a joined table.
LITERAL_INTERCEPTS = 100_000
#: Rounds that look for a start of the search over spreads; where they end does not decide the result.
START_ROUNDS = 6


@dataclass
class MixedFit:
    """Fixed effects with standard errors, and the spread of each random intercept.

    ``converged`` is false where a search or an inner loop ended on its guard; such a fit must not be used for tests.
    """

    terms: list[str]
    estimates: np.ndarray
    std_errors: np.ndarray
    group_sd: dict[str, float]
    sigma: float | None
    criterion: float
    n: float
    family: str
    dropped: list[str] = field(default_factory=list)
    theta: np.ndarray | None = None
    converged: bool = True

    def table(self, spark, model: str, outcome: str, sample: str) -> DataFrame:
        z = self.estimates / self.std_errors
        rows = [
            (model, outcome, sample, self.family, t, b, e, s, math.erfc(abs(s) / math.sqrt(2)))
            for t, b, e, s in zip(self.terms, self.estimates, self.std_errors, z)
        ]
        rows += [
            (model, outcome, sample, self.family, f"sd({g})", v, float("nan"), float("nan"), float("nan"))
            for g, v in self.group_sd.items()
        ]
        if self.sigma is not None:
            rows.append((model, outcome, sample, self.family, "sd(residual)", self.sigma, *([float("nan")] * 3)))
        if not self.converged:
            rows.append((model, outcome, sample, self.family, "(not converged)", *([float("nan")] * 4)))
        return result_frame(spark, rows)


def is_binary(df: DataFrame, outcome: str) -> bool:
    """Whether every value is 0 or 1; one missing value says no."""
    share = df.agg(F.avg(member(outcome, (0, 1)).cast("int"))).first()[0]
    return share == 1


def _columns(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([table[c].to_numpy() for c in names]).astype(float) if len(table) else np.zeros((0, len(names)))


def _solve_fixed(out: Solved) -> tuple[np.ndarray, np.ndarray, float]:
    """Cholesky factor of the fixed block, its coefficients, and what the fixed terms leave of the last column."""
    right = np.linalg.cholesky(out.fixed[:-1, :-1])
    cb = np.linalg.solve(right, out.fixed[:-1, -1])
    return right, np.linalg.solve(right.T, cb), float(out.fixed[-1, -1] - cb @ cb)


@dataclass
class LinearSums:
    """Everything a linear fit needs: per level the row count and the sums of centred columns (the outcome last), the
    row counts of level pairs, and the overall products of the centred columns."""

    structure: Structure
    counts: np.ndarray
    sums: np.ndarray
    pairs: np.ndarray
    means: np.ndarray
    products: np.ndarray
    rows: float


def linear_sums(frame: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> LinearSums:
    """Three passes of grouped aggregates: levels, pairs of levels, products around the means."""
    sums = {"n": F.count(F.lit(1)), **{f"s_{i}": F.sum(c) for i, c in enumerate(columns)}}
    tables = level_totals(frame, groups, sums)
    pairs = pair_totals(frame, groups, F.count(F.lit(1)))
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tables])])
    counts = np.concatenate([t["n"].to_numpy() for t in tables]).astype(float)
    found = np.concatenate([_columns(t, list(sums)[1:]) for t in tables])
    rows = counts[: starts[1]].sum()
    means = found[: starts[1]].sum(axis=0) / rows
    left, right, shared = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for f, g, t in pairs:
        for at, k in ((left, f), (right, g)):
            place = pc.index_in(t[groups[k]], tables[k][groups[k]].combine_chunks())
            at.append(starts[k] + place.to_numpy().astype(int))
        shared.append(t["w"].to_numpy().astype(float))
    structure = Structure([len(t) for t in tables], np.concatenate(left), np.concatenate(right))
    products = upper_matrix(centred_products(frame, columns, means).first(), len(columns))
    return LinearSums(structure, counts, found - np.outer(counts, means), np.concatenate(shared), means, products, float(rows))


def solve_linear(sums: LinearSums, groups: Sequence[str], names: Sequence[str]) -> MixedFit:
    """REML fit; the last column of ``sums`` is the outcome, the others the terms."""
    p_all = len(sums.means) - 1
    kept = independent_columns(sums.products[:p_all, :p_all])
    used = [*kept, p_all]
    levels = np.column_stack([sums.counts, sums.sums[:, used]])
    fixed = np.zeros((len(used) + 1, len(used) + 1))
    fixed[0, 0] = sums.rows
    fixed[1:, 1:] = sums.products[np.ix_(used, used)]
    n, p = sums.rows, len(kept) + 1

    def pieces(theta: np.ndarray):
        scale = np.asarray(theta)[sums.structure.owner]
        out = eliminate(sums.structure, scale, sums.counts, sums.pairs, levels * scale[:, None], fixed)
        right, beta, r2 = _solve_fixed(out)
        return out.log_det, right, beta, max(r2, 1e-300)

    def deviance(theta: np.ndarray) -> float:
        log_det, right, _, r2 = pieces(theta)
        return float(log_det + 2 * np.log(np.diag(right)).sum() + (n - p) * (1 + math.log(2 * math.pi * r2 / (n - p))))

    theta, value, converged = nelder_mead(deviance, [0.5] * len(groups))
    _, right, beta, r2 = pieces(theta)
    inverse = np.linalg.inv(right @ right.T)
    s2 = r2 / (n - p)
    shift = np.array([1.0, *-sums.means[kept]])
    sigma = math.sqrt(s2)
    return MixedFit(
        ["(Intercept)", *(names[i] for i in kept)],
        np.array([shift @ beta + sums.means[p_all], *beta[1:]]),
        np.sqrt(s2 * np.array([shift @ inverse @ shift, *np.diag(inverse)[1:]])),
        {g: float(t * sigma) for g, t in zip(groups, theta)},
        sigma,
        value,
        n,
        "gaussian",
        [names[i] for i in range(p_all) if i not in kept],
        theta,
        converged,
    )


def fit_linear(df: DataFrame, outcome: str, design: Design, groups: Sequence[str]) -> MixedFit:
    """Linear fit. The driver holds 8 bytes for every level and column, and 24 for every pair of levels that meet."""
    rows = complete_rows(df, [outcome, *design.columns, *groups])
    frame = design_frame(rows, design, [F.col(outcome).cast("double").alias("_y"), *groups])
    x = [f"x{i}" for i in range(len(design.terms))]
    return solve_linear(linear_sums(frame, [*x, "_y"], groups), groups, design.names)


def covariate_patterns(frame: DataFrame, x: Sequence[str], outcome: str, groups: Sequence[str]) -> DataFrame:
    """Distinct (terms, groups) with the number of rows and of successes."""
    return frame.groupBy(*x, *groups).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col(outcome).cast("double")).alias("_s")
    )


def group_levels(df: DataFrame, group: str) -> list:
    return sorted(df.select(group).where(F.col(group).isNotNull()).distinct().toArrow()[group].to_pylist())


def number_levels(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """The group columns as level numbers from 0 on, in the order of the levels, and how many levels each has."""
    levels = {g: group_levels(df, g) for g in groups}
    names = [f"_number{i}" for i in range(len(groups))]
    return level_codes(df, levels, names).withColumnsRenamed(dict(zip(names, groups))), [len(levels[g]) for g in groups]


@dataclass
class WeightedSums:
    """Log likelihood, gradient and weights at one point: for the fixed terms, the levels, and pairs of levels."""

    loglik: float
    gx: np.ndarray
    xx: np.ndarray
    gz: np.ndarray
    zx: np.ndarray
    pairs: np.ndarray


@dataclass
class _Patterns:
    """Stored patterns with numbered levels, and the structure of the levels."""

    frame: DataFrame
    x: list[str]
    codes: list[str]
    structure: Structure
    starts: np.ndarray
    pair_keys: np.ndarray

    @classmethod
    def of(cls, frame: DataFrame, x: list[str], codes: list[str], sizes: Sequence[int]) -> _Patterns:
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        q, keys = int(starts[-1]), [np.zeros(0, int)]
        for f, g, t in pair_totals(frame, codes, F.count(F.lit(1))):
            keys.append((t[codes[f]].to_numpy().astype(int) + starts[f]) * q + t[codes[g]].to_numpy().astype(int) + starts[g])
        found = np.sort(np.concatenate(keys))
        return cls(frame, x, codes, Structure(sizes, found // max(q, 1), found % max(q, 1)), starts, found)

    def _terms(self, points: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[DataFrame, str]:
        """Patterns and, as SQL, the intercept at point ``_k``: a literal while it is small, else a table per factor."""
        m, q, df = len(points), self.structure.q, self.frame
        if m * q <= LITERAL_INTERCEPTS:
            return df, " + ".join(f"_own[_k * {q} + {c} + {at}]" for c, at in zip(self.codes, self.starts))
        for f, code in enumerate(self.codes):
            own = np.stack([b[self.starts[f] : self.starts[f + 1]] for _, b in points], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, own.size + 1, m, dtype=np.int32), own.ravel())
            table = pa.table({code: pa.array(np.arange(len(own), dtype=np.int32)), f"_b{f}": lists})
            df = df.join(df.sparkSession.createDataFrame(table), code)
        return df, " + ".join(f"_b{f}[_k]" for f in range(len(self.codes)))

    def weighted(self, points: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[WeightedSums]:
        """The sums at every (coefficients, intercepts) point, from grouped aggregates over all patterns.

        A point is a row beside each pattern. Coefficients are array literals that the generated code refers to, so the
        same code serves every step.
        """
        m, p, q, codes = len(points), len(self.x) + 1, self.structure.q, ", ".join(self.codes)
        df, intercept = self._terms(points)
        args = {"m": m, "beta": json.dumps([float(v) for b, _ in points for v in b]), "own": "[]"}
        if df is self.frame:
            args["own"] = json.dumps([float(v) for _, b in points for v in b])
        slopes = "".join(f" + _beta[_k * {p} + {j + 1}] * {c}" for j, c in enumerate(self.x))
        kept = ", ".join(["_k", *self.codes, *self.x, "_n", "_s"])
        rows = f"""
        WITH a AS (SELECT *, from_json(:beta, 'array<double>') AS _beta, from_json(:own, 'array<double>') AS _own,
                          explode(sequence(0, :m - 1)) AS _k FROM {{patterns}}),
        e AS (SELECT {kept}, _beta[_k * {p}]{slopes} + {intercept} AS _eta FROM a),
        v AS (SELECT *, 1 / (1 + exp(-greatest(-35D, least(35D, _eta)))) AS _mu FROM e),
        r AS (SELECT *, _n * _mu * (1 - _mu) AS _w, _s - _n * _mu AS _r FROM v)"""
        ones = ["1D", *self.x]
        whole = ["sum(_s * _eta - _n * (greatest(_eta, 0D) + log1p(exp(-abs(_eta))))) AS ll"]
        whole += [f"sum(_r * {c}) AS g{j}" for j, c in enumerate(ones)]
        whole += [f"sum(_w * {ones[i]} * {ones[j]}) AS p_{i}_{j}" for i in range(p) for j in range(i, p)]
        per_level = ["sum(_r) AS r", *[f"sum(_w * {c}) AS z{j}" for j, c in enumerate(ones)]]

        def grouped(sets: Sequence[Sequence[str]], sums: Sequence[str]) -> list[pa.Table]:
            if not sets:
                return []
            listed = ", ".join(f"(_k, {', '.join(s)})" for s in sets)
            text = f"{rows} SELECT _k, {codes}, grouping_id() AS _set, {', '.join(sums)} FROM r GROUP BY _k, {codes} GROUPING SETS ({listed})"
            found = df.sparkSession.sql(text, args, patterns=df).toArrow()
            return [found.filter(pc.equal(found["_set"], set_number(s, self.codes))) for s in sets]

        two = list(combinations(range(len(self.codes)), 2))
        # three independent jobs over one stored table
        with ThreadPoolExecutor(3) as pool:
            first = pool.submit(lambda: df.sparkSession.sql(f"{rows} SELECT _k, {', '.join(whole)} FROM r GROUP BY _k", args, patterns=df).collect())
            second = pool.submit(grouped, [[c] for c in self.codes], per_level)
            third = pool.submit(grouped, [[self.codes[f], self.codes[g]] for f, g in two], ["sum(_w) AS w"])
            overall, levels, pairs = first.result(), second.result(), [(*fg, t) for fg, t in zip(two, third.result())]
        out = [None] * m
        for r in overall:
            out[r["_k"]] = WeightedSums(r["ll"], np.array([r[f"g{j}"] for j in range(p)]), upper_matrix(r, p), np.zeros(q), np.zeros((q, p)), np.zeros(len(self.pair_keys)))
        for f, t in enumerate(levels):
            point, place, values = t["_k"].to_numpy(), t[self.codes[f]].to_numpy().astype(int) + self.starts[f], _columns(t, ["r", *[f"z{j}" for j in range(p)]])
            for k in range(m):
                mine = point == k
                out[k].gz[place[mine]] = values[mine, 0]
                out[k].zx[place[mine]] = values[mine, 1:]
        for f, g, t in pairs:
            key = (t[self.codes[f]].to_numpy().astype(int) + self.starts[f]) * q + t[self.codes[g]].to_numpy().astype(int) + self.starts[g]
            point, place, w = t["_k"].to_numpy(), np.searchsorted(self.pair_keys, key), t["w"].to_numpy()
            for k in range(m):
                out[k].pairs[place[point == k]] = w[point == k]
        return out

    def _bordered(self, sums: WeightedSums, scale: np.ndarray, right_levels: np.ndarray, right_fixed: np.ndarray) -> Solved:
        p = len(right_fixed)
        fixed = np.zeros((p + 1, p + 1))
        fixed[:p, :p], fixed[p, :p], fixed[:p, p] = sums.xx, right_fixed, right_fixed
        rhs = np.column_stack([sums.zx * scale[:, None], right_levels])
        return eliminate(self.structure, scale, sums.zx[:, 0], sums.pairs, rhs, fixed)

    def step(self, sums: WeightedSums, theta: np.ndarray, b: np.ndarray):
        """Criterion at the point, and the Newton step: gain, change of the coefficients and of the intercepts."""
        scale = theta[self.structure.owner]
        u = np.divide(b, scale, out=np.zeros_like(b), where=scale > 0)
        out = self._bordered(sums, scale, scale * sums.gz - u, sums.gx)
        right, d_beta, corner = _solve_fixed(out)
        return -2 * sums.loglik + u @ u + out.log_det, -corner, d_beta, scale * out.back(d_beta), right

    def quadratic(self, sums: WeightedSums, beta: np.ndarray, b: np.ndarray):
        """The penalised fit for any spreads, if the log likelihood were the parabola that it is at a known point."""
        s = self.structure
        levels = sums.gz + sums.zx[:, 0] * b + sums.zx @ beta
        levels += np.bincount(s.left, sums.pairs * b[s.right], s.q) + np.bincount(s.right, sums.pairs * b[s.left], s.q)
        fixed = sums.gx + sums.xx @ beta + sums.zx.T @ b

        def fit(theta: np.ndarray):
            scale = np.asarray(theta)[s.owner]
            out = self._bordered(sums, scale, scale * levels, fixed)
            _, new, corner = _solve_fixed(out)
            return out.log_det + corner, new, lambda: scale * out.back(new)

        return fit


def fit_logistic(
    df: DataFrame, outcome: str, design: Design, groups: Sequence[str], inner: int = 60, numbered: Sequence[int] | None = None
) -> MixedFit:
    """Logistic fit by the Laplace criterion; the outer search is over the random-intercept spreads only.

    ``numbered`` says that the groups hold level numbers from 0 on, and how many each has (see ``number_levels``); a
    level without rows changes nothing.

    First the spreads are taken from the parabola at the last point, which needs one pass each time and ends close by;
    then a whole batch of candidates shares each pass, every one started where the parabola puts it.
    """
    rows = complete_rows(df, [outcome, *design.columns, *groups])
    frame = design_frame(rows, design, [F.col(outcome).alias("_y"), *groups])
    x_all = [f"x{i}" for i in range(len(design.terms))]
    patterns = materialise(covariate_patterns(frame, x_all, "_y", groups), "patterns")
    codes = [f"_g{i}" for i in range(len(groups))]
    if numbered is None:
        coded, sizes = number_levels(patterns, groups)
        coded = materialise(coded.withColumnsRenamed(dict(zip(groups, codes))), "patterns")
    else:
        coded, sizes = patterns.withColumnsRenamed(dict(zip(groups, codes))), list(numbered)
    weighted = patterns.select(
        *[(F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(c) for c in x_all], F.sum("_n"), F.sum("_s")
    ).first() if x_all else patterns.select(F.sum("_n"), F.sum("_s")).first()
    means = np.array(weighted[: len(x_all)], dtype=float)
    n, successes = float(weighted[len(x_all)]), float(weighted[len(x_all) + 1])
    centre = F.lit([float(m) for m in means]) if x_all else None
    centred = coded.withColumns({c: F.col(c) - centre[i] for i, c in enumerate(x_all)}) if x_all else coded
    data = _Patterns.of(centred, x_all, codes, sizes)
    q = data.structure.q
    start = np.zeros(len(x_all) + 1)
    start[0] = math.log(max(successes, 0.5) / max(n - successes, 0.5))
    first = data.weighted([(start, np.zeros(q))])[0]
    kept = independent_columns(first.xx[1:, 1:] if len(x_all) else np.zeros((0, 0)))
    columns = [0, *(i + 1 for i in kept)]
    data.x = [x_all[i] for i in kept]
    first.gx, first.xx, first.zx = first.gx[columns], first.xx[np.ix_(columns, columns)], first.zx[:, columns]
    # the best known point with its sums
    at = {"beta": start[columns], "b": np.zeros(q), "sums": first, "value": math.inf}
    last: dict[tuple, tuple] = {}
    unfinished: set[tuple] = set()

    theta = np.full(len(groups), 0.5)
    for _ in range(START_ROUNDS):
        fit = data.quadratic(at["sums"], at["beta"], at["b"])
        before, (theta, _, _) = theta, nelder_mead(lambda t: fit(t)[0], theta, rounds=400, tolerance=1e-5)
        _, beta, intercepts = fit(theta)
        b = intercepts()
        limit = min(1.0, 5.0 / max(np.abs(np.concatenate([beta - at["beta"], b - at["b"]])).max(), 1e-12))
        at["beta"], at["b"] = at["beta"] + limit * (beta - at["beta"]), at["b"] + limit * (b - at["b"])
        at["sums"] = data.weighted([(at["beta"], at["b"])])[0]
        if np.abs(theta - before).max() < 0.05 * (0.1 + theta.max()):
            break

    def deviances(thetas: list[np.ndarray], tolerance: float = 1e-5) -> list[float]:
        fit = data.quadratic(at["sums"], at["beta"], at["b"])
        states = []
        for theta in thetas:
            _, beta, intercepts = fit(theta)
            b = intercepts()
            far = max(np.abs(np.concatenate([beta - at["beta"], b - at["b"]])).max(), 1e-12)
            # a parabola is no guide far away from its point
            states.append((beta, b) if far < 2.0 else (at["beta"], np.where(theta[data.structure.owner] > 0, at["b"], 0.0)))
        values, solved = [math.inf] * len(thetas), [None] * len(thetas)
        open_ = list(range(len(thetas)))
        for _ in range(inner):
            found = data.weighted([states[k] for k in open_])
            still = []
            for k, sums in zip(open_, found):
                beta, b = states[k]
                value, gain, d_beta, d_b, right = data.step(sums, thetas[k], b)
                limit = min(1.0, 5.0 / max(np.abs(np.concatenate([d_beta, d_b])).max(), 1e-12))
                # a small enough step needs no further pass: it lowers the criterion by ``gain``
                values[k], solved[k] = value - gain, (beta + limit * d_beta, b + limit * d_b, right)
                states[k] = solved[k][:2]
                if gain > tolerance:
                    still.append(k)
                elif value - gain < at["value"]:
                    at.update(beta=beta, b=b, sums=sums, value=value - gain)
            open_ = still
            if not open_:
                break
        else:
            unfinished.update(tuple(thetas[k]) for k in open_)
        for k, theta in enumerate(thetas):
            last[tuple(theta)] = solved[k]
        return values

    theta, _, converged = batched_quadratic(deviances, theta, 0.1 * max(0.3, float(theta.max())))
    value = deviances([theta], 1e-10)[0]
    beta, _, right = last[tuple(theta)]
    inverse = np.linalg.inv(right @ right.T)
    shift = np.array([1.0, *-means[kept]])
    return MixedFit(
        ["(Intercept)", *(design.names[i] for i in kept)],
        np.array([shift @ beta, *beta[1:]]),
        np.sqrt(np.array([shift @ inverse @ shift, *np.diag(inverse)[1:]])),
        {g: float(t) for g, t in zip(groups, theta)},
        None,
        value,
        n,
        "binomial",
        [design.names[i] for i in range(len(x_all)) if i not in kept],
        theta,
        converged and tuple(theta) not in unfinished,
    )


def fit_mixed(
    df: DataFrame, outcome: str, design: Design, groups: Sequence[str], drop_missing_first: bool = False
) -> MixedFit:
    """Logistic if every outcome is 0 or 1, otherwise linear.

    A missing outcome makes the fit linear, unless ``drop_missing_first`` asks to look at known outcomes only.
    """
    seen = df.filter(F.col(outcome).isNotNull()) if drop_missing_first else df
    fit = fit_logistic if is_binary(seen, outcome) else fit_linear
    return fit(seen, outcome, design, groups)
