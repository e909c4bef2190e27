from __future__ import annotations

import math
import resource

import numpy as np
import pytest
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from trialloom.operators.models import levels, mixed
from trialloom.operators.models.optimise import batched_quadratic, nelder_mead
from trialloom.functions.tails import beta_tail, chi_square_1df_tail, f_upper, t_two_sided
from trialloom.operators.features import composite_index, group_flag, with_zscores
from trialloom.operators.models.design import Design, crossed, design_frame, main
from trialloom.operators.models.gram import wide_gram
from trialloom.operators.models.linear import ols, ols_factor, with_p_values
from trialloom.operators.models.mixed import fit_linear, fit_logistic, fit_mixed, is_binary
from trialloom.operators.models.sparse import lasso_baseline, posterior_draws, posterior_summary
from trialloom.plans import confirmatory


def simulated(seed=7, n=900):
    """Rows with two crossed factors, a nested one and known effects."""
    rng = np.random.default_rng(seed)
    inst = rng.integers(0, 4, n)
    course = inst * 10 + rng.integers(0, 5, n)
    strata = rng.integers(0, 9, n)
    a, x = rng.integers(0, 2, n), rng.normal(3, 2, n)
    u = {k: rng.normal(0, s, m) for k, s, m in (("i", 0.8, 4), ("c", 0.6, 50), ("s", 0.5, 9))}
    eta = 1 + 0.7 * a - 0.3 * x + u["i"][inst] + u["c"][course] + u["s"][strata]
    y = eta + rng.normal(0, 1, n)
    b = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    return inst, course, strata, a, x, y, b


@pytest.fixture(scope="module")
def data(spark):
    columns = simulated()
    rows = [tuple(v.item() for v in r) for r in zip(*columns)]
    df = spark.createDataFrame(rows, "inst int, course int, strata int, a int, x double, y double, b int")
    return df.repartition(5).cache(), columns


GROUPS = ["inst", "course", "strata"]
DESIGN = Design.of(main("a", "x"))


def dense(columns, theta):
    """Marginal covariance pieces straight from the definition."""
    inst, course, strata, a, x, y, b = columns
    X = np.column_stack([np.ones(len(y)), a, x])
    V = np.eye(len(y))
    for g, t in zip((inst, course, strata), theta):
        V += t * t * (g[:, None] == g[None, :])
    return X, V, y


def dense_reml(columns, theta):
    X, V, y = dense(columns, theta)
    Vi = np.linalg.inv(V)
    XtVX = X.T @ Vi @ X
    beta = np.linalg.solve(XtVX, X.T @ Vi @ y)
    r = y - X @ beta
    n, p = X.shape
    r2 = r @ Vi @ r
    value = np.linalg.slogdet(V)[1] + np.linalg.slogdet(XtVX)[1] + (n - p) * (1 + math.log(2 * math.pi * r2 / (n - p)))
    return value, beta, np.sqrt(np.diag(np.linalg.inv(XtVX)) * r2 / (n - p))


def test_mixed_linear_matches_dense_likelihood(data):
    df, columns = data
    fit = fit_linear(df, "y", DESIGN, GROUPS)
    value, beta, errors = dense_reml(columns, fit.theta)
    assert fit.criterion == pytest.approx(value, rel=1e-8)
    assert fit.estimates == pytest.approx(beta, rel=1e-6)
    assert fit.std_errors == pytest.approx(errors, rel=1e-6)
    for i in range(3):
        for d in (-0.05, 0.05):
            moved = fit.theta.copy()
            moved[i] = abs(moved[i] + d)
            assert dense_reml(columns, moved)[0] >= value - 1e-6
    assert fit.estimates[1] == pytest.approx(0.7, abs=0.25) and fit.estimates[2] == pytest.approx(-0.3, abs=0.08)


def laplace(columns, theta):
    """Dense penalised fit and Laplace criterion of the logistic model."""
    inst, course, strata, a, x, y, b = columns
    return dense_laplace(np.column_stack([np.ones(len(b)), a, x]), (inst, course, strata), b, theta)


def dense_laplace(X, groups, b, theta):
    Z = np.column_stack([(g[:, None] == np.unique(g)[None, :]) * t for g, t in zip(groups, theta)])
    D = np.column_stack([X, Z])
    P = np.diag([0.0] * X.shape[1] + [1.0] * Z.shape[1])
    g = np.zeros(D.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-D @ g))
        H = D.T @ (D * (mu * (1 - mu))[:, None]) + P
        g = g + np.linalg.solve(H, D.T @ (b - mu) - P @ g)
    eta = D @ g
    mu = 1 / (1 + np.exp(-eta))
    u = g[X.shape[1]:]
    zz = Z.T @ (Z * (mu * (1 - mu))[:, None]) + np.eye(Z.shape[1])
    value = -2 * (b @ eta - np.logaddexp(0, eta).sum()) + u @ u + np.linalg.slogdet(zz)[1]
    return value, g[: X.shape[1]], np.sqrt(np.diag(np.linalg.inv(H))[: X.shape[1]])


def test_mixed_logistic_matches_dense_fit(data):
    df, columns = data
    fit = fit_logistic(df, "b", DESIGN, GROUPS)
    value, beta, errors = laplace(columns, fit.theta)
    assert fit.criterion == pytest.approx(value, abs=2e-3)
    assert fit.estimates == pytest.approx(beta, abs=2e-3)
    assert fit.std_errors == pytest.approx(errors, rel=2e-2)
    for i in range(3):
        for d in (-0.1, 0.1):
            moved = fit.theta.copy()
            moved[i] = abs(moved[i] + d)
            assert laplace(columns, moved)[0] >= value - 5e-3


@pytest.mark.parametrize("spread", [0.0, 0.3, 1.0, 2.6, 5.0])
def test_logistic_search_reaches_every_spread(spark, spread):
    rng = np.random.default_rng(int(spread * 10) + 1)
    g = np.repeat(np.arange(40), 60)
    a = rng.integers(0, 2, len(g))
    b = (rng.random(len(g)) < 1 / (1 + np.exp(-(0.4 * a - 0.2 + spread * rng.standard_normal(40)[g])))).astype(int)
    df = spark.createDataFrame(list(zip(g.tolist(), a.tolist(), b.tolist())), "g int, a int, b int")
    fit = fit_logistic(df, "b", Design.of(main("a")), ["g"])
    assert fit.converged
    X = np.column_stack([np.ones(len(b)), a])
    value, beta, errors = dense_laplace(X, (g,), b, fit.theta)
    assert fit.criterion == pytest.approx(value, abs=2e-3)
    assert fit.estimates == pytest.approx(beta, abs=2e-3) and fit.std_errors == pytest.approx(errors, rel=2e-2)
    t = float(fit.theta[0])
    for other in (0.0, 0.5 * t, 0.9 * t, 1.1 * t, 2 * t, t + 0.1, abs(t - 0.1)):
        assert dense_laplace(X, (g,), b, [other])[0] >= value - 5e-3


@pytest.mark.parametrize("kind", ["one", "nested", "crossed", "nested and crossed", "nested twice", "crossed thrice", "apart"])
@pytest.mark.parametrize("fill", [30_000_000, 0])
def test_elimination_is_the_dense_solution(monkeypatch, kind, fill):
    monkeypatch.setattr(levels, "FILL_PAIRS", fill)
    rng = np.random.default_rng(len(kind))
    n, course = 300, rng.integers(0, 40, 300)
    codes = {
        "one": [course], "nested": [course // 8, course], "crossed": [rng.integers(0, 6, n), course],
        "nested and crossed": [course // 8, course, rng.integers(0, 9, n)], "nested twice": [course // 20, course // 4, course],
        "crossed thrice": [course % 7, rng.integers(0, 5, n), rng.integers(0, 12, n)], "apart": [course // 20, course // 20],
    }[kind]
    sizes = [int(c.max()) + 1 for c in codes]
    Z = np.column_stack([np.eye(s)[c] for s, c in zip(sizes, codes)])
    w, X = rng.random(n), rng.normal(size=(n, 4))
    W = Z.T @ (Z * w[:, None])
    left, right = np.nonzero(np.triu(W, 1))
    structure = levels.Structure(sizes, left, right)
    assert len(structure.dense) == {"crossed": 6, "nested and crossed": 14, "crossed thrice": 12}.get(kind, 0) or fill == 0
    scale = rng.random(len(W)) * (rng.random(len(W)) < 0.9)
    R, A = (Z.T @ (X * w[:, None])) * scale[:, None], W * np.outer(scale, scale) + np.eye(len(W))
    out = levels.eliminate(structure, scale, np.diag(W), W[left, right], R, X.T @ (X * w[:, None]))
    assert out.fixed == pytest.approx(X.T @ (X * w[:, None]) - R.T @ np.linalg.solve(A, R))
    assert out.log_det == pytest.approx(np.linalg.slogdet(A)[1])
    beta = rng.normal(size=3)
    assert out.back(beta) == pytest.approx(np.linalg.solve(A, R[:, 3] - R[:, :3] @ beta))


def test_cut_search_is_reported(data, monkeypatch):
    df, _ = data
    assert fit_linear(df, "y", DESIGN, GROUPS).converged
    monkeypatch.setattr(mixed, "nelder_mead", lambda f, start: nelder_mead(f, start, rounds=1))
    fit = fit_linear(df, "y", DESIGN, GROUPS)
    assert not fit.converged
    assert "(not converged)" in [r["term"] for r in fit.table(df.sparkSession, "m", "y", "s").collect()]


def test_many_levels_and_cells(spark):
    """64,000 cells of 5,000 levels: courses in institutions, crossed with strata."""
    effect = lambda lane, n: F.expr(f"(pmod(xxhash64({lane}, {n}), 2001) - 1000) / 577.35")
    rows = spark.range(192_000, numPartitions=8).select(
        (F.col("id") % 4000).alias("course"), (F.col("id") % 100).alias("inst"),
        ((F.col("id") / 4000).cast("int") % 16 * 56 + F.col("id") % 56).alias("strata"), (F.xxhash64("id") % 2).alias("a"), "id",
    )
    y = 2 + 0.5 * F.col("a") + 0.8 * effect(1, "inst") + 0.6 * effect(2, "course") + 0.4 * effect(3, "strata") + effect(4, "id")
    rows = rows.withColumn("y", y)
    assert rows.select("course", "strata").distinct().count() > 60_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    fit = fit_linear(rows, "y", Design.of(main("a")), ["inst", "course", "strata"])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2_000_000
    assert fit.converged and fit.estimates[1] == pytest.approx(0.5, abs=0.02)
    assert fit.sigma == pytest.approx(1, abs=0.02) and fit.group_sd["course"] == pytest.approx(0.6, abs=0.05)
    assert fit.group_sd["strata"] == pytest.approx(0.4, abs=0.05) and fit.group_sd["inst"] == pytest.approx(0.8, abs=0.2)


def test_search_grows_and_reports():
    point, value, done = batched_quadratic(lambda ps: [float(((p - 7) ** 2).sum()) for p in ps], [0.3, 0.3, 0.3], 0.25)
    assert done and value < 1e-4 and np.abs(point - 7).max() < 0.01
    point, _, done = batched_quadratic(lambda ps: [float((p + 1).sum()) for p in ps], [0.3], 0.25)
    assert done and point[0] < 1e-3
    assert not batched_quadratic(lambda ps: [-float(p.sum()) for p in ps], [0.3], 0.25, rounds=8)[2]
    assert nelder_mead(lambda x: float(((x - 2) ** 2).sum()), [0.5, 0.5])[2]
    assert not nelder_mead(lambda x: float(((x - 2) ** 2).sum()), [0.5, 0.5], rounds=3)[2]


def test_family_choice(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (0, 1.0, None), (1, 0.0, 0)], "b int, x double, gap int")
    assert [is_binary(df, c) for c in ("b", "x", "gap")] == [True, False, False]


def test_family_with_gap_is_linear_unless_asked(data):
    df, _ = data
    gappy = df.withColumn("b", F.when(F.col("x") > -1, F.col("b")))
    assert fit_mixed(gappy, "b", Design.of(main("a")), ["strata"]).family == "gaussian"
    assert fit_mixed(gappy, "b", Design.of(main("a")), ["strata"], drop_missing_first=True).family == "binomial"


def test_zero_variance_boundary_and_constant_term(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 5), 4, float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, always int, y double").withColumn("a", F.col("g") % 2)
    fit = fit_linear(df, "y", Design.of(main("a", "always")), ["g"])
    assert fit.dropped == ["always"] and fit.terms == ["(Intercept)", "a"]
    assert fit.group_sd["g"] < 0.3


def test_ols_matches_spark_ml(data):
    df, _ = data
    design = Design.of(crossed("a", "x"), main("strata"))
    table, summary = ols(df, "y", design)
    got = {r["term"]: r for r in table.collect()}
    vectors = RFormula(formula="y ~ a + x + a:x + strata").fit(df).transform(df)
    fit = LinearRegression(solver="normal").fit(vectors)
    order = ["a", "x", "a:x", "strata"]
    for i, t in enumerate([*order, "(Intercept)"]):
        estimate = fit.intercept if t == "(Intercept)" else fit.coefficients[i]
        assert got[t]["estimate"] == pytest.approx(estimate, rel=1e-6)
        assert got[t]["std_error"] == pytest.approx(fit.summary.coefficientStandardErrors[i], rel=1e-6)
        assert got[t]["p_value"] == pytest.approx(fit.summary.pValues[i], rel=1e-5, abs=1e-12)
    assert summary["r_squared"] == pytest.approx(fit.summary.r2)
    assert summary["adj_r_squared"] == pytest.approx(fit.summary.r2adj)


def test_ols_factor_matches_spark_ml(spark):
    rng = np.random.default_rng(5)
    rows = [("abcd"[i % 4], float(rng.normal(i % 4, 1))) for i in range(200)] + [(None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, y double")
    got = {r["term"]: r for r in with_p_values(ols_factor(df, "y", "g")).collect()}
    clean = df.dropna()
    vectors = RFormula(formula="y ~ g", stringIndexerOrderType="alphabetDesc").fit(clean).transform(clean)
    fit = LinearRegression(solver="normal").fit(vectors)
    for i, t in enumerate(["gd", "gc", "gb", "(Intercept)"]):
        estimate = fit.intercept if t == "(Intercept)" else fit.coefficients[i]
        assert got[t]["estimate"] == pytest.approx(estimate, rel=1e-8)
        assert got[t]["p_value"] == pytest.approx(fit.summary.pValues[i], rel=1e-5, abs=1e-12)
    r2, n = fit.summary.r2, clean.count()
    assert got["gb"]["r_squared"] == pytest.approx(r2)
    assert got["gb"]["f_statistic"] == pytest.approx((r2 / 3) / ((1 - r2) / (n - 4)))


def test_tails(spark):
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    # closed forms for 2 and 4 numerator degrees of freedom
    assert f_upper(3.0, 2, 20) == pytest.approx(1.3**-10)
    assert f_upper(3.0, 4, 20) == pytest.approx(0.625**10 * 4.75)
    assert t_two_sided(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert beta_tail(2, 3, 0.4) == pytest.approx(0.5248)
    row = spark.createDataFrame([(3.841458821,), (None,)], "s double").select(chi_square_1df_tail("s")).collect()
    assert row[0][0] == pytest.approx(0.05) and row[1][0] is None


def test_design_expansion():
    assert crossed("a", ["l", "s"]) == [("a",), ("l",), ("s",), ("a", "l"), ("a", "s")]
    assert len(crossed("a", "b", "c")) == 7
    names = confirmatory.MODELS["affirm.csit"].names
    assert names[:3] == ["affirm", "highHDI", "scale(threat_country)"]
    assert "affirm:highHDI:scale(threat_country)" in names and len(names) == 13
    assert len(confirmatory.planned_fits()) == 45


def test_design_scaling_uses_model_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 3.0), (1, None)], "a int, x double").dropna()
    frame = design_frame(df, Design.of(crossed("a", "x"), scaled=("x",)), [])
    got = sorted(tuple(round(v, 6) for v in r) for r in frame.collect())
    s = round(1 / math.sqrt(2), 6)
    assert got == [(0.0, s, 0.0), (1.0, -s, -s)]


def test_zscores_group_flag_and_index(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 0), ("b", 3.0, None), ("c", None, 0)], "g string, x double, f int")
    z = [r["z_x"] for r in with_zscores(df, ["x"]).collect()]
    assert z == [-1.0, 0.0, 1.0, None]
    flags = {r["g"]: r["low"] for r in group_flag(df, "g", "f", 0.5, "low").collect()}
    assert flags == {"a": False, "b": None, "c": True}
    assert [r["sig"] for r in composite_index(df, ["x"]).collect()][1:] == [0.5, pytest.approx(1 / (1 + math.exp(-1))), None]


def test_wide_gram_is_the_cross_product(data):
    df, (inst, course, strata, a, x, y, b) = data
    got = wide_gram(df.select("a", "x", "inst", "strata"), ["a", "x"], ["inst", "strata"], [4, 9])
    block = np.column_stack([np.ones(len(a)), a, x, np.eye(4)[inst], np.eye(9)[strata]])
    assert got == pytest.approx(block.T @ block)


def test_sparse_model_finds_the_effect(spark):
    rng = np.random.default_rng(11)
    n = 1500
    t, c1, c2, g = rng.integers(0, 2, n), rng.normal(size=n), rng.normal(size=n), rng.integers(0, 6, n)
    y = 1.0 * t * c1 + 0.5 * c2 + rng.normal(0, 0.5, 6)[g] + rng.normal(0, 0.5, n)
    rows = [tuple(v.item() for v in r) for r in zip(t, c1, c2, g, y)]
    df = spark.createDataFrame(rows, "t int, c1 double, c2 double, g int, y double")
    draws = posterior_draws(df, "y", ["t"], ["c1", "c2"], ["g"], chains=2, draws=150, burn=100)
    assert draws.count() == 2 * 150 * 5
    out = {r["term"]: r for r in posterior_summary(draws).collect()}
    assert out["t:c1"]["low"] < 1.0 < out["t:c1"]["high"] and out["t:c1"]["share_nonzero"] > 0.95
    assert out["c2"]["median"] == pytest.approx(0.5, abs=0.06)
    assert out["t:c2"]["share_nonzero"] < 0.9
    lasso = {r["term"]: r["estimate"] for r in lasso_baseline(df, "y", ["t"], ["c1", "c2"], 0.01).collect()}
    assert lasso["t:c1"] == pytest.approx(1.0, abs=0.1)


def test_planned_fits_recover_known_effects(spark):
    """Tiny experiment with the effects the plan expects; all groups and samples present."""
    from trialloom.registry.models import SPEC, experiment

    rows = experiment(spark, "/root/testdata/sf0.01")
    prepared = confirmatory.prepare(rows, SPEC)
    fits = [confirmatory.FitSpec("simple", "likely_complete_1", "baseline"),
            confirmatory.FitSpec("plan.original", "likely_complete_1", "fluent_intent")]
    table = {(r["model"], r["term"]): r for r in confirmatory.fit_grid(prepared, fits).collect()}
    effect = table["simple", "affirm"]
    assert abs(effect["estimate"] - 5.0) < 4 * effect["std_error"]
    assert abs(table["simple", "plans_long"]["estimate"] - 5.0) < 4 * table["simple", "plans_long"]["std_error"]
    # the sample holds one value of intent_assess, so the term is gone
    assert ("plan.original", "intent_assess") not in table and ("plan.original", "hours") in table


def test_sparse_lines_takes_the_default_draws(spark, monkeypatch):
    from trialloom.registry import models

    seen = []
    monkeypatch.setattr(models, "posterior_draws", lambda *a, **b: seen.append(b) or spark.createDataFrame([("x", 1.0)], "term string, value double"))
    models.q_sparse_lines(spark, "/root/testdata/sf0.001")
    assert not {"chains", "draws", "burn"} & set(seen[0])
