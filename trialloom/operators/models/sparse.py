"""Sparse regression of an outcome on treatments, covariates and their products.

A Bayesian lasso (Park and Casella 2008, JASA 103) with random intercepts. The rows enter through one matrix
of cross products, summed on the cluster; the sampling chains need only that matrix and run as parallel tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.operators.models.design import Design, complete_rows, crossed, design_frame, level_codes, main
from trialloom.operators.models.gram import wide_gram
from trialloom.operators.models.mixed import group_levels
from trialloom.session import materialise

# fixed values: covariates and treatments of the exploratory model
COVARIATES = [
    "intent_lecture", "intent_assess", "hours", "crs_finish", "goal_setting", "fam", "educ_parents", "age",
    "gender_female", "gender_other", "educ_phd", "educ_ma_prof", "educ_ba", "educ_some_he", "more_educ_than_parents",
    "is_teacher", "is_employed", "is_unemployed", "is_ft_student", "is_pt_student", "is_college_student",
    "is_hs_student", "is_blended", "fluent", "threat_country", "olei_olei_interest", "olei_olei_job",
    "olei_olei_degree", "olei_olei_research", "olei_olei_growth", "olei_olei_career", "olei_olei_fun",
    "olei_olei_social", "olei_olei_experience", "olei_olei_certificate", "olei_olei_uniprof", "olei_olei_peer",
    "olei_olei_language", "HDI4", "born_in_US",
]
TREATMENTS = ["affirm", "plans_short", "plans_long"]


@dataclass(frozen=True)
class SparseProblem:
    """Cross products of standardised columns, group indicators and the centred outcome."""

    names: list[str]
    scale: np.ndarray
    gram: np.ndarray
    xty: np.ndarray
    yty: float
    n: float
    owner: np.ndarray


def sparse_design(treatments: Sequence[str], covariates: Sequence[str]) -> Design:
    """Mains and every treatment x covariate product."""
    return Design.of(main(*covariates), main(*treatments), crossed(list(treatments), list(covariates)))


def sparse_problem(
    df: DataFrame, outcome: str, treatments: Sequence[str], covariates: Sequence[str], groups: Sequence[str]
) -> SparseProblem:
    design = sparse_design(treatments, covariates)
    used = [outcome, *treatments, *covariates, *groups]
    # one stored copy of the model's columns: levels, standardising and cross products all read it
    rows = materialise(complete_rows(df, used).select(*dict.fromkeys(used)), "sparse")
    levels = {g: group_levels(rows, g) for g in groups}
    frame = design_frame(rows, design, [F.col(outcome).cast("double").alias("_y"), *groups])
    codes = [f"_g{i}" for i in range(len(groups))]
    coded = level_codes(frame, levels, codes)
    x = [f"x{i}" for i in range(len(design.terms))]
    full = wide_gram(coded, [*x, "_y"], codes, [len(levels[g]) for g in groups])
    n, p = full[0, 0], len(x)
    means = full[0, :] / n
    # centre the terms and the outcome, leave the indicators as they are
    shift = np.zeros(len(full))
    shift[1 : p + 2] = means[1 : p + 2]
    ones = full[0, :]
    centred = full - np.outer(shift, ones) - np.outer(ones, shift) + n * np.outer(shift, shift)
    sd = np.sqrt(np.maximum(np.diag(centred)[1 : p + 1] / (n - 1), 0.0))
    alive = np.flatnonzero(sd > 1e-9)
    use = np.concatenate([1 + alive, np.arange(p + 2, len(full))]).astype(int)
    scale = np.ones(len(use))
    scale[: len(alive)] = sd[alive]
    gram = centred[np.ix_(use, use)] / np.outer(scale, scale)
    xty = centred[use, p + 1] / scale
    owner = np.concatenate([np.zeros(len(alive)), *[np.full(len(levels[g]), i + 1) for i, g in enumerate(groups)]])
    return SparseProblem(
        [design.names[i] for i in alive], sd[alive], gram, xty, float(centred[p + 1, p + 1]), float(n), owner.astype(int)
    )


def _chain(problem: SparseProblem, draws: int, burn: int, seed: int) -> np.ndarray:
    """One Gibbs chain; returns the kept draws of the standardised coefficients."""
    rng = np.random.default_rng(seed)
    terms = problem.owner == 0
    m, k = len(problem.owner), int(terms.sum())
    kinds = range(1, int(problem.owner.max()) + 1)
    s2 = problem.yty / problem.n
    tau2, lam2 = np.ones(k), 1.0
    group_var = {g: s2 / 10 for g in kinds}
    kept = np.zeros((draws, k))
    for it in range(burn + draws):
        prior = np.zeros(m)
        prior[terms] = 1.0 / (s2 * tau2)
        for g in kinds:
            prior[problem.owner == g] = 1.0 / group_var[g]
        chol = np.linalg.cholesky(problem.gram / s2 + np.diag(prior))
        beta = np.linalg.solve(chol.T, np.linalg.solve(chol, problem.xty / s2) + rng.standard_normal(m))
        b = beta[terms]
        rss = max(problem.yty - 2 * beta @ problem.xty + beta @ problem.gram @ beta, 1e-12)
        s2 = (rss + (b * b / tau2).sum()) / 2 / rng.gamma((problem.n + k) / 2)
        inv = rng.wald(np.sqrt(lam2 * s2 / np.maximum(b * b, 1e-300)), lam2)
        tau2 = 1.0 / np.maximum(inv, 1e-12)
        lam2 = rng.gamma(k + 1.0) / (tau2.sum() / 2 + 0.1)
        for g in kinds:
            u = beta[problem.owner == g]
            group_var[g] = (u @ u / 2 + 1e-3 * problem.yty / problem.n) / rng.gamma(len(u) / 2 + 1.0)
        if it >= burn:
            # a draw below the adaptive lasso's threshold (Zou 2006, JASA 101) counts as exactly zero
            limit = np.sqrt(s2) * lam2**0.25 / np.sqrt(problem.n)
            kept[it - burn] = np.where(np.abs(b) > limit, b, 0.0)
    return kept


def posterior_draws(
    df: DataFrame,
    outcome: str,
    treatments: Sequence[str] = tuple(TREATMENTS),
    covariates: Sequence[str] = tuple(COVARIATES),
    groups: Sequence[str] = ("course", "strata"),
    chains: int = 4,
    draws: int = 400,
    burn: int = 200,
    seed: int = 2138,
) -> DataFrame:
    """``(chain, draw, term, value)`` on the original scale of the columns, one task per chain."""
    spark = df.sparkSession
    problem = sparse_problem(df, outcome, treatments, covariates, groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chain in batch["id"]:
                values = _chain(problem, draws, burn, seed + int(chain)) / problem.scale
                yield pd.DataFrame(
                    {
                        "chain": int(chain),
                        "draw": np.repeat(np.arange(draws), len(problem.names)),
                        "term": np.tile(problem.names, draws),
                        "value": values.ravel(),
                    }
                )

    tasks = spark.range(0, chains, 1, chains)
    return tasks.mapInPandas(run, "chain int, draw int, term string, value double")


def posterior_summary(draws: DataFrame) -> DataFrame:
    """Median, 95 % interval and share of non-zero draws per term."""
    low, mid, high = (F.percentile("value", F.lit(q)) for q in (0.025, 0.5, 0.975))
    return draws.groupBy("term").agg(
        mid.alias("median"),
        low.alias("low"),
        high.alias("high"),
        F.avg((F.col("value") != 0).cast("int")).alias("share_nonzero"),
    )


def lasso_baseline(
    df: DataFrame, outcome: str, treatments: Sequence[str], covariates: Sequence[str], penalty: float
) -> DataFrame:
    """Point estimates by Spark ML's lasso over the same terms, as a check on the sampler."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    design = sparse_design(treatments, covariates)
    rows = complete_rows(df, [outcome, *treatments, *covariates])
    frame = design_frame(rows, design, [F.col(outcome).cast("double").alias("label")])
    x = [f"x{i}" for i in range(len(design.terms))]
    vectors = VectorAssembler(inputCols=x, outputCol="features").transform(frame).select("label", "features")
    fit = LinearRegression(elasticNetParam=1.0, regParam=penalty).fit(vectors)
    return df.sparkSession.createDataFrame(
        [(t, float(b)) for t, b in zip(design.names, fit.coefficients)], "term string, estimate double"
    )
