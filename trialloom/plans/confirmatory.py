"""The confirmatory analysis: samples, models, outcomes and the grid of fits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions.nulls import flag, member
from trialloom.functions.scalars import paste
from trialloom.operators.balance import balance_table
from trialloom.operators.describe import condition_descriptives
from trialloom.operators.exposure import ExposureSpec, assigned, exposure_flags
from trialloom.operators.features import group_flag
from trialloom.operators.models.design import Design, crossed, main
from trialloom.operators.models.linear import result_frame
from trialloom.operators.models.mixed import fit_linear, fit_logistic, number_levels
from trialloom.operators.samples import SampleRegistry, planned_samples
from trialloom.session import materialise

STRATA_COVARIATES = main("intent_assess", "hours", "crs_finish", "educ")
GROUPS = ("institution", "institution_course", "strata")
PLANS = ["plans_long", "plans_short"]
PARALLEL_FITS = 6

MODELS = {
    "baseline": Design.of(STRATA_COVARIATES),
    "main.interaction": Design.of(crossed("affirm", PLANS), STRATA_COVARIATES),
    "simple": Design.of(crossed("affirm", "highHDI"), main(*PLANS), STRATA_COVARIATES),
    "affirm.ses": Design.of(
        crossed("affirm", "educ_parents"), main("HDI", *PLANS), STRATA_COVARIATES, scaled=("educ_parents", "HDI")
    ),
    "affirm.minority": Design.of(crossed("affirm", "us_majority"), main(*PLANS), STRATA_COVARIATES),
    "affirm.csit": Design.of(
        crossed("affirm", "highHDI", "threat_country"), main(*PLANS), STRATA_COVARIATES, scaled=("threat_country",)
    ),
    "affirm.lang": Design.of(crossed("affirm", "highHDI", "is_fluent"), main(*PLANS), STRATA_COVARIATES),
    "affirm.sex": Design.of(
        crossed("affirm", "gender_female", "male_dom_course"), main("HDI", *PLANS), STRATA_COVARIATES, scaled=("HDI",)
    ),
    "plan.original": Design.of(main("plans_long", "plans_short", "affirm"), STRATA_COVARIATES),
    "plan.vs.plan": Design.of(main("plans_any", "plans_long", "affirm"), STRATA_COVARIATES),
}

# outcome -> suffix of the samples it is analysed on
OUTCOMES = {
    "cert_basic": "",
    "course_progress": "",
    "cert_verified": "_HarvardMIT",
    "upgrade_verified": "_upgrades",
    "likely_complete_1": "",
}
MODEL_SAMPLES = {
    "main.interaction": "baseline",
    "simple": "baseline",
    "affirm.ses": "baseline",
    "affirm.csit": "baseline",
    "affirm.lang": "baseline",
    "affirm.sex": "baseline",
    "affirm.minority": "US.respondent",
    "plan.original": "fluent_intent",
    "plan.vs.plan": "fluent_intent",
}


@dataclass(frozen=True)
class FitSpec:
    model: str
    outcome: str
    sample: str


def planned_fits(outcomes: Iterable[str] = OUTCOMES) -> list[FitSpec]:
    """Every planned model on every outcome, each on the sample the plan names for it."""
    return [FitSpec(m, y, base + OUTCOMES[y]) for y in outcomes for m, base in MODEL_SAMPLES.items()]


def prepare(df: DataFrame, spec: ExposureSpec = ExposureSpec()) -> DataFrame:
    """Exclusions, exposure flags, the course flag (over all rows) and the remaining indicators."""
    flagged = exposure_flags(assigned(df), spec)
    flagged = group_flag(flagged, "course", "gender_female", 0.2, "male_dom_course")
    return flagged.withColumns(
        {"plans_any": flag(F.col("plans") > 0), "institution_course": paste("institution", "course", sep=":")}
    )


def fit_grid(
    df: DataFrame,
    fits: Sequence[FitSpec],
    models: dict[str, Design] = MODELS,
    samples: SampleRegistry | None = None,
    groups: Sequence[str] = GROUPS,
) -> DataFrame:
    """One table of coefficients over all fits.

    The rows every sample lies in are stored once with only the columns any fit needs, and each fit reads
    its sample from there.
    """
    samples = samples or planned_samples()
    needed = {c for f in fits for c in (*models[f.model].columns, f.outcome)}
    flagged = samples.flag(df)
    masks = {f.sample for f in fits}
    some = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`in_{m}`"), F.lit(False)) for m in sorted(masks)])
    stored = materialise(
        flagged.filter(some).select(*sorted(needed | set(groups)), *[F.col(f"`in_{m}`") for m in sorted(masks)]),
        "sample",
    )
    # levels are numbered once for all fits
    stored, sizes = number_levels(stored, groups)
    stored = materialise(stored, "numbered-sample")
    binary = _binary_outcomes(stored, fits)
    enough = _enough_rows(stored, fits, models, groups)

    def one(spec: FitSpec) -> DataFrame:
        if not enough[spec]:
            return _without_fit(df.sparkSession, spec)
        rows = stored.filter(F.col(f"`in_{spec.sample}`"))
        if binary[spec]:
            fit = fit_logistic(rows, spec.outcome, models[spec.model], groups, numbered=sizes)
        else:
            fit = fit_linear(rows, spec.outcome, models[spec.model], groups)
        return fit.table(df.sparkSession, spec.model, spec.outcome, spec.sample)

    # the fits are independent small jobs on one stored table, so they are submitted together
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        tables = list(pool.map(one, fits))
    return reduce(lambda a, b: a.unionByName(b), tables)


def _binary_outcomes(stored: DataFrame, fits: Sequence[FitSpec]) -> dict[FitSpec, bool]:
    """For all fits in one pass: is every outcome of the fit's sample 0 or 1?"""
    shares = stored.agg(
        *[
            F.avg(F.when(F.col(f"`in_{f.sample}`"), member(f.outcome, (0, 1)).cast("int"))).alias(f"b{i}")
            for i, f in enumerate(fits)
        ]
    ).first()
    return {f: shares[f"b{i}"] == 1 for i, f in enumerate(fits)}


def _enough_rows(stored: DataFrame, fits: Sequence[FitSpec], models: dict[str, Design], groups: Sequence[str]) -> dict[FitSpec, bool]:
    """For all fits in one pass: has the sample more complete rows than the model has coefficients and spreads?"""

    def complete(f: FitSpec) -> Column:
        known = [F.col(c).isNotNull() for c in dict.fromkeys([f.outcome, *models[f.model].columns, *groups])]
        return F.count_if(reduce(lambda a, b: a & b, known, F.col(f"`in_{f.sample}`")))

    found = stored.agg(*[complete(f).alias(f"n{i}") for i, f in enumerate(fits)]).first()
    return {f: found[f"n{i}"] > len(models[f.model].terms) + len(groups) + 1 for i, f in enumerate(fits)}


def _without_fit(spark: SparkSession, spec: FitSpec) -> DataFrame:
    """The row that stands for a fit whose sample is too small."""
    return result_frame(spark, [(spec.model, spec.outcome, spec.sample, "none", "(too few complete rows)", *[float("nan")] * 4)])


def descriptives(df: DataFrame) -> DataFrame:
    """Twelve statistics per condition on the baseline sample."""
    return condition_descriptives(df.filter(F.col("itt_sample")))


def balance(df: DataFrame) -> DataFrame:
    """Shares per stratum with tests against the design shares."""
    strata = ["strata_intent_assess", "strata_educ", "strata_hours", "strata_crs_finish"]
    arms = {"affirm": 0.5, "plans_long": 1 / 3, "plans_short": 1 / 3}
    return balance_table(df.filter(F.col("itt_sample")), strata, arms)
