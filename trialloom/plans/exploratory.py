"""The exploratory analysis: which learners respond differently to which treatment."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trialloom.operators.exposure import ExposureSpec, assigned, itt_sample
from trialloom.operators.features import HDI_LABELS, background_features
from trialloom.operators.models.design import numeric_code
from trialloom.operators.models.sparse import COVARIATES, TREATMENTS, posterior_draws, posterior_summary


def heterogeneous_effects(df: DataFrame, outcome: str = "cert_basic", spec: ExposureSpec = ExposureSpec(), **options):
    """Posterior summary per effect on the baseline sample; extra options go to the sampler."""
    sample = background_features(itt_sample(assigned(df), spec))
    coded = numeric_code(sample, [*COVARIATES, *TREATMENTS], {"HDI4": HDI_LABELS})
    return posterior_summary(posterior_draws(coded, outcome, **options))
