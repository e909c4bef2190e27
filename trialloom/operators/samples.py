"""Named analysis samples as boolean columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.nulls import member


class SampleRegistry:
    """Named masks; a later mask may build on an earlier one by name."""

    def __init__(self, masks: Mapping[str, Column] | None = None):
        self._masks: dict[str, Column] = dict(masks or {})

    def __getitem__(self, name: str) -> Column:
        return self._masks[name]

    def __iter__(self):
        return iter(self._masks)

    def define(self, name: str, mask: Column) -> SampleRegistry:
        self._masks[name] = mask
        return self

    def narrow(self, name: str, base: str, extra: Column) -> SampleRegistry:
        """A mask that is an earlier mask and one more condition."""
        return self.define(name, self._masks[base] & extra)

    def flag(self, df: DataFrame, prefix: str = "in_") -> DataFrame:
        """Add one boolean column per mask, all in one projection."""
        return df.withColumns({f"{prefix}{name}": mask for name, mask in self._masks.items()})

    def take(self, df: DataFrame, name: str) -> DataFrame:
        """Rows of one sample; a NULL mask drops the row."""
        return df.filter(self._masks[name])


def planned_samples() -> SampleRegistry:
    """The samples of the confirmatory analysis."""
    samples = SampleRegistry({"baseline": F.col("itt_sample")})
    samples.narrow("US.respondent", "baseline", F.col("us_majority").isNotNull())
    samples.narrow("fluent_intent", "baseline", (F.col("is_fluent") == 1) & (F.col("intent_assess") == 4))
    samples.narrow("baseline_HarvardMIT", "baseline", member("institution", ["Harvard", "MIT"]))
    for base in ("US.respondent", "fluent_intent"):
        samples.narrow(f"{base}_HarvardMIT", base, samples["baseline_HarvardMIT"])
    samples.narrow("baseline_upgrades", "baseline_HarvardMIT", F.col("enroll_verified") == 0)
    for base in ("US.respondent", "fluent_intent"):
        samples.narrow(f"{base}_upgrades", base, samples["baseline_upgrades"])
    return samples
