"""One response table from institutions that name their questions differently."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.nulls import lookup

# fixed values: export tags that differ between the institutions' surveys, to the names the analysis uses. One survey
# asks for the country of birth twice; only the question with the common country codes becomes ``pob``
TAG_RENAMES = {
    "Stanford": {},
    "MIT": {"gender_pcs": "sex", "yob_pcs": "yob", "educ_pcs": "educ", "country": "pob", "oc_comp": "crs_finish"},
    "Harvard": {
        "pob": "pob_own_codes", "country": "pob", "gender_pcs": "sex", "yob_pcs": "yob", "educ_pcs": "educ",
        "oc_comp": "crs_finish",
    },
}


def harmonise(
    sources: Mapping[str, DataFrame],
    renames: Mapping[str, Mapping[str, str]] = TAG_RENAMES,
    label: str = "institution",
    recodes: Mapping[str, Mapping[str, Mapping]] | None = None,
) -> DataFrame:
    """Rename each source's columns, align its codes, tag its rows and union by name; absent columns are NULL.

    A column that gets a name its source already uses frees the name first, so renames are given in that order.
    ``recodes`` maps source and (new) column name to old and new codes; a code that is not listed is NULL, as it would
    mean something else in the other sources.
    """
    parts = []
    for name, df in sources.items():
        df = df.withColumnsRenamed(dict(renames.get(name, {})))
        for column, codes in (recodes or {}).get(name, {}).items():
            df = df.withColumn(column, lookup(column, codes))
        parts.append(df.withColumn(label, F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
