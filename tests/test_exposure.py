from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from trialloom.operators.exposure import ExposureSpec, assigned, exposure_flags, first_exposures, itt_sample
from trialloom.operators.samples import SampleRegistry, planned_samples

DAY = 86400
SCHEMA = (
    "id int, row int, survey_timestamp bigint, first_activity_timestamp bigint, course_start_timestamp bigint, "
    "course_selfpaced boolean"
)
SPEC = ExposureSpec(tie_break=("row",))
T = 1470009600


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def flags(spark, rows):
    return {r["row"]: r for r in exposure_flags(frame(spark, rows), SPEC).collect()}


def test_gap_of_29_and_30_days(spark):
    rows = []
    for i, gap in ((1, 29), (2, 30)):
        rows += [(i, 10 * i, T, T, T, False), (i, 10 * i + 1, T + gap * DAY, T, T, False)]
    out = flags(spark, rows)
    assert [out[r]["clean_exposure"] for r in (10, 11, 20, 21)] == [False, False, True, False]
    assert [out[r]["days_to_next_exposure"] for r in (20, 21)] == [30.0, 30.0]
    assert [out[r]["num_exposures"] for r in (10, 11)] == [2, 2]


def test_third_exposure_does_not_matter(spark):
    rows = [(1, 1, T, T, T, False), (1, 2, T + 40 * DAY, T, T, False), (1, 3, T + 41 * DAY, T, T, False)]
    assert [flags(spark, rows)[r]["clean_exposure"] for r in (1, 2, 3)] == [True, False, False]


def test_ties_and_nulls(spark):
    rows = [
        (1, 2, T, T, T, False), (1, 1, T, T, T, False),
        (2, 3, None, T, T, False), (2, 4, T, T, T, False),
        (None, 5, T, T, T, False), (None, 6, T + 50 * DAY, T, T, False),
        (3, 7, None, T, T, False),
    ]
    out = flags(spark, rows)
    assert (out[1]["first_exposure"], out[2]["first_exposure"]) == (True, False)
    # a missing time sorts last, and the gap to it is unknown
    assert (out[4]["first_exposure"], out[4]["days_to_next_exposure"], out[4]["clean_exposure"]) == (True, None, None)
    assert (out[5]["num_exposures"], out[5]["clean_exposure"], out[6]["clean_exposure"]) == (2, True, False)
    assert out[7]["clean_exposure"] is True and out[7]["itt_sample"] is None


@pytest.mark.parametrize(
    ("selfpaced", "delay_minutes", "days_since_start", "days_before_analysis", "kept"),
    [
        (False, 59, 14, 100, True),
        (False, 60, 14, 100, False),
        (False, 10, 15, 100, False),
        (False, -500, -40, 1, True),
        (True, 10, 100, 30, True),
        (True, 10, 1, 29, False),
        (None, 10, 20, 20, False),
    ],
)
def test_itt_thresholds(spark, selfpaced, delay_minutes, days_since_start, days_before_analysis, kept):
    first = int(SPEC.analysis_at) - days_before_analysis * DAY
    row = (1, 1, first + delay_minutes * 60, first, first - days_since_start * DAY, selfpaced)
    assert (itt_sample(frame(spark, [row]), SPEC).count() == 1) is kept
    assert bool(exposure_flags(frame(spark, [row]), SPEC).first()["itt_sample"]) is kept


def test_hot_id_shuffles_two_rows_per_task(spark):
    rows = spark.range(0, 20_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("int").alias("id"),
        F.col("id").cast("int").alias("row"),
        (F.lit(T) + F.col("id")).alias("survey_timestamp"),
        F.lit(T).cast("bigint").alias("first_activity_timestamp"),
        F.lit(T).cast("bigint").alias("course_start_timestamp"),
        F.lit(False).alias("course_selfpaced"),
    )
    firsts = first_exposures(rows, SPEC)
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert firsts.count() == rows.select("id").distinct().count()
    assert firsts.filter("id = 0").first()["row"] == 0


def test_hot_id_is_split_in_the_join(spark):
    """With thresholds scaled down, adaptive execution has to split the partition of an id with half the rows."""
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("int").alias("id"),
        F.col("id").cast("int").alias("row"),
        (F.lit(T) + F.col("id")).alias("survey_timestamp"),
        F.lit(T).cast("bigint").alias("first_activity_timestamp"),
        F.lit(T).cast("bigint").alias("course_start_timestamp"),
        F.lit(False).alias("course_selfpaced"),
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        flagged = exposure_flags(rows, SPEC)
        assert sum(r["first_exposure"] for r in flagged.collect()) == 30_001
        assert "SortMergeJoin(skew=true)" in flagged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_assigned_drops_unknown_arms(spark):
    df = spark.createDataFrame(
        [(1, 0, 1), (1, None, 1), (0, 1, 1), (None, 1, 1), (1, 1, None)],
        "webservice_call_complete int, affirm int, plans int",
    )
    assert assigned(df).count() == 1


def test_sample_registry(spark):
    df = spark.createDataFrame([(1, True, None), (2, True, 1), (3, None, 1)], "i int, itt boolean, us int")
    masks = SampleRegistry({"baseline": F.col("itt")}).narrow("us", "baseline", F.col("us").isNotNull())
    rows = masks.flag(df).orderBy("i").collect()
    assert [(r["in_baseline"], r["in_us"]) for r in rows] == [(True, False), (True, True), (None, None)]
    assert [r["i"] for r in masks.take(df, "us").collect()] == [2]
    assert len(list(planned_samples())) == 9
