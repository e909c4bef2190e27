"""Exposure, samples, progress, sign-ups, joins and group flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions.nulls import member
from trialloom.functions.scalars import epoch_micros
from trialloom.operators.describe import condition_descriptives
from trialloom.operators.exposure import ExposureSpec, assigned, exposure_flags, itt_sample
from trialloom.operators.features import group_flag
from trialloom.operators.joins import attribute_join, natural_left_join
from trialloom.operators.progress import course_progress, later_signups
from trialloom.operators.samples import SampleRegistry
from trialloom.registry.inputs import LEARNERS_SQL, learners, read

EVENT_SPEC = ExposureSpec(
    id="user_id",
    exposed_at="exposed_at",
    first_activity="first_activity_at",
    course_start="course_start_at",
    self_paced="self_paced",
    tie_break=("event_id",),
    analysis_at=1706745600,
    clean_gap_days=0.25,
    max_delay_hours=1,
    min_days_to_analysis=15,
    max_days_from_start=5,
)
LEARNER_SPEC = ExposureSpec(tie_break=("row_id",), clean_gap_days=3)

_EXPOSURES = """
exposures AS (
  SELECT event_id, user_id, event_type, value,
         epoch_us(ts) / 1e6 AS exposed_at,
         epoch_us(ts) / 1e6 - value * 60 AS first_activity_at,
         epoch_us(date_trunc('week', ts)::TIMESTAMP) / 1e6 AS course_start_at,
         CASE WHEN event_type <> 'purchase' THEN event_type IN ('view', 'click') END AS self_paced
  FROM events WHERE event_type <> 'error'),
flagged AS (
  SELECT *, row_number() OVER w = 1 AS first_exposure,
         count(*) OVER (PARTITION BY user_id) AS num_exposures,
         CASE WHEN count(*) OVER (PARTITION BY user_id) > 1
              THEN (nth_value(exposed_at, 2) OVER full_w - first_value(exposed_at) OVER full_w) / 86400
              ELSE 0 END AS days_to_next_exposure,
         (exposed_at - first_activity_at) / 3600 AS survey_delay,
         (first_activity_at - course_start_at) / 86400 AS days_from_start,
         (1706745600 - first_activity_at) / 86400 AS days_to_analysis
  FROM exposures
  WINDOW w AS (PARTITION BY user_id ORDER BY exposed_at, event_id),
         full_w AS (PARTITION BY user_id ORDER BY exposed_at, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cleaned AS (
  SELECT *, first_exposure AND (num_exposures = 1 OR days_to_next_exposure > 0.25) AS clean_exposure FROM flagged),
itt AS (
  SELECT *, clean_exposure AND survey_delay < 1 AND ((self_paced AND days_to_analysis > 15)
            OR (NOT self_paced AND days_from_start < 5)) AS itt_sample FROM cleaned)
"""


def event_exposures(spark, sf_dir):
    """All event rows in the shape the exposure operators read; an error is a failed assignment call, which is excluded."""
    events = read(spark, sf_dir, "events")
    exposed = epoch_micros("ts") / F.lit(1e6)
    shaped = events.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        exposed.alias("exposed_at"),
        (exposed - F.col("value") * 60).alias("first_activity_at"),
        (F.unix_micros(F.date_trunc("week", F.col("ts").cast("timestamp"))) / F.lit(1e6)).alias("course_start_at"),
        F.when(F.col("event_type") != "purchase", F.col("event_type").isin("view", "click")).alias("self_paced"),
        (F.col("event_type") != "error").cast("int").alias("call_complete"),
    )
    return assigned(shaped, "call_complete", ())


def q_exposure_flags(spark, sf_dir):
    flagged = exposure_flags(event_exposures(spark, sf_dir), EVENT_SPEC)
    return flagged.select(
        "event_id",
        "first_exposure",
        "num_exposures",
        F.round("days_to_next_exposure", 6).alias("days_to_next_exposure"),
        "clean_exposure",
        F.round("survey_delay", 6).alias("survey_delay"),
        F.round("days_from_start", 6).alias("days_from_start"),
        F.round("days_to_analysis", 6).alias("days_to_analysis"),
        "itt_sample",
    )


def q_exposure_itt(spark, sf_dir):
    """Sample rows described by event type: the flagship query."""
    sample = itt_sample(event_exposures(spark, sf_dir), EVENT_SPEC)
    return sample.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 6).alias("mean_value"),
        F.round(F.stddev_samp("value"), 6).alias("sd_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.round(F.avg("days_to_next_exposure"), 6).alias("mean_gap_days"),
    )


def q_sample_registry(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("known", F.when(F.col("value") >= 5, F.col("value")))
    masks = SampleRegistry({"baseline": F.col("value") < 120})
    masks.narrow("respondent", "baseline", F.col("known").isNotNull())
    masks.narrow("high", "baseline", F.col("known") > 60)
    masks.narrow("shop", "baseline", member(F.nullif("event_type", F.lit("error")), ["purchase", "view"]))
    masks.narrow("high_shop", "high", masks["shop"])
    return masks.flag(events).select("event_id", *[f"in_{m}" for m in masks])


def q_sample_rows(spark, sf_dir):
    masks = SampleRegistry({"baseline": F.col("l_quantity") > 10})
    masks.narrow("returned", "baseline", F.nullif("l_returnflag", F.lit("N")) == "R")
    rows = masks.take(read(spark, sf_dir, "lineitem"), "returned")
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("max_quantity"))


def q_progress(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    # the catalogue lists every part for one flag, also those that were never returned
    catalogue = read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("total")).select(F.lit("R").alias("l_returnflag"), "total")
    out = course_progress(items, "l_suppkey", "l_returnflag", "l_partkey", catalogue)
    return out.withColumn("progress", F.round("progress", 6))


def q_later_signups(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    firsts = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"))
    out = later_signups(firsts, orders, "o_custkey", "first_at", "o_orderdate")
    return out.select("o_custkey", "later_signups")


def q_natural_left_join(spark, sf_dir):
    """Keys are nulled on both sides for one nation, so NULL has to meet NULL."""
    left = read(spark, sf_dir, "supplier").select(
        "s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("nationkey")
    )
    right = read(spark, sf_dir, "nation").select(
        F.nullif("n_nationkey", F.lit(3)).alias("nationkey"), "n_name"
    )
    return natural_left_join(left, right)


def q_attribute_join(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = attribute_join(lines, suppliers, "l_suppkey")
    return joined.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def q_group_flag(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").withColumn(
        "rich", F.when(F.col("s_acctbal") != F.lit(0), (F.col("s_acctbal") > 5000).cast("int"))
    )
    return group_flag(suppliers, "s_nationkey", "rich", 0.5, "poor_nation").select(
        "s_suppkey", "s_nationkey", "poor_nation"
    )


def q_course_flag(spark, sf_dir):
    rows = learners(spark, sf_dir).withColumn("gender_female", (F.col("sex") == 2).cast("int"))
    out = group_flag(rows, "course", "gender_female", 0.33, "male_dom_course")
    return out.groupBy("course", "male_dom_course").agg(F.count(F.lit(1)).alias("n"))


def _described(df):
    return df.withColumns(
        {
            "cert_basic": F.when(F.col("hours") > 0, (F.col("noise") > 0).cast("int")),
            "course_progress": F.col("totalprice") / 5000,
            "is_fluent": (F.col("fluent") == 5).cast("int"),
            "highHDI": (F.col("HDI") > 0.7).cast("int"),
        }
    )


def q_condition_descriptives(spark, sf_dir):
    sample = _described(itt_sample(assigned(learners(spark, sf_dir)), LEARNER_SPEC))
    out = condition_descriptives(sample)
    rounded = [c for c in out.columns if c not in ("affirm", "plans", "N", "N_harvardMIT")]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


LEARNER_ITT = f"""
raw AS ({LEARNERS_SQL}),
kept AS (SELECT * FROM raw
         WHERE webservice_call_complete = 1 AND affirm IS NOT NULL AND plans IS NOT NULL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY survey_timestamp, row_id) AS nth,
                   count(*) OVER (PARTITION BY id) AS num,
                   lead(survey_timestamp) OVER (PARTITION BY id ORDER BY survey_timestamp, row_id) AS next_at
            FROM kept),
itt AS (SELECT * FROM ordered WHERE nth = 1
        AND (num = 1 OR (next_at - survey_timestamp) / 86400.0 > 3)
        AND (survey_timestamp - first_activity_timestamp) / 3600.0 < 1
        AND ((course_selfpaced AND (1487145600 - first_activity_timestamp) / 86400.0 > 29)
             OR (NOT course_selfpaced AND (first_activity_timestamp - course_start_timestamp) / 86400.0 < 15)))
"""


QUERIES = {
    "exposure_itt": q_exposure_itt,
    "exposure_flags": q_exposure_flags,
    "sample_registry": q_sample_registry,
    "sample_rows": q_sample_rows,
    "progress": q_progress,
    "later_signups": q_later_signups,
    "natural_left_join": q_natural_left_join,
    "attribute_join": q_attribute_join,
    "group_flag": q_group_flag,
    "course_flag": q_course_flag,
    "condition_descriptives": q_condition_descriptives,
}

ORACLE = {
    "exposure_itt": f"""
WITH {_EXPOSURES}
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value,
       min(value) AS min_value, max(value) AS max_value, round(avg(days_to_next_exposure), 6) AS mean_gap_days
FROM itt WHERE itt_sample GROUP BY event_type""",
    "exposure_flags": f"""
WITH {_EXPOSURES}
SELECT event_id, first_exposure, num_exposures, round(days_to_next_exposure, 6) AS days_to_next_exposure,
       clean_exposure, round(survey_delay, 6) AS survey_delay, round(days_from_start, 6) AS days_from_start,
       round(days_to_analysis, 6) AS days_to_analysis, itt_sample
FROM itt""",
    "sample_registry": """
WITH e AS (SELECT *, CASE WHEN value >= 5 THEN value END AS known, value < 120 AS base FROM events)
SELECT event_id, base AS in_baseline, base AND known IS NOT NULL AS in_respondent, base AND known > 60 AS in_high,
       base AND coalesce(nullif(event_type, 'error') IN ('purchase', 'view'), false) AS in_shop,
       (base AND known > 60) AND (base AND coalesce(nullif(event_type, 'error') IN ('purchase', 'view'), false))
         AS in_high_shop
FROM e""",
    "sample_rows": """
SELECT l_suppkey, count(*) AS n, max(l_quantity) AS max_quantity FROM lineitem
WHERE l_quantity > 10 AND l_returnflag = 'R' GROUP BY l_suppkey""",
    "progress": """
WITH t AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN (SELECT count(*) FROM part) ELSE count(DISTINCT l_partkey) END AS items
           FROM lineitem GROUP BY 1),
m AS (SELECT l_suppkey, l_returnflag, count(DISTINCT l_partkey) AS used FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, m.l_returnflag, used, items, round(used * 100.0::DOUBLE / items, 6) AS progress
FROM m JOIN t ON m.l_returnflag = t.l_returnflag""",
    "later_signups": """
WITH f AS (SELECT o_custkey, min(o_orderdate) AS first_at FROM orders GROUP BY 1)
SELECT f.o_custkey, count(o.o_orderkey) AS later_signups
FROM f LEFT JOIN orders o ON o.o_custkey = f.o_custkey AND o.o_orderdate > f.first_at GROUP BY 1""",
    "natural_left_join": """
SELECT s.s_suppkey, nullif(s.s_nationkey, 3) AS nationkey, n.n_name
FROM supplier s LEFT JOIN nation n ON nullif(s.s_nationkey, 3) IS NOT DISTINCT FROM nullif(n.n_nationkey, 3)""",
    "attribute_join": """
SELECT s_nationkey, count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
    "group_flag": """
WITH r AS (SELECT *, CASE WHEN s_acctbal <> 0 THEN CAST(s_acctbal > 5000 AS INT) END AS rich FROM supplier)
SELECT s_suppkey, s_nationkey,
       CASE WHEN count(rich) OVER w = count(*) OVER w THEN avg(rich) OVER w END < 0.5 AS poor_nation
FROM r WINDOW w AS (PARTITION BY s_nationkey)""",
    "course_flag": f"""
WITH r AS ({LEARNERS_SQL}),
f AS (SELECT course, avg(CAST(sex = 2 AS INT)) OVER (PARTITION BY course) < 0.33 AS male_dom_course FROM r)
SELECT course, male_dom_course, count(*) AS n FROM f GROUP BY 1, 2""",
    "condition_descriptives": f"""
WITH {LEARNER_ITT},
d AS (SELECT *, CASE WHEN hours > 0 THEN CAST(noise > 0 AS INT) END AS cert_basic,
             totalprice / 5000 AS course_progress, CAST(fluent = 5 AS INT) AS is_fluent,
             CAST(HDI > 0.7 AS INT) AS highHDI FROM itt)
SELECT affirm, plans, count(*) AS N, count(*) FILTER (institution IN ('Harvard', 'MIT')) AS "N_harvardMIT",
       CASE WHEN count(cert_basic) = count(*) THEN round(avg(cert_basic), 6) END AS cert_basic,
       round(avg(cert_verified), 6) AS cert_verified, round(avg(enroll_verified), 6) AS enroll_verified,
       round(avg(upgrade_verified), 6) AS upgrade_verified, round(avg(course_progress), 6) AS avg_course_progress,
       round(avg(2017 - yob), 6) AS avg_age, round(avg(CAST(sex = 2 AS INT)), 6) AS prop_women,
       round(avg(is_fluent), 6) AS prop_fluent, round(avg(CAST(intent_assess = 4 AS INT)), 6) AS prop_intent_assess_all,
       round(avg(highHDI), 6) AS "prop_highHDI"
FROM d GROUP BY affirm, plans""",
}
