"""The descriptive report on a survey and on course activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.scalars import course_of_run
from trialloom.operators.crosstab import crosstab_pct, frequency
from trialloom.operators.describe import activity_profile, country_share, numeric_answers
from trialloom.operators.funnel import PERCENTILES, clean_flag, participant_type, percentile_long, percentile_profile
from trialloom.operators.joins import natural_left_join
from trialloom.operators.likert import (
    FAMILIARITY, FREQUENCY, IMPORTANCE, INDICATORS, REASONS, diverging_shares, high_intent,
)
from trialloom.operators.models.linear import ols_factor, with_p_values

ACTIONS = [
    "nevents", "ndays_act", "nplay_video", "npause_video", "nvideos_total_watched", "nchapters", "nforum_posts", "grade",
]
RANKED = {
    "ndays_act": "percentile_ndays_act",
    "nvideo": "percentile_nvideo",
    "nevents": "percentile_nevents",
    "nforum_posts": "percentile_forums",
    "grade": "percentile_grade",
}
GROUPS = {1: "blended", 2: "comparison"}


def prepare(survey: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exclusions, the survey answer joined to the activity rows, and the cleaned flags and ids."""
    survey = survey.filter(F.col("group_name") != "Residential")
    keys = ["id_map_hash_id", "enrollment_course_id"]
    joined = natural_left_join(actions.filter(F.col("roles") == "Student"), survey.select(*keys, "likely_complete_1"))
    course = course_of_run("enrollment_course_id")
    actions = joined.withColumns({"blended": clean_flag("blended").cast("int"), "course_id": course})
    return survey.withColumn("course_id", course), actions.withColumn("group_cat", participant_type())


def survey_tables(survey: DataFrame) -> dict[str, DataFrame]:
    labelled = survey.withColumn("group_label", F.when(F.col("group") == 1, "blended").when(F.col("group") == 2, "comparison"))
    levels = list(GROUPS.values())
    return {
        "courses": frequency(survey, "course_id"),
        "reasons": diverging_shares(survey, list(REASONS), "group", IMPORTANCE, GROUPS),
        "intentions": high_intent(survey, list(INDICATORS), "group"),
        "hours": numeric_answers(survey, "hours", ["group"]),
        "courses_completed": numeric_answers(survey, "oc_comp", ["group"]),
        "goal_setting": crosstab_pct(labelled, "goal_setting", FREQUENCY, "group_label", levels),
        "familiarity": diverging_shares(survey, ["fam"], "group", FAMILIARITY, GROUPS),
    }


def activity_tables(actions: DataFrame, unique_key: tuple[str, ...] = ("id_map_hash_id", "enrollment_course_id")):
    """Profiles, percentile profiles overall and by course, regressions and country shares."""
    populations = {p: F.col(p) == 1 for p in ("completed", "certified", "viewed", "explored")}
    group = F.when(F.col("blended") == 1, "Blended students").otherwise("Other students")
    overall = percentile_long(actions, RANKED, unique_key, ["group_cat"])
    within = percentile_long(actions, RANKED, unique_key, ["group_cat"], within=["course_id"])
    return {
        "profile": activity_profile(actions, ACTIONS, populations, group, "blended_binary"),
        "percentiles": percentile_profile(overall, labels=PERCENTILES),
        "percentiles_by_course": percentile_profile(within, by=["course_id"], labels=PERCENTILES),
        "country": country_share(actions),
        **{
            f"regression_{y}": with_p_values(ols_factor(actions, y, "group_cat"))
            for y in ("log_nevents", "log_nvideo", "log_ndays_act")
        },
    }
