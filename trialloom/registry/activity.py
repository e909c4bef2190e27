"""Percentile ranks, funnel, percentile profiles and country shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions.scalars import course_of_run
from trialloom.operators.describe import country_share
from trialloom.operators.funnel import clean_flag, participant_type, percentile_long, percentile_profile
from trialloom.operators.ranks import with_ntile
from trialloom.plans.report import RANKED
from trialloom.registry.inputs import ACTIONS_SQL, actions, read

ROWS_PER_CELL = 2_000


def classified(spark, sf_dir):
    rows = actions(spark, sf_dir).filter(F.col("roles") == "Student")
    rows = rows.withColumns(
        {"blended": clean_flag("blended").cast("int"), "course_id": course_of_run("enrollment_course_id")}
    )
    return rows.withColumn("group_cat", participant_type())


def q_ntile_global(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    out = with_ntile(orders, "o_totalprice", 100, ["o_orderkey"], rows_per_cell=ROWS_PER_CELL)
    return out.select("o_orderkey", "tile")


def q_ntile_ties(spark, sf_dir):
    """A third of the rows share the value 0 and some have none; ties follow the hash of the key."""
    rows = actions(spark, sf_dir).select(
        "row_id", F.when(F.col("grade") > 0.05, F.col("nforum_posts")).alias("posts")
    )
    out = with_ntile(rows, "posts", 100, ["row_id"], rows_per_cell=ROWS_PER_CELL)
    return out.select("row_id", "tile")


def q_ntile_legacy(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    out = with_ntile(orders, "o_totalprice", 7, ["o_orderkey"], legacy=True, rows_per_cell=ROWS_PER_CELL)
    return out.select("o_orderkey", "tile")


def q_ntile_group(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = with_ntile(events, "value", 100, ["event_id"], ["event_type"], rows_per_cell=500)
    return out.select("event_id", "tile")


def q_ntile_small_groups(spark, sf_dir):
    """More tiles than rows in most groups."""
    lines = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = with_ntile(lines, "o_totalprice", 8, ["o_orderkey"], ["o_custkey"], rows_per_cell=ROWS_PER_CELL)
    return out.select("o_orderkey", "tile")


def q_participant_type(spark, sf_dir):
    return classified(spark, sf_dir).select("row_id", "course_id", "blended", "group_cat")


def _profile(spark, sf_dir, within):
    long = percentile_long(
        classified(spark, sf_dir), RANKED, ["row_id"], ["group_cat"], within, rows_per_cell=ROWS_PER_CELL
    )
    out = percentile_profile(long, by=within)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "median", "se", "hi_int", "low_int")})


def q_percentile_profile(spark, sf_dir):
    return _profile(spark, sf_dir, [])


def q_percentile_profile_course(spark, sf_dir):
    return _profile(spark, sf_dir, ["course_id"])


def q_funnel_share(spark, sf_dir):
    return country_share(classified(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


def q_funnel_counts(spark, sf_dir):
    rows = classified(spark, sf_dir)
    return rows.groupBy("course_id", "group_cat").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "ntile_global": q_ntile_global,
    "ntile_ties": q_ntile_ties,
    "ntile_legacy": q_ntile_legacy,
    "ntile_group": q_ntile_group,
    "ntile_small_groups": q_ntile_small_groups,
    "participant_type": q_participant_type,
    "percentile_profile": q_percentile_profile,
    "percentile_profile_course": q_percentile_profile_course,
    "funnel_share": q_funnel_share,
    "funnel_counts": q_funnel_counts,
}

CLASSIFIED = f"""
raw AS (SELECT * FROM ({ACTIONS_SQL}) WHERE roles = 'Student'),
clean AS (SELECT * REPLACE (CAST(coalesce(blended = 1, false) AS INT) AS blended),
                 split_part(split_part(enrollment_course_id, '/', 2), '_', 1) AS course_id FROM raw),
act AS (SELECT *, CASE
          WHEN viewed = 1 AND explored = 0 AND completed = 0 AND certified = 0 AND blended = 0 THEN 'viewed'
          WHEN viewed = 1 AND explored = 1 AND completed = 0 AND certified = 0 AND blended = 0 THEN 'explored'
          WHEN viewed = 1 AND explored = 1 AND completed = 1 AND certified = 0 AND blended = 0 THEN 'completed'
          WHEN viewed = 1 AND explored = 1 AND completed = 1 AND certified = 1 AND blended = 0 THEN 'certified'
          WHEN viewed = 1 AND explored = 1 AND completed = 1 AND certified = 1 AND blended = 1 THEN 'blended'
        END AS group_cat FROM clean)
"""

_LABELS = {
    "percentile_nevents": "Number of Events",
    "percentile_nvideo": "Number of Video Actions",
    "percentile_ndays_act": "Number of Days Participated in Course",
    "percentile_forums": "Number of Forum Posts",
    "percentile_grade": "Course Grade",
}


def _profile_sql(within: str) -> str:
    part = f"PARTITION BY {within}" if within else ""
    pick = f"{within}, " if within else ""
    tiles = " UNION ALL ".join(
        f"""
SELECT group_cat, {pick}'{name}' AS variable,
       CAST(ntile(100) OVER ({part} ORDER BY {c}, md5(CAST(row_id AS VARCHAR))) AS INT) AS tile
FROM act WHERE {c} IS NOT NULL
UNION ALL SELECT group_cat, {pick}'{name}', NULL FROM act WHERE {c} IS NULL"""
        for c, name in RANKED.items()
    )
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items())
    return f"""
WITH {CLASSIFIED}, tiles AS ({tiles})
SELECT {pick}variable, group_cat, round(avg(tile), 6) AS mean, round(stddev_samp(tile), 6) AS sd, count(*) AS n,
       round(median(tile), 6) AS median, round(stddev_samp(tile) / sqrt(count(*)), 6) AS se,
       round(avg(tile) + 2.58::DOUBLE * (stddev_samp(tile) / sqrt(count(*))), 6) AS hi_int,
       round(avg(tile) - 2.58::DOUBLE * (stddev_samp(tile) / sqrt(count(*))), 6) AS low_int,
       CASE variable {labels} END AS variable_label
FROM tiles WHERE group_cat IS NOT NULL GROUP BY {pick}variable, group_cat"""


_RANK = "SELECT {key}, CAST(ntile({k}) OVER ({part} ORDER BY {v}, md5(CAST({key} AS VARCHAR))) AS INT) AS tile FROM {t}"

ORACLE = {
    "ntile_global": _RANK.format(key="o_orderkey", k=100, part="", v="o_totalprice", t="orders"),
    "ntile_ties": f"""
WITH p AS (SELECT row_id, CASE WHEN grade > 0.05 THEN nforum_posts END AS posts FROM ({ACTIONS_SQL}))
SELECT row_id, CAST(ntile(100) OVER (ORDER BY posts, md5(CAST(row_id AS VARCHAR))) AS INT) AS tile
FROM p WHERE posts IS NOT NULL UNION ALL SELECT row_id, NULL FROM p WHERE posts IS NULL""",
    "ntile_legacy": """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, md5(CAST(o_orderkey AS VARCHAR))) AS r,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(7 * (r - 1) // n + 1 AS INT) AS tile FROM r""",
    "ntile_group": _RANK.format(key="event_id", k=100, part="PARTITION BY event_type", v="value", t="events"),
    "ntile_small_groups": _RANK.format(
        key="o_orderkey", k=8, part="PARTITION BY o_custkey", v="o_totalprice", t="orders"
    ),
    "participant_type": f"WITH {CLASSIFIED} SELECT row_id, course_id, blended, group_cat FROM act",
    "percentile_profile": _profile_sql(""),
    "percentile_profile_course": _profile_sql("course_id"),
    "funnel_share": f"""
WITH {CLASSIFIED}
SELECT group_cat, round(avg(CAST(cc_by_ip IN ('US', 'CN') AS INT)), 6) AS pct
FROM act WHERE group_cat IS NOT NULL GROUP BY 1""",
    "funnel_counts": f"WITH {CLASSIFIED} SELECT course_id, group_cat, count(*) AS n FROM act GROUP BY 1, 2",
}
