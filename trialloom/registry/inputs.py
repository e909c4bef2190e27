"""The analysis tables, derived row by row from the given tables.

The given tables hold no survey or course log, so each stand-in is a projection whose expressions are plain SQL
that both engines read alike. ``draw`` spreads a row key over a range by multiplication modulo a prime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialloom.session import spread

PRIME = 1000003


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw(key: str, lane: int, size: int, low: int = 0) -> str:
    """SQL for an int in ``low .. low+size-1``; lanes are unrelated to each other."""
    factor = (lane * 7919 + 104729) % PRIME
    return f"CAST((({key} + {lane * 1009 + 17}) % {PRIME} * {factor} % {PRIME}) % {size} + {low} AS INT)"


def pick(key: str, lane: int, values: list[str | None]) -> str:
    branches = [f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None]
    return f"CASE {draw(key, lane, len(values))} {' '.join(branches)} END"


_K = "o_orderkey"

LEARNERS = {
    "row_id": _K,
    "id": "o_custkey",
    "institution": pick(_K, 1, ["Stanford", "Harvard", "MIT"]),
    "course": draw(_K, 2, 35, 1),
    "course_selfpaced": f"{draw(_K, 2, 35, 1)} <= 5",
    "webservice_call_complete": f"CASE WHEN {draw(_K, 3, 100)} = 0 THEN 0 ELSE 1 END",
    "intent_lecture": draw(_K, 4, 4, 1),
    "intent_assess": draw(_K, 5, 4, 1),
    "hours": draw(_K, 6, 13),
    "crs_finish": draw(_K, 7, 6),
    "goal_setting": draw(_K, 8, 5, 1),
    "fam": draw(_K, 9, 5, 1),
    "sex": draw(_K, 10, 3, 1),
    "yob": draw(_K, 11, 51, 1950),
    "empstatus": draw(_K, 12, 5, 1),
    "teach": draw(_K, 13, 2),
    "school": draw(_K, 14, 2),
    "educ": draw(_K, 15, 10, 1),
    "educ_parents": draw(_K, 16, 10, 1),
    "fluent": draw(_K, 17, 5, 1),
    "pob": draw(_K, 18, 5, 184),
    "threat_country": draw(_K, 19, 5, 1),
    "us_ethnicity": f"CASE WHEN {draw(_K, 20, 10)} > 0 THEN {draw(_K, 21, 3, 1)} END",
    "us_race_1": draw(_K, 22, 2),
    "us_race_4": draw(_K, 23, 2),
    "school_ftpt": draw(_K, 24, 2),
    "school_online": draw(_K, 25, 4, 1),
    "school_lev": draw(_K, 26, 7, 1),
    **{
        f"olei_olei_{name}": draw(_K, 30 + i, 2)
        for i, name in enumerate(
            ["interest", "job", "degree", "research", "growth", "career", "fun", "social", "experience",
             "certificate", "uniprof", "peer", "language"]
        )
    },
    "HDI": f"{draw(_K, 50, 69, 30)} / 100.0",
    "affirm": f"CASE WHEN {draw(_K, 51, 50)} > 0 THEN {draw(_K, 52, 2)} END",
    "plans": draw(_K, 53, 3),
    "survey_timestamp": f"1470009600 + {draw(_K, 54, 1000000)} * 5",
    "first_activity_timestamp": f"1470009600 + {draw(_K, 54, 1000000)} * 5 - {draw(_K, 55, 5400)}",
    "course_start_timestamp": (
        f"1470009600 + {draw(_K, 54, 1000000)} * 5 - {draw(_K, 55, 5400)} - {draw(_K, 56, 30)} * 86400"
    ),
    "noise": f"{draw(_K, 57, 1000)} / 1000.0 - 0.5",
    "enroll_verified": f"CASE WHEN {draw(_K, 58, 7)} > 0 THEN {draw(_K, 59, 2)} END",
    "upgrade_verified": f"CASE WHEN {draw(_K, 60, 9)} > 0 THEN {draw(_K, 61, 2)} END",
    "cert_verified": f"CASE WHEN {draw(_K, 62, 8)} > 0 THEN {draw(_K, 63, 2)} END",
    "coin": f"{draw(_K, 64, 1000)} / 1000.0",
    "totalprice": "o_totalprice",
}

_A = "o_orderkey"

ACTIONS = {
    "row_id": _A,
    "id_map_hash_id": "CONCAT('u', CAST(o_custkey AS VARCHAR(20)))",
    "enrollment_course_id": (
        "CONCAT('org/C', SUBSTR(o_orderpriority, 1, 1), "
        f"CASE WHEN {draw(_A, 1, 2)} = 0 THEN '_r1' ELSE '' END, '/term')"
    ),
    "roles": f"CASE WHEN {draw(_A, 2, 20)} = 0 THEN 'Staff' ELSE 'Student' END",
    "viewed": "1",
    "explored": f"CASE WHEN o_totalprice > 100000 AND {draw(_A, 3, 25)} > 0 THEN 1 ELSE 0 END",
    "completed": "CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END",
    "certified": "CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END",
    "blended": (
        f"CASE WHEN {draw(_A, 4, 3)} = 0 AND o_totalprice > 300000 THEN 1 WHEN {draw(_A, 5, 4)} = 0 THEN NULL ELSE 0 END"
    ),
    "nevents": f"CASE WHEN {draw(_A, 6, 30)} > 0 THEN CAST({draw(_A, 7, 5000)} AS DOUBLE) END",
    "ndays_act": f"CAST({draw(_A, 8, 60)} AS DOUBLE)",
    "nplay_video": f"CAST({draw(_A, 9, 900)} AS DOUBLE)",
    "npause_video": f"CASE WHEN {draw(_A, 10, 12)} > 0 THEN CAST({draw(_A, 11, 300)} AS DOUBLE) END",
    "nvideos_total_watched": f"{draw(_A, 12, 101)} / 100.0",
    "nchapters": f"CAST({draw(_A, 13, 20)} AS DOUBLE)",
    # most learners never post: a heavily tied measure
    "nforum_posts": f"CASE WHEN {draw(_A, 14, 3)} > 0 THEN CAST(0 AS DOUBLE) ELSE CAST({draw(_A, 15, 40)} AS DOUBLE) END",
    "grade": f"CASE WHEN {draw(_A, 16, 9)} > 0 THEN {draw(_A, 17, 1001)} / 1000.0 END",
    "nvideo": "o_totalprice",
    "cc_by_ip": pick(_A, 18, ["US", "CN", "DE", "IN", None]),
}

_S = "c_custkey"
_IMPORTANCE = [
    "Not Important", "Slightly Important", "Somewhat Important", "Very Important", "Extremely Important", "", None,
]

SURVEY = {
    "id_map_hash_id": "CONCAT('u', CAST(c_custkey AS VARCHAR(20)))",
    "group_name": pick(_S, 1, ["Residential", "Blended", "Verified", "Verified", "Verified"]),
    "group": draw(_S, 2, 2, 1),
    **{f"mrmi_mrmi_{i}": pick(_S, 2 + i, _IMPORTANCE) for i in range(1, 11)},
    "intent_lecture": pick(_S, 14, ["All lectures", "Most lectures", "Some lectures", "", None]),
    "intent_assess": pick(_S, 15, ["All assessments", "Most assessments", "A few", "", None]),
    "forums": pick(_S, 16, ["Participate frequently", "Read now and then", "", None]),
    "hours": pick(_S, 17, ["1", "2", "3", "5", "8", "13.5", "", None]),
    "oc_comp": pick(_S, 18, ["0", "1", "2", "4", "many", "", None]),
    "goal_setting": pick(_S, 19, ["Never", "Rarely", "Sometimes", "Most of the time", "Always", "", None]),
    "fam": pick(
        _S,
        20,
        ["Not at all familiar", "Slightly familiar", "Somewhat familiar", "Very familiar", "Extremely familiar", None],
    ),
    "likely_complete_1": f"CAST({draw(_S, 21, 101)} AS DOUBLE)",
}


def _project(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    return spread(df, key).selectExpr(*[f"{expr} AS `{name}`" for name, expr in columns.items()])


def _statement(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f'{expr} AS "{name}"' for name, expr in columns.items()) + f" FROM {table}"


def learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(
        read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", LEARNERS
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(
        read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"),
        "o_orderkey",
        ACTIONS,
    )


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", SURVEY)


LEARNERS_SQL = _statement(LEARNERS, "orders")
ACTIONS_SQL = _statement(ACTIONS, "orders")
SURVEY_SQL = _statement(SURVEY, "customer")
