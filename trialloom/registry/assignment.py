"""Strata, assignment, arms, masking, indicators, standardising and balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions.nulls import clamp, if_else
from trialloom.functions.scalars import cut, modulo, paste, reverse_code
from trialloom.operators.assign import (
    decode_factors, even_randomizer, permuted_blocks, remove_counterfactual, strata_bins, with_service_override,
)
from trialloom.operators.balance import adjust_p, balance_table
from trialloom.operators.checks import unseen_answers
from trialloom.operators.features import background_features, composite_index, subgroup_indicators, with_zscores
from trialloom.operators.models.design import numeric_code
from trialloom.registry.inputs import LEARNERS_SQL, learners, read

SEED = 2138
ROWS_PER_CELL = 200
ARMS = {"affirm": 0.5, "plans_long": 1 / 3, "plans_short": 1 / 3}
STRATA = ["strata_intent_assess", "strata_hours", "strata_crs_finish", "strata_educ"]


def stratified(spark, sf_dir):
    covariates = ["row_id", "intent_assess", "hours", "crs_finish", "educ"]
    return strata_bins(learners(spark, sf_dir).select(*covariates))


def assigned(spark, sf_dir):
    rows = stratified(spark, sf_dir)
    return decode_factors(permuted_blocks(rows, "strata", ["row_id"], 6, SEED, ROWS_PER_CELL))


def q_strata_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select(
        "row_id", *STRATA, "strata", "c", "cond", "affirm", "plans", "plans_long", "plans_short", "plans_any"
    )


def q_block_composition(spark, sf_dir):
    """Every block by its rows and distinct arms; a full block has six of each."""
    out = assigned(spark, sf_dir).groupBy("strata", "c").agg(
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set("cond")).cast("long").alias("n_arms")
    )
    return out


def q_even_randomizer(spark, sf_dir):
    keys = learners(spark, sf_dir).select("row_id", "webservice_call_complete", "affirm", "plans")
    affirm = even_randomizer(keys, ["row_id"], 2, "own_affirm", 11, 2_000)
    both = even_randomizer(affirm, ["row_id"], 3, "own_plans", 12, 2_000, store=True)
    out = with_service_override(
        both,
        {"final_affirm": "affirm", "final_plans": "plans"},
        {"final_affirm": "own_affirm", "final_plans": "own_plans"},
        "webservice_call_complete",
    )
    return out.select("row_id", "own_affirm", "own_plans", "final_affirm", "final_plans")


def _answered(spark, sf_dir):
    return learners(spark, sf_dir).select(
        "row_id",
        "affirm",
        "plans",
        (F.col("hours") % 2).alias("affirm_values_1"),
        F.col("yob").alias("affirm_write_time_3"),
        F.col("hours").alias("longplans_time_3"),
        F.col("educ").alias("longplanswrite_time_3"),
        F.col("fam").alias("shortplans_time_3"),
    )


def q_mask_unseen(spark, sf_dir):
    return remove_counterfactual(_answered(spark, sf_dir))


def q_unseen_answers(spark, sf_dir):
    rows = _answered(spark, sf_dir).withColumn("affirm_values_1", F.nullif("affirm_values_1", F.lit(0)))
    flagged = unseen_answers(
        rows,
        {
            "unseen_affirm": (["affirm_values_1"], F.col("affirm") == 1),
            "unseen_short": (["shortplans_time_3"], F.col("plans") == 1),
            "unseen_long": (["longplans_time_3", "longplanswrite_time_3"], F.col("plans") == 2),
        },
    )
    return flagged.groupBy("affirm", "plans").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c)).alias(c) for c in ("unseen_affirm", "unseen_short", "unseen_long", "any_unseen")],
    )


def q_subgroups(spark, sf_dir):
    rows = subgroup_indicators(learners(spark, sf_dir))
    return rows.select(
        "row_id", "highHDI", "HDI4", "is_fluent", "gender_female", "gender_other", "us_majority", "course_selfpaced",
        "educ", "educ_parents",
    )


FEATURES = [
    "age", "educ_phd", "educ_ma_prof", "educ_ba", "educ_some_he", "more_educ_than_parents", "is_teacher", "is_employed",
    "is_unemployed", "is_ft_student", "is_pt_student", "is_blended", "is_hs_student", "is_college_student", "born_in_US",
]


def q_background(spark, sf_dir):
    rows = background_features(subgroup_indicators(learners(spark, sf_dir)))
    coded = numeric_code(rows, ["HDI4", *FEATURES], {"HDI4": ["low", "medium", "high", "v.high"]})
    return coded.select("row_id", "HDI4", *FEATURES)


def q_bins_flags(spark, sf_dir):
    parts = read(spark, sf_dir, "part").withColumn("size", F.nullif("p_size", F.lit(50)))
    return parts.select(
        "p_partkey",
        cut("size", (0, 10, 20, 40), ("small", "medium", "large")).alias("size_bin"),
        reverse_code("size", 60).alias("reversed"),
        clamp(F.col("p_retailprice") / 1000 - 0.5, 0.0, 1.0).alias("clamped"),
        clamp("size", 5, 30).alias("clamped_size"),
        if_else(F.col("size") > 25, F.lit("big"), F.lit("little")).alias("two_way"),
        modulo("size", 6).alias("remainder"),
        paste("size", "p_type", sep="-").alias("pasted"),
    )


def q_zscores(spark, sf_dir):
    """Standardised on the sample rows only."""
    parts = read(spark, sf_dir, "part").select(
        "p_partkey", "p_type", "p_retailprice", F.nullif("p_size", F.lit(50)).alias("p_size")
    )
    sample = parts.filter(F.col("p_type") != "PROMO")
    out = with_zscores(sample, ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.round("z_p_size", 6).alias("z_size"), F.round("z_p_retailprice", 6).alias("z_price"))


def q_zscore_index(spark, sf_dir):
    rows = learners(spark, sf_dir).withColumn(
        "institution_code", F.array_position(F.array(*[F.lit(x) for x in ("Harvard", "MIT", "Stanford")]), F.col("institution"))
    )
    out = composite_index(rows, ["intent_assess", "hours", "crs_finish", "educ", "institution_code", "course"])
    return out.select("row_id", F.round("sig", 6).alias("sig"))


def q_balance(spark, sf_dir):
    table = balance_table(assigned(spark, sf_dir), STRATA, ARMS)
    return table.withColumns({c: F.round(c, 6) for c in ("expected", "share", "statistic", "p_value")})


def q_balance_adjusted(spark, sf_dir):
    table = balance_table(assigned(spark, sf_dir), ["strata"], ARMS)
    out = adjust_p(table, "p_value", ["arm"], ["strata"])
    return out.select(
        "strata", "arm", *[F.round(c, 6).alias(c) for c in ("p_value", "p_bonferroni", "p_holm", "p_bh")]
    )


QUERIES = {
    "strata_assign": q_strata_assign,
    "block_composition": q_block_composition,
    "even_randomizer": q_even_randomizer,
    "mask_unseen": q_mask_unseen,
    "unseen_answers": q_unseen_answers,
    "subgroups": q_subgroups,
    "background": q_background,
    "bins_flags": q_bins_flags,
    "zscores": q_zscores,
    "zscore_index": q_zscore_index,
    "balance": q_balance,
    "balance_adjusted": q_balance_adjusted,
}

ASSIGNED = f"""
raw AS ({LEARNERS_SQL}),
bins AS (SELECT row_id, CASE WHEN intent_assess > 2 THEN 1 ELSE 0 END AS strata_intent_assess,
                CASE WHEN hours > 5 THEN 1 ELSE 0 END AS strata_hours,
                CASE WHEN crs_finish > 3 THEN 2 WHEN crs_finish > 0 THEN 1 ELSE 0 END AS strata_crs_finish,
                CASE WHEN educ < 4 THEN 2 WHEN educ = 4 THEN 1 ELSE 0 END AS strata_educ FROM raw),
keyed AS (SELECT *, concat_ws(' ', strata_intent_assess, strata_hours, strata_crs_finish, strata_educ) AS strata FROM bins),
placed AS (SELECT *, row_number() OVER (PARTITION BY strata ORDER BY md5(concat_ws('|', {SEED}, row_id))) AS pos
           FROM keyed),
blocked AS (SELECT *, (pos - 1) // 6 + 1 AS c, (pos - 1) % 6 + 1 AS place FROM placed),
blocks AS (SELECT DISTINCT strata, c FROM blocked),
orders_of_arms AS (SELECT strata, c, arm, row_number() OVER (PARTITION BY strata, c
                     ORDER BY md5(concat_ws('|', {SEED}, strata, c, arm))) AS place
                   FROM blocks, range(1, 7) a(arm)),
drawn AS (SELECT b.*, CAST(o.arm AS INT) AS cond FROM blocked b JOIN orders_of_arms o USING (strata, c, place)),
arms AS (SELECT *, CAST(cond > 3 AS INT) AS affirm, cond % 3 AS plans, CAST(cond % 3 = 2 AS INT) AS plans_long,
                CAST(cond % 3 = 1 AS INT) AS plans_short, CAST(cond % 3 > 0 AS INT) AS plans_any FROM drawn)
"""


def erfc_sqrt(s: str) -> str:
    """Upper tail of chi-square with 1 df: 1 minus the confluent series of the error function."""
    return (
        f"(1 - exp(-({s}) / 2) * list_sum(list_transform(range(0, 200), "
        f"lambda i: CASE WHEN ({s}) = 0 THEN 0 ELSE exp((i + 0.5) * ln(({s}) / 2) - lgamma(i + 1.5::DOUBLE)) END)))"
    )


def _balance_sql(keys: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {keys}, '{a}' AS arm, {p} AS expected, count(*) AS n, sum({a}) AS x, avg({a}) AS share "
        f"FROM arms GROUP BY {keys}"
        for a, p in (("affirm", "0.5::DOUBLE"), ("plans_long", "1 / 3"), ("plans_short", "1 / 3"))
    )
    return f"""
WITH {ASSIGNED},
long AS ({parts}),
gaps AS (SELECT *, abs(x - n * expected) AS gap FROM long),
tested AS (SELECT *, pow(gap - least(0.5, gap), 2) / (n * expected * (1 - expected)) AS statistic FROM gaps),
valued AS (SELECT *, {erfc_sqrt("statistic")} AS p_value FROM tested)
"""


ORACLE = {
    "strata_assign": f"""
WITH {ASSIGNED}
SELECT row_id, strata_intent_assess, strata_hours, strata_crs_finish, strata_educ, strata, c, cond, affirm, plans,
       plans_long, plans_short, plans_any FROM arms""",
    "block_composition": f"""
WITH {ASSIGNED} SELECT strata, c, count(*) AS n, count(DISTINCT cond) AS n_arms FROM arms GROUP BY 1, 2""",
    "even_randomizer": f"""
WITH r AS ({LEARNERS_SQL}),
d AS (SELECT *, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', 11, row_id))) - 1) % 2 AS INT) AS own_affirm,
             CAST((row_number() OVER (ORDER BY md5(concat_ws('|', 12, row_id))) - 1) % 3 AS INT) AS own_plans FROM r)
SELECT row_id, own_affirm, own_plans,
       coalesce(CASE WHEN webservice_call_complete = 1 THEN affirm END, own_affirm) AS final_affirm,
       coalesce(CASE WHEN webservice_call_complete = 1 THEN plans END, own_plans) AS final_plans FROM d""",
    "mask_unseen": f"""
SELECT row_id, affirm, plans, CASE WHEN coalesce(affirm <> 0, true) THEN hours % 2 END AS affirm_values_1,
       CASE WHEN coalesce(affirm <> 0, true) THEN yob END AS affirm_write_time_3,
       CASE WHEN plans = 2 THEN hours END AS longplans_time_3,
       CASE WHEN plans = 2 THEN educ END AS longplanswrite_time_3,
       CASE WHEN plans = 1 THEN fam END AS shortplans_time_3 FROM ({LEARNERS_SQL})""",
    "unseen_answers": f"""
WITH f AS (SELECT affirm, plans, hours % 2 = 1 AND coalesce(affirm, 0) <> 1 AS a, plans <> 1 AS s, plans <> 2 AS l
           FROM ({LEARNERS_SQL}))
SELECT affirm, plans, count(*) AS n, count(*) FILTER (a) AS unseen_affirm, count(*) FILTER (s) AS unseen_short,
       count(*) FILTER (l) AS unseen_long, count(*) FILTER (a OR s OR l) AS any_unseen FROM f GROUP BY 1, 2""",
    "subgroups": f"""
SELECT row_id, CAST(HDI > 0.7 AS INT) AS "highHDI",
       CASE WHEN HDI <= 0.55 THEN 'low' WHEN HDI <= 0.7 THEN 'medium' WHEN HDI <= 0.8 THEN 'high' ELSE 'v.high' END
         AS "HDI4",
       CAST(fluent = 5 AS INT) AS is_fluent, CAST(sex = 2 AS INT) AS gender_female, CAST(sex = 3 AS INT) AS gender_other,
       CAST((us_race_1 = 1 OR us_race_4 = 1) AND us_ethnicity = 1 AS INT) AS us_majority,
       course BETWEEN 1 AND 5 AS course_selfpaced, 10 - educ AS educ, 10 - educ_parents AS educ_parents
FROM ({LEARNERS_SQL})""",
    "background": f"""
WITH r AS (SELECT * REPLACE (10 - educ AS educ, 10 - educ_parents AS educ_parents) FROM ({LEARNERS_SQL})),
f AS (SELECT row_id, CASE WHEN HDI <= 0.55 THEN 1 WHEN HDI <= 0.7 THEN 2 WHEN HDI <= 0.8 THEN 3 ELSE 4 END AS "HDI4",
       2017 - yob AS age, educ = 9 AS educ_phd, educ IN (7, 8) AS educ_ma_prof, educ = 6 AS educ_ba,
       educ IN (4, 5) AS educ_some_he, educ > educ_parents AS more_educ_than_parents, teach = 1 AS is_teacher,
       empstatus = 1 AS is_employed, empstatus = 2 AS is_unemployed, empstatus = 3 AS is_ft_student,
       school = 1 AND school_ftpt = 0 AS is_pt_student, school = 1 AND school_online > 2 AS is_blended,
       school = 1 AND school_lev IN (1, 2, 3) AS is_hs_student,
       school = 1 AND school_lev IN (4, 5, 6) AS is_college_student, pob = 187 AS "born_in_US" FROM r)
SELECT row_id, COLUMNS(* EXCLUDE (row_id))::DOUBLE FROM f""",
    "bins_flags": """
WITH p AS (SELECT *, nullif(p_size, 50) AS size FROM part)
SELECT p_partkey, CASE WHEN size > 0 AND size <= 10 THEN 'small' WHEN size > 10 AND size <= 20 THEN 'medium'
                       WHEN size > 20 AND size <= 40 THEN 'large' END AS size_bin,
       60 - size AS reversed, greatest(0.0, least(1.0, p_retailprice / 1000 - 0.5)) AS clamped,
       CASE WHEN size IS NOT NULL THEN greatest(5, least(30, size)) END AS clamped_size,
       CASE WHEN size > 25 THEN 'big' WHEN size <= 25 THEN 'little' END AS two_way, size % 6 AS remainder,
       coalesce(CAST(size AS VARCHAR), 'NA') || '-' || p_type AS pasted FROM p""",
    "zscores": """
WITH p AS (SELECT p_partkey, p_retailprice, nullif(p_size, 50) AS p_size FROM part WHERE p_type <> 'PROMO'),
m AS (SELECT avg(p_size) AS ms, stddev_samp(p_size) AS ss, avg(p_retailprice) AS mp, stddev_samp(p_retailprice) AS sp FROM p)
SELECT p_partkey, round((p_size - ms) / ss, 6) + 0.0 AS z_size, round((p_retailprice - mp) / sp, 6) + 0.0 AS z_price FROM p, m""",
    "zscore_index": f"""
WITH r AS (SELECT *, CASE institution WHEN 'Harvard' THEN 1 WHEN 'MIT' THEN 2 ELSE 3 END AS ic FROM ({LEARNERS_SQL})),
z AS (SELECT row_id, {" + ".join(
        f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"
        for c in ("intent_assess", "hours", "crs_finish", "educ", "ic", "course"))} AS total FROM r)
SELECT row_id, round(1 / (1 + exp(-total / 6)), 6) AS sig FROM z""",
    "balance": f"""
{_balance_sql(", ".join(STRATA))}
SELECT {", ".join(STRATA)}, n, arm, round(expected, 6) AS expected, round(share, 6) AS share,
       round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM valued""",
    "balance_adjusted": f"""
{_balance_sql("strata")},
i AS (SELECT *, count(*) OVER (PARTITION BY arm) AS m,
             row_number() OVER (PARTITION BY arm ORDER BY p_value, strata) AS i FROM valued)
SELECT strata, arm, round(p_value, 6) AS p_value, round(least(1, m * p_value), 6) AS p_bonferroni,
       round(max(least(1, (m - i + 1) * p_value)) OVER (PARTITION BY arm ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS p_holm,
       round(min(least(1, m / i * p_value)) OVER (PARTITION BY arm ORDER BY i
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS p_bh
FROM i""",
}
