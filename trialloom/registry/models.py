"""Designs, cross products, regressions, mixed models, the plan grid and the sparse model."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions.nulls import clamp, flag
from trialloom.functions.scalars import paste
from trialloom.operators.assign import strata_bins
from trialloom.operators.exposure import ExposureSpec
from trialloom.operators.features import subgroup_indicators
from trialloom.operators.models.design import Design, crossed, design_frame, main
from trialloom.operators.models.gram import cell_totals, centred_products
from trialloom.operators.models.linear import ols, ols_factor, with_p_values
from trialloom.operators.models.mixed import fit_linear, fit_logistic, is_binary
from trialloom.operators.ranks import with_rank
from trialloom.operators.models.sparse import posterior_draws, posterior_summary
from trialloom.plans import confirmatory
from trialloom.plans.exploratory import heterogeneous_effects
from trialloom.registry.activity import CLASSIFIED, classified
from trialloom.registry.assignment import erfc_sqrt
from trialloom.registry.inputs import LEARNERS_SQL, learners, read

# ids repeat, so the exposure history decides who is in a sample; the gap is short enough for the spread of the stand-in times
SPEC = ExposureSpec(tie_break=("row_id",), clean_gap_days=3)


def experiment(spark, sf_dir):
    """The learner table with strata, arms, indicators and outcomes that carry known effects."""
    rows = subgroup_indicators(strata_bins(learners(spark, sf_dir)))
    rows = rows.withColumns({"plans_long": flag(F.col("plans") == 2), "plans_short": flag(F.col("plans") == 1)})
    p = (
        F.lit(0.2)
        + 0.03 * F.col("intent_assess")
        + 0.02 * (F.col("course") % 7)
        + 0.05 * F.coalesce("affirm", F.lit(0)) * (1 - F.col("highHDI"))
        + 0.025 * F.col("plans_short")
        + 0.05 * F.col("plans_long")
        + 0.3 * F.col("noise")
    )
    rows = rows.withColumn("y_prob", clamp(p, 0.0, 1.0))
    return rows.withColumns(
        {
            "cert_basic": flag(F.col("coin") < F.col("y_prob")),
            "course_progress": 100 * F.col("y_prob"),
            # learners answer in whole percents, and a little too high
            "likely_complete_1": F.round(100 * F.sqrt(F.col("y_prob") * (F.col("y_prob") + 0.2))),
        }
    )


def rounded_fit(table, digits=4):
    return table.withColumns({c: F.round(c, digits) for c in ("estimate", "std_error", "statistic", "p_value")})


def q_design_matrix(spark, sf_dir):
    design = Design.of(
        crossed("affirm", "highHDI", "threat_country"), main("plans"), main("course_selfpaced"), scaled=("threat_country",)
    )
    rows = subgroup_indicators(learners(spark, sf_dir)).dropna(subset=["affirm"])
    frame = design_frame(rows, design, ["row_id"])
    names = {f"x{i}": n.replace(":", "_").replace("scale(threat_country)", "z") for i, n in enumerate(design.names)}
    return frame.select("row_id", *[F.round(x, 6).alias(n) for x, n in names.items()])


def _lines_with_nation(spark, sf_dir, *more):
    lines = read(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linenumber", "l_quantity", "l_discount", "l_tax", *more
    )
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return lines.join(suppliers, "l_suppkey")


def q_gram_cells(spark, sf_dir):
    rows = _lines_with_nation(spark, sf_dir)
    sums = cell_totals(rows, ["l_quantity", "l_discount", "l_tax"], ["s_nationkey", "l_returnflag", "l_linenumber"])
    return sums.withColumns({c: F.round(c, 4) for c in ("s_0", "s_1", "s_2")})


def q_gram_products(spark, sf_dir):
    sums = centred_products(_lines_with_nation(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"])
    return sums.select(*[F.round(c, 3).alias(c) for c in sums.columns])


def q_family_choice(spark, sf_dir):
    """Binary, numeric and binary-with-a-gap outcomes."""
    rows = experiment(spark, sf_dir)
    out = [(y, is_binary(rows, y)) for y in ("cert_basic", "course_progress", "cert_verified")]
    return spark.createDataFrame(out, "outcome string, is_binary boolean")


def q_ols_factor(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    out = ols_factor(orders.select("o_totalprice", F.coalesce("status", "o_orderpriority").alias("level")), "o_totalprice", "level")
    return out.withColumns(
        {c: F.round(c, d) for c, d in (("estimate", 3), ("std_error", 4), ("statistic", 6), ("r_squared", 8), ("f_statistic", 6))}
    )


def _log_activity(spark, sf_dir):
    rows = classified(spark, sf_dir).withColumn("log_nevents", F.log1p("nevents"))
    return ols_factor(rows, "log_nevents", "group_cat")


def q_ols_log_activity(spark, sf_dir):
    """Log activity on participant type; unclassified rows and unknown activity drop out."""
    out = _log_activity(spark, sf_dir)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("term", "df", "df_model")})


def q_ols_funnel(spark, sf_dir):
    """The same fit with its tail probabilities."""
    out = with_p_values(_log_activity(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("term", "df", "df_model")})


def q_ols_saturated(spark, sf_dir):
    """Two crossed indicators and a constant term, which is dropped."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_extendedprice",
        flag(F.col("l_returnflag") == "R").alias("returned"),
        flag(F.col("l_linestatus") == "F").alias("filled"),
        F.when(F.col("l_quantity") > 0, 4).alias("always_4"),
    )
    table, _ = ols(lines, "l_extendedprice", Design.of(crossed("returned", "filled"), main("always_4")))
    return table.select(
        "term", F.round("estimate", 3).alias("estimate"), F.round("std_error", 3).alias("std_error"),
        F.round("statistic", 4).alias("statistic"),
    )


def q_mixed_linear(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_extendedprice"
    )
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = lines.join(suppliers, "l_suppkey").withColumns(
        {
            "returned": flag(F.col("l_returnflag") == "R"),
            "nation_line": paste("s_nationkey", "l_linenumber", sep=":"),
            "price": F.col("l_extendedprice") / 1000,
        }
    )
    design = Design.of(crossed("returned", "l_discount"), main("l_quantity"), scaled=("l_quantity",))
    fit = fit_linear(rows, "price", design, ["s_nationkey", "nation_line", "l_linestatus"])
    return rounded_fit(fit.table(spark, "price", "price", "all"))


def q_mixed_logistic(spark, sf_dir):
    rows = experiment(spark, sf_dir).dropna(subset=["affirm"])
    design = Design.of(crossed("affirm", "highHDI"), main("plans_long", "plans_short", "intent_assess"))
    fit = fit_logistic(rows, "cert_basic", design, ["institution", "course", "strata"])
    return rounded_fit(fit.table(spark, "simple", "cert_basic", "all"), 3)


def q_mixed_one_way(spark, sf_dir):
    """Mean price per nation and line number with an intercept per nation: a balanced one-way layout."""
    cells = _lines_with_nation(spark, sf_dir, "l_extendedprice").groupBy("s_nationkey", "l_linenumber").agg(
        (F.avg("l_extendedprice") / 100).alias("price")
    )
    return _mixed_rows(fit_linear(cells, "price", Design.of(), ["s_nationkey"]), spark)


def q_mixed_saturated(spark, sf_dir):
    """Late lines on two crossed indicators, with an intercept per lane that is dealt to be without effect."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        flag(F.col("l_returnflag") == "R").alias("returned"),
        flag(F.col("l_quantity") > 25).alias("large"),
        flag(F.col("l_discount") > 0.05).alias("reduced"),
    )
    ranked = with_rank(lines, None, ["l_orderkey", "l_linenumber"], ["returned", "large", "reduced"])
    fit = fit_logistic(ranked.withColumn("lane", F.col("rank") % 5), "reduced", Design.of(crossed("returned", "large")), ["lane"])
    return _mixed_rows(fit, spark)


def _mixed_rows(fit, spark):
    """Terms with estimates, and the spread of the intercepts; the row that flags a cut search would show as one more."""
    rows = fit.table(spark, "m", "y", "all")
    digits = F.when(F.col("term").startswith("sd("), F.round("estimate", 2)).otherwise(F.round("estimate", 3))
    return rows.select("term", digits.alias("estimate"), F.round("std_error", 3).alias("std_error"))


def q_plan_grid(spark, sf_dir):
    """Every planned model on every planned outcome, each on its own sample."""
    prepared = confirmatory.prepare(experiment(spark, sf_dir), SPEC)
    return rounded_fit(confirmatory.fit_grid(prepared, confirmatory.planned_fits()), 3)


def q_plan_descriptives(spark, sf_dir):
    out = confirmatory.descriptives(confirmatory.prepare(experiment(spark, sf_dir), SPEC))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("affirm", "plans", "N", "N_harvardMIT")})


def q_plan_balance(spark, sf_dir):
    out = confirmatory.balance(confirmatory.prepare(experiment(spark, sf_dir), SPEC))
    return out.withColumns({c: F.round(c, 6) for c in ("expected", "share", "statistic", "p_value")})


def q_sparse_hte(spark, sf_dir):
    out = heterogeneous_effects(experiment(spark, sf_dir), spec=SPEC)
    return out.withColumns({c: F.round(c, 6) for c in ("median", "low", "high", "share_nonzero")})


def q_sparse_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("price"),
        flag(F.col("l_returnflag") == "R").alias("returned"),
        flag(F.col("l_linestatus") == "F").alias("filled"),
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_linenumber",
        "l_returnflag",
    )
    draws = posterior_draws(
        lines, "price", ["returned", "filled"], ["l_quantity", "l_discount", "l_tax"], ["l_linenumber"]
    )
    out = posterior_summary(draws)
    return out.withColumns({c: F.round(c, 4) for c in ("median", "low", "high", "share_nonzero")})


def q_draws_summary(spark, sf_dir):
    """The summary of draws on a table of values with many zeros."""
    value = F.when(F.col("l_discount") < 0.02, 0).otherwise(F.col("l_discount") * (F.col("l_quantity") - 25))
    lines = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("term"), value.alias("value"))
    out = posterior_summary(lines)
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("median", "low", "high", "share_nonzero")})


QUERIES = {
    "design_matrix": q_design_matrix,
    "gram_cells": q_gram_cells,
    "gram_products": q_gram_products,
    "family_choice": q_family_choice,
    "ols_factor": q_ols_factor,
    "ols_log_activity": q_ols_log_activity,
    "ols_funnel": q_ols_funnel,
    "ols_saturated": q_ols_saturated,
    "mixed_linear": q_mixed_linear,
    "mixed_logistic": q_mixed_logistic,
    "mixed_one_way": q_mixed_one_way,
    "mixed_saturated": q_mixed_saturated,
    "plan_descriptives": q_plan_descriptives,
    "plan_balance": q_plan_balance,
    "plan_grid": q_plan_grid,
    "sparse_hte": q_sparse_hte,
    "sparse_lines": q_sparse_lines,
    "draws_summary": q_draws_summary,
}

EXPERIMENT = f"""
raw AS ({LEARNERS_SQL}),
ind AS (SELECT *, CAST(HDI > 0.7 AS INT) AS "highHDI", CAST(fluent = 5 AS INT) AS is_fluent,
               CAST(plans = 2 AS INT) AS plans_long, CAST(plans = 1 AS INT) AS plans_short,
               CASE WHEN intent_assess > 2 THEN 1 ELSE 0 END AS strata_intent_assess,
               CASE WHEN hours > 5 THEN 1 ELSE 0 END AS strata_hours,
               CASE WHEN crs_finish > 3 THEN 2 WHEN crs_finish > 0 THEN 1 ELSE 0 END AS strata_crs_finish,
               CASE WHEN educ < 4 THEN 2 WHEN educ = 4 THEN 1 ELSE 0 END AS strata_educ FROM raw),
outc AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.2::DOUBLE + 0.03::DOUBLE * intent_assess
                 + 0.02::DOUBLE * (course % 7) + 0.05::DOUBLE * coalesce(affirm, 0) * (1 - "highHDI")
                 + 0.025::DOUBLE * plans_short + 0.05::DOUBLE * plans_long + 0.3::DOUBLE * noise)) AS y_prob FROM ind),
exper AS (SELECT *, CAST(coin < y_prob AS INT) AS cert_basic, 100 * y_prob AS course_progress FROM outc),
expo AS (SELECT *, row_number() OVER w AS nth, lead(survey_timestamp) OVER w AS next_at FROM exper
         WHERE webservice_call_complete = 1 AND affirm IS NOT NULL AND plans IS NOT NULL
         WINDOW w AS (PARTITION BY id ORDER BY survey_timestamp NULLS LAST, row_id)),
itt AS (SELECT * FROM expo WHERE nth = 1 AND (next_at IS NULL OR (next_at - survey_timestamp) / 86400.0 > 3)
        AND (survey_timestamp - first_activity_timestamp) / 3600.0 < 1
        AND ((course_selfpaced AND (1487145600 - first_activity_timestamp) / 86400.0 > 29)
             OR (NOT course_selfpaced AND (first_activity_timestamp - course_start_timestamp) / 86400.0 < 15)))
"""


def _factor_sql(source: str, digits: tuple[int, ...], prefix: str, extra: str = "") -> str:
    """Treatment contrasts from group means; ``source`` gives (level, y)."""
    e, s, t, r, f = digits
    return f"""
g AS (SELECT level, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM ({source})
      WHERE level IS NOT NULL AND y IS NOT NULL GROUP BY 1),
w AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS grand, sum(ss) AS rss, min(level) AS base FROM g),
b AS (SELECT g.n AS bn, g.m AS bm FROM g, w WHERE level = base),
v AS (SELECT sum(g.n * pow(m - grand, 2)) AS ess FROM g, w),
c AS (SELECT CASE WHEN level = base THEN '(Intercept)' ELSE concat('{prefix}', level) END AS term,
             CASE WHEN level = base THEN m ELSE m - bm END AS estimate,
             sqrt(rss / (w.n - k) * CASE WHEN level = base THEN 1 / g.n ELSE 1 / g.n + 1 / bn END) AS std_error,
             CAST(w.n - k AS BIGINT) AS df, CAST(k - 1 AS BIGINT) AS df_model, ess / (ess + rss) AS r_squared,
             (ess / (k - 1)) / (rss / (w.n - k)) AS f_statistic FROM g, w, b, v)
SELECT term, round(estimate, {e}) AS estimate, round(std_error, {s}) AS std_error,
       round(estimate / std_error, {t}) AS statistic, df, df_model, round(r_squared, {r}) AS r_squared,
       round(f_statistic, {f}) AS f_statistic{extra} FROM c"""


def _beta_sql(y: str, b: str, a: str) -> str:
    """The regularised incomplete beta function I_y(b, a) as a series; terms are taken in logarithms."""
    return f"""list_sum(list_transform(range(4000), lambda k: exp(lgamma({a} + {b} + k) - lgamma({a}) - lgamma({b} + 1 + k)
        + (k + {b}) * ln({y}) + {a} * ln(1 - {y}))))"""


def _tail_sql(f: str, m: str, n: str) -> str:
    """Upper tail of F with m and n degrees of freedom, from the series that ends sooner."""
    y = f"greatest({m} * ({f}) / ({n} + {m} * ({f})), 1e-300)"
    x = f"({n} / ({n} + {m} * ({f})))"
    b, a = f"({m} / 2.0::DOUBLE)", f"({n} / 2.0::DOUBLE)"
    return f"greatest(0.0::DOUBLE, CASE WHEN {y} > 0.1 THEN {_beta_sql(x, a, b)} ELSE 1 - {_beta_sql(y, b, a)} END)"


ORACLE = {
    "mixed_one_way": """
WITH c AS (SELECT s_nationkey AS g, l_linenumber, avg(l_extendedprice) / 100 AS y
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
g AS (SELECT g, count(*) AS m, avg(y) AS mean, sum(y * y) - count(*) * pow(avg(y), 2) AS ss FROM c GROUP BY g),
t AS (SELECT count(*) AS k, min(m)::DOUBLE AS m, avg(mean) AS grand, sum(ss) AS within_ss, m * (count(*) * var_pop(mean)) AS between_ss FROM g GROUP BY m),
v AS (SELECT *, within_ss / (k * (m - 1)) AS mse, between_ss / (k - 1) AS msb, (within_ss + between_ss) / (k * m - 1) AS mst FROM t),
f AS (SELECT *, CASE WHEN msb > mse THEN mse ELSE mst END AS s2, CASE WHEN msb > mse THEN msb ELSE mst END AS top FROM v)
SELECT '(Intercept)' AS term, round(grand, 3) AS estimate, round(sqrt(top / (k * m)), 3) AS std_error FROM f
UNION ALL SELECT 'sd(s_nationkey)', round(sqrt((top - s2) / m), 2), NULL FROM f
UNION ALL SELECT 'sd(residual)', round(sqrt(s2), 2), NULL FROM f""",
    "mixed_saturated": """
WITH l AS (SELECT l_returnflag = 'R' AS r, l_quantity > 25 AS b, CAST(l_discount > 0.05 AS INT) AS y FROM lineitem),
g AS (SELECT r, b, ln(sum(y) / (count(*) - sum(y))) AS lo, 1 / sum(y) + 1 / (count(*) - sum(y)) AS v FROM l GROUP BY 1, 2),
w AS (SELECT max(lo) FILTER (NOT r AND NOT b) AS m00, max(lo) FILTER (r AND NOT b) AS m10,
             max(lo) FILTER (NOT r AND b) AS m01, max(lo) FILTER (r AND b) AS m11,
             max(v) FILTER (NOT r AND NOT b) AS v00, max(v) FILTER (r AND NOT b) AS v10,
             max(v) FILTER (NOT r AND b) AS v01, max(v) FILTER (r AND b) AS v11 FROM g)
SELECT '(Intercept)' AS term, round(m00, 3) AS estimate, round(sqrt(v00), 3) AS std_error FROM w
UNION ALL SELECT 'returned', round(m10 - m00, 3), round(sqrt(v10 + v00), 3) FROM w
UNION ALL SELECT 'large', round(m01 - m00, 3), round(sqrt(v01 + v00), 3) FROM w
UNION ALL SELECT 'returned:large', round(m11 - m10 - m01 + m00, 3), round(sqrt(v11 + v10 + v01 + v00), 3) FROM w
UNION ALL SELECT 'sd(lane)', 0.0, NULL""",
    "design_matrix": f"""
WITH r AS (SELECT *, CAST(HDI > 0.7 AS INT) AS h, CAST(course_selfpaced AS INT) AS cs FROM ({LEARNERS_SQL}) WHERE affirm IS NOT NULL),
z AS (SELECT *, (threat_country - avg(threat_country) OVER ()) / stddev_samp(threat_country) OVER () AS z FROM r)
SELECT row_id, affirm::DOUBLE AS affirm, h::DOUBLE AS "highHDI", round(z, 6) AS z, plans::DOUBLE AS plans,
       cs::DOUBLE AS course_selfpaced, (affirm * h)::DOUBLE AS "affirm_highHDI", round(affirm * z, 6) + 0.0 AS affirm_z,
       round(h * z, 6) + 0.0 AS "highHDI_z", round(affirm * h * z, 6) + 0.0 AS "affirm_highHDI_z" FROM z""",
    "gram_cells": """
SELECT s_nationkey, l_returnflag, l_linenumber, count(*) AS n, round(sum(l_quantity), 4) AS s_0,
       round(sum(l_discount), 4) AS s_1, round(sum(l_tax), 4) AS s_2
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
    "gram_products": """
WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_tax) AS mc
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
x AS (SELECT l_quantity - ma AS a, l_discount - mb AS b, l_tax - mc AS c
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey, m)
SELECT round(sum(a * a), 3) AS p_0_0, round(sum(a * b), 3) + 0.0 AS p_0_1, round(sum(a * c), 3) + 0.0 AS p_0_2,
       round(sum(b * b), 3) AS p_1_1, round(sum(b * c), 3) + 0.0 AS p_1_2, round(sum(c * c), 3) AS p_2_2 FROM x""",
    "family_choice": f"""
WITH {EXPERIMENT}
SELECT 'cert_basic' AS outcome, avg(CAST(coalesce(cert_basic IN (0, 1), false) AS INT)) = 1 AS is_binary FROM exper
UNION ALL SELECT 'course_progress', avg(CAST(coalesce(course_progress IN (0, 1), false) AS INT)) = 1 FROM exper
UNION ALL SELECT 'cert_verified', avg(CAST(coalesce(cert_verified IN (0, 1), false) AS INT)) = 1 FROM exper""",
    "ols_factor": "WITH "
    + _factor_sql(
        "SELECT coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) AS level, o_totalprice AS y FROM orders",
        (3, 4, 6, 8, 6),
        "level",
    ),
    "ols_log_activity": f"WITH {CLASSIFIED},"
    + _factor_sql("SELECT group_cat AS level, ln(1 + nevents) AS y FROM act", (6, 6, 6, 6, 6), "group_cat"),
    "ols_funnel": f"WITH {CLASSIFIED},"
    + _factor_sql(
        "SELECT group_cat AS level, ln(1 + nevents) AS y FROM act", (6, 6, 6, 6, 6), "group_cat",
        f""", round({_tail_sql("pow(estimate / std_error, 2)", "1", "df")}, 6) AS p_value,
       round({_tail_sql("f_statistic", "df_model", "df")}, 6) AS f_p_value""",
    ),
    "draws_summary": """
SELECT term, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(quantile_cont(value, 0.025), 6) AS low,
       round(quantile_cont(value, 0.975), 6) AS high, round(avg(CAST(value <> 0 AS INT)), 6) AS share_nonzero
FROM (SELECT concat(l_returnflag, l_linestatus) AS term,
             CASE WHEN l_discount < 0.02 THEN 0 ELSE l_discount * (l_quantity - 25) END AS value FROM lineitem) GROUP BY term""",
    "ols_saturated": """
WITH l AS (SELECT l_extendedprice AS y, l_returnflag = 'R' AS r, l_linestatus = 'F' AS f FROM lineitem),
g AS (SELECT r, f, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM l GROUP BY 1, 2),
w AS (SELECT sum(ss) / (sum(n) - 4) AS s2,
             max(m) FILTER (NOT r AND NOT f) AS m00, max(m) FILTER (r AND NOT f) AS m10,
             max(m) FILTER (NOT r AND f) AS m01, max(m) FILTER (r AND f) AS m11,
             1 / max(n) FILTER (NOT r AND NOT f) AS v00, 1 / max(n) FILTER (r AND NOT f) AS v10,
             1 / max(n) FILTER (NOT r AND f) AS v01, 1 / max(n) FILTER (r AND f) AS v11 FROM g),
t AS (SELECT '(Intercept)' AS term, m00 AS e, sqrt(s2 * v00) AS s FROM w
      UNION ALL SELECT 'returned', m10 - m00, sqrt(s2 * (v10 + v00)) FROM w
      UNION ALL SELECT 'filled', m01 - m00, sqrt(s2 * (v01 + v00)) FROM w
      UNION ALL SELECT 'returned:filled', m11 - m10 - m01 + m00, sqrt(s2 * (v11 + v10 + v01 + v00)) FROM w)
SELECT term, round(e, 3) AS estimate, round(s, 3) AS std_error, round(e / s, 4) AS statistic FROM t""",
    "plan_descriptives": f"""
WITH {EXPERIMENT}
SELECT affirm, plans, count(*) AS N, count(*) FILTER (institution IN ('Harvard', 'MIT')) AS "N_harvardMIT",
       round(avg(cert_basic), 6) AS cert_basic, round(avg(cert_verified), 6) AS cert_verified,
       round(avg(enroll_verified), 6) AS enroll_verified, round(avg(upgrade_verified), 6) AS upgrade_verified,
       round(avg(course_progress), 6) AS avg_course_progress, round(avg(2017 - yob), 6) AS avg_age,
       round(avg(CAST(sex = 2 AS INT)), 6) AS prop_women, round(avg(is_fluent), 6) AS prop_fluent,
       round(avg(CAST(intent_assess = 4 AS INT)), 6) AS prop_intent_assess_all,
       round(avg("highHDI"), 6) AS "prop_highHDI" FROM itt GROUP BY 1, 2""",
    "plan_balance": f"""
WITH {EXPERIMENT},
long AS ({" UNION ALL ".join(
        f"""SELECT strata_intent_assess, strata_educ, strata_hours, strata_crs_finish, '{a}' AS arm, {p} AS expected,
            count(*) AS n, sum({a}) AS x, avg({a}) AS share FROM itt GROUP BY 1, 2, 3, 4"""
        for a, p in (("affirm", "0.5::DOUBLE"), ("plans_long", "1 / 3"), ("plans_short", "1 / 3")))}),
gaps AS (SELECT *, abs(x - n * expected) AS gap FROM long),
tested AS (SELECT *, pow(gap - least(0.5, gap), 2) / (n * expected * (1 - expected)) AS statistic FROM gaps)
SELECT strata_intent_assess, strata_educ, strata_hours, strata_crs_finish, n, arm, round(expected, 6) AS expected,
       round(share, 6) AS share, round(statistic, 6) AS statistic, round({erfc_sqrt("statistic")}, 6) AS p_value
FROM tested""",
}
