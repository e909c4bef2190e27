"""Grouped summaries, frequencies, crosstabs, reshape, scales, intent and text answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialloom.functions.nulls import proportion, strict_mean
from trialloom.functions.scalars import course_of_run, round_even, token
from trialloom.operators.columns import by_level, except_for, from_to, with_prefix
from trialloom.operators.crosstab import crosstab_long, crosstab_pct, frequency, to_long, with_midpoint
from trialloom.operators.describe import activity_profile, median_interval, numeric_answers, summarise
from trialloom.operators.likert import (
    FREQUENCY, IMPORTANCE, INDICATORS, REASONS, diverging_shares, high_intent, with_scores,
)
from trialloom.registry.inputs import ACTIONS_SQL, SURVEY_SQL, actions, read, survey

PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
STATUSES = ["F", "O", "P"]
GROUPS = {1: "blended", 2: "comparison"}
ROWS_PER_CELL = 2_000


def q_level_order(spark, sf_dir):
    """Priorities from the highest level down; one of them is outside the scale and comes last."""
    counts = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    place = Window.orderBy(by_level("o_orderpriority", PRIORITIES[:-1], descending=True), "o_orderpriority")
    return counts.withColumn("place", F.row_number().over(place))


def q_column_choice(spark, sf_dir):
    """Columns by place, by prefix and by exclusion."""
    lines = read(spark, sf_dir, "lineitem")
    measures = [c for c in from_to(lines, "l_quantity", "l_tax") if c not in with_prefix(lines, "l_disc")]
    kept = lines.select(*measures, *with_prefix(lines, "l_return", "l_line"))
    kept = kept.select(*except_for(kept, "l_linenumber"))
    return kept.groupBy(*with_prefix(kept, "l_return", "l_line")).agg(*[F.round(F.sum(c), 2).alias(c) for c in measures])


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def q_measures(spark, sf_dir):
    """Strict and skipping means side by side, conditional counts and shares."""
    lines = read(spark, sf_dir, "lineitem").withColumns(
        {"tax": F.nullif("l_tax", F.lit(0.0)), "price": F.when(F.col("l_linenumber") < 8, F.col("l_extendedprice"))}
    )
    out = lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_quantity") > 25).alias("n_large"),
        strict_mean("tax").alias("strict_tax"),
        F.avg("tax").alias("mean_tax"),
        strict_mean("price").alias("strict_price"),
        proportion(F.col("l_discount") > 0.05).alias("share_discounted"),
        proportion(F.col("tax") > 0.04).alias("strict_share_taxed"),
        proportion(F.col("tax") > 0.04, strict=False).alias("share_taxed"),
        F.stddev_samp("l_quantity").alias("sd_quantity"),
        F.min("l_extendedprice").alias("min_price"),
        F.max("l_extendedprice").alias("max_price"),
    )
    exact = ["strict_tax", "mean_tax", "share_discounted", "strict_share_taxed", "share_taxed", "sd_quantity"]
    return rounded(rounded(out, exact), ["strict_price"], 3)


def q_median_ci(spark, sf_dir):
    out = median_interval(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", ROWS_PER_CELL)
    return rounded(out, ["mean", "sd", "median", "se", "hi_int", "low_int"], 3)


def q_median_ties(spark, sf_dir):
    """A measure with few distinct values, over the whole table at once."""
    out = median_interval(read(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", ROWS_PER_CELL)
    return rounded(out, ["mean", "sd", "median", "se", "hi_int", "low_int"])


def q_summary(spark, sf_dir):
    out = summarise(read(spark, sf_dir, "events"), ["user_id"], "value")
    return rounded(out, ["mean", "sd"])


def q_frequency(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    )
    return rounded(frequency(customers, "segment"), ["percent"])


def q_frequency_midpoint(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    table = frequency(orders, "o_orderpriority", ["o_orderstatus"])
    out = with_midpoint(table, PRIORITIES, "o_orderpriority", ["o_orderstatus"])
    return rounded(out, ["percent", "midpoint"])


def q_frequency_sorted(spark, sf_dir):
    """Course frequencies, most frequent first."""
    rows = actions(spark, sf_dir).withColumn("course_id", course_of_run("enrollment_course_id"))
    return rounded(frequency(rows, "course_id"), ["percent"]).orderBy(F.desc("n"), "course_id")


def q_crosstab(spark, sf_dir):
    """One priority is never declared, and one declared level never occurs."""
    orders = read(spark, sf_dir, "orders")
    levels = ["0-NEVER", *PRIORITIES[1:]]
    out = crosstab_pct(orders, "o_orderpriority", levels, "o_orderstatus", STATUSES)
    return rounded(out, [f"pct_{s}" for s in STATUSES])


def q_crosstab_long(spark, sf_dir):
    out = crosstab_long(read(spark, sf_dir, "orders"), "o_orderpriority", PRIORITIES, "o_orderstatus", STATUSES)
    return rounded(out, ["pct"])


def q_goal_setting(spark, sf_dir):
    rows = survey(spark, sf_dir).filter(F.col("group_name") != "Residential")
    labelled = rows.withColumn("g", F.col("group").cast("string"))
    out = crosstab_pct(labelled, "goal_setting", FREQUENCY, "g", ["1", "2"])
    return rounded(out, ["pct_1", "pct_2"])


def q_unpivot(spark, sf_dir):
    """Wide to long keeps the missing values."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_discount", F.nullif("l_tax", F.lit(0.0)).alias("l_tax")
    )
    long = to_long(lines, ["l_suppkey"], ["l_quantity", "l_discount", "l_tax"])
    out = long.groupBy("l_suppkey", "variable").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"), F.sum("value").alias("total")
    )
    return rounded(out, ["total"], 4)


def q_likert_diverging(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    out = diverging_shares(orders, ["o_orderpriority"], "o_orderstatus", PRIORITIES)
    return rounded(out, ["pct", "pct_top2"])


def q_likert_reasons(spark, sf_dir):
    rows = survey(spark, sf_dir).filter(F.col("group_name") != "Residential")
    out = diverging_shares(rows, list(REASONS), "group", IMPORTANCE, GROUPS)
    return rounded(out, ["pct", "pct_top2"])


def q_likert_scores(spark, sf_dir):
    rows = with_scores(survey(spark, sf_dir), "mrmi_mrmi_1", IMPORTANCE)
    return rows.select("id_map_hash_id", "mrmi_mrmi_1", "score", "draw_order")


def q_high_intent(spark, sf_dir):
    rows = survey(spark, sf_dir).filter(F.col("group_name") != "Residential")
    return rounded(high_intent(rows, list(INDICATORS), "group"), ["pct_high"])


def q_high_intent_parts(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_brand", "p_name", "p_type")
    out = high_intent(parts, ["p_name", "p_type"], "p_brand", answered="[a-zA-Z]", high=("red", "blue", "PROMO"))
    return rounded(out, ["pct_high"])


def q_text_numeric(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_type", "props")
    k = F.get_json_object("props", "$.k")
    answers = events.withColumn(
        "answer", F.when(k.cast("int") < 10, F.lit("none")).when(k.cast("int") > 90, F.lit("")).otherwise(k)
    )
    return rounded(numeric_answers(answers, "answer", ["event_type"]), ["mean", "sd"])


def q_survey_hours(spark, sf_dir):
    """Text that holds a digit but is no number spoils the mean, as missing values do."""
    rows = survey(spark, sf_dir).withColumn(
        "answer", F.when((F.col("group") == 2) & (F.col("hours") == "8"), "8 hours").otherwise(F.col("hours"))
    )
    return rounded(numeric_answers(rows, "answer", ["group"]), ["mean", "sd"])


def q_token_clean(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    host = token("url", 3, "/")
    return pages.select(
        "page_id",
        host.alias("host"),
        token("url", 5, "/").alias("page"),
        token(host, 2, ".").alias("site"),
        F.col("url").rlike(r"\?").alias("has_query"),
        F.substring_index(token("url", 5, "/"), "?", 1).alias("page_clean"),
    )


def q_activity_profile(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), "l_returnflag",
        "l_linestatus", "l_linenumber",
    )
    populations = {
        "completed": F.col("l_returnflag") == "R",
        "certified": F.col("l_linenumber") > 5,
        "viewed": F.col("l_quantity") > 0,
        "explored": F.nullif("l_returnflag", F.lit("N")) == "A",
    }
    group = F.when(F.col("l_linestatus") == "F", "Blended students").otherwise("Other students")
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = activity_profile(lines, measures, populations, group, "blended_binary")
    return rounded(out, ["mean", "sd", "se"], 4)


def q_activity_log(spark, sf_dir):
    from trialloom.operators.funnel import clean_flag
    from trialloom.plans.report import ACTIONS

    rows = actions(spark, sf_dir).filter(F.col("roles") == "Student")
    populations = {p: F.col(p) == 1 for p in ("completed", "certified", "viewed", "explored")}
    group = F.when(clean_flag("blended"), "Blended students").otherwise("Other students")
    out = activity_profile(rows, ACTIONS, populations, group, "blended_binary")
    return rounded(out, ["mean", "sd", "se"])


def q_round_even(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    half = F.floor("o_totalprice") / 2
    return orders.select("o_orderkey", round_even(half).cast("long").alias("half_even"))


QUERIES = {
    "level_order": q_level_order,
    "column_choice": q_column_choice,
    "measures": q_measures,
    "median_ci": q_median_ci,
    "median_ties": q_median_ties,
    "summary": q_summary,
    "frequency": q_frequency,
    "frequency_midpoint": q_frequency_midpoint,
    "frequency_sorted": q_frequency_sorted,
    "crosstab_pct": q_crosstab,
    "crosstab_long": q_crosstab_long,
    "goal_setting": q_goal_setting,
    "unpivot": q_unpivot,
    "likert_diverging": q_likert_diverging,
    "likert_reasons": q_likert_reasons,
    "likert_scores": q_likert_scores,
    "high_intent": q_high_intent,
    "high_intent_parts": q_high_intent_parts,
    "text_numeric": q_text_numeric,
    "survey_hours": q_survey_hours,
    "token_clean": q_token_clean,
    "activity_profile": q_activity_profile,
    "activity_log": q_activity_log,
    "round_even": q_round_even,
}

_CI = """
SELECT {g}, round(avg({v}), {d}) AS mean, round(stddev_samp({v}), {d}) AS sd, count(*) AS n,
       round(median({v}), {d}) AS median, round(stddev_samp({v}) / sqrt(count(*)), {d}) AS se,
       round(avg({v}) + 2.58::DOUBLE * (stddev_samp({v}) / sqrt(count(*))), {d}) AS hi_int,
       round(avg({v}) - 2.58::DOUBLE * (stddev_samp({v}) / sqrt(count(*))), {d}) AS low_int
FROM {t} GROUP BY {g}"""


def _values(levels):
    return "(VALUES " + ", ".join(f"('{v}', {i})" for i, v in enumerate(levels, start=1)) + ")"


def _diverging(long_sql, item, levels):
    """Shares of all declared levels; ``long_sql`` gives (variable, group_label, level)."""
    k = len(levels)
    return f"""
WITH long AS ({long_sql}),
lv AS (SELECT * FROM {_values(levels)} t(level, score)),
counts AS (SELECT variable, group_label, level, count(*) AS n FROM long JOIN lv USING (level)
           WHERE group_label IS NOT NULL GROUP BY 1, 2, 3),
totals AS (SELECT variable, group_label, sum(n) AS total FROM counts GROUP BY 1, 2),
shares AS (SELECT t.variable, t.group_label, lv.level, lv.score,
                  coalesce(c.n, 0) / t.total * CASE WHEN lv.score <= {k - 2} THEN -1 ELSE 1 END AS pct
           FROM totals t CROSS JOIN lv LEFT JOIN counts c
             ON c.variable = t.variable AND c.group_label = t.group_label AND c.level = lv.level)
SELECT variable AS {item}, group_label, level, CAST(score AS INT) AS score,
       CAST(CASE score WHEN {k} THEN {k - 1} WHEN {k - 1} THEN {k} ELSE score END AS INT) AS draw_order,
       round(pct, 6) + 0.0 AS pct, pct > 0 AS top2,
       round(sum(pct) OVER (PARTITION BY variable, group_label, pct > 0), 6) + 0.0 AS pct_top2
FROM shares"""


def _profile(source, group, group_name, measures, populations, digits):
    parts = [
        f"""SELECT '{p}' AS population, '{m}' AS variable, {group} AS {group_name}, round(avg({m}), {digits}) AS mean,
round(stddev_samp({m}), {digits}) AS sd, min({m}) AS min, max({m}) AS max, count({m}) AS n,
round(stddev_samp({m}) / sqrt(count({m})), {digits}) AS se
FROM src WHERE {cond} AND {m} IS NOT NULL GROUP BY 3"""
        for p, cond in populations.items()
        for m in measures
    ]
    return f"WITH src AS ({source})\n" + "\nUNION ALL\n".join(parts)


_REASONS_LONG = " UNION ALL ".join(
    f"""SELECT '{m}' AS variable, CASE "group" WHEN 1 THEN 'blended' WHEN 2 THEN 'comparison' END AS group_label,
{m} AS level FROM ({SURVEY_SQL}) WHERE group_name <> 'Residential'"""
    for m in REASONS
)

_INTENT = " UNION ALL ".join(
    f"""SELECT "group", '{c}' AS indicator,
round(avg(CAST(regexp_matches({c}, 'All|frequently') AS INT)), 6) AS pct_high, count(*) AS n
FROM ({SURVEY_SQL}) WHERE group_name <> 'Residential' AND regexp_matches({c}, '.') GROUP BY 1"""
    for c in INDICATORS
)

ORACLE = {
    "level_order": """
SELECT o_orderpriority, count(*) AS n,
       row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3
                                   WHEN '2-HIGH' THEN 4 END DESC NULLS LAST, o_orderpriority) AS place
FROM orders GROUP BY o_orderpriority""",
    "column_choice": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice,
       round(sum(l_tax), 2) AS l_tax
FROM lineitem GROUP BY 1, 2""",
    "measures": """
WITH l AS (SELECT *, nullif(l_tax, 0.0) AS tax, CASE WHEN l_linenumber < 8 THEN l_extendedprice END AS price
           FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_quantity > 25) AS n_large,
       CASE WHEN count(tax) = count(*) THEN round(avg(tax), 6) END AS strict_tax, round(avg(tax), 6) AS mean_tax,
       CASE WHEN count(price) = count(*) THEN round(avg(price), 3) END AS strict_price,
       round(avg(CAST(l_discount > 0.05 AS INT)), 6) AS share_discounted,
       CASE WHEN count(tax) = count(*) THEN round(avg(CAST(tax > 0.04 AS INT)), 6) END AS strict_share_taxed,
       round(avg(CAST(tax > 0.04 AS INT)), 6) AS share_taxed, round(stddev_samp(l_quantity), 6) AS sd_quantity,
       min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price
FROM l GROUP BY 1, 2""",
    "median_ci": _CI.format(g="o_orderpriority", v="o_totalprice", t="orders", d=3),
    "median_ties": _CI.format(g="l_linestatus", v="l_quantity", t="lineitem", d=6),
    "summary": """
SELECT user_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max,
       count(*) AS n FROM events GROUP BY user_id""",
    "frequency": """
SELECT nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM customer), 6) AS percent FROM customer GROUP BY 1""",
    "frequency_midpoint": f"""
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
p AS (SELECT c.*, lv.ordinal, n / sum(n) OVER (PARTITION BY o_orderstatus) AS percent
      FROM c JOIN {_values(PRIORITIES)} lv(level, ordinal) ON level = o_orderpriority)
SELECT o_orderstatus, o_orderpriority, n, CAST(ordinal AS INT) AS ordinal, round(percent, 6) AS percent,
       round(sum(percent) OVER (PARTITION BY o_orderstatus ORDER BY ordinal ROWS UNBOUNDED PRECEDING) - percent / 2, 6)
         AS midpoint
FROM p""",
    "frequency_sorted": f"""
WITH a AS ({ACTIONS_SQL}),
c AS (SELECT split_part(split_part(enrollment_course_id, '/', 2), '_', 1) AS course_id FROM a)
SELECT course_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS percent FROM c GROUP BY 1""",
    "crosstab_pct": f"""
WITH lv AS (SELECT * FROM {_values(["0-NEVER", *PRIORITIES[1:]])} t(level, ordinal)),
o AS (SELECT o_orderpriority, o_orderstatus FROM orders JOIN lv ON level = o_orderpriority)
SELECT level AS o_orderpriority, CAST(ordinal AS INT) AS ordinal,
       round(count(*) FILTER (o_orderstatus = 'F') / (SELECT count(*) FROM o WHERE o_orderstatus = 'F'), 6) AS "pct_F",
       round(count(*) FILTER (o_orderstatus = 'O') / (SELECT count(*) FROM o WHERE o_orderstatus = 'O'), 6) AS "pct_O",
       round(count(*) FILTER (o_orderstatus = 'P') / (SELECT count(*) FROM o WHERE o_orderstatus = 'P'), 6) AS "pct_P"
FROM lv LEFT JOIN o ON level = o_orderpriority GROUP BY 1, 2""",
    "crosstab_long": f"""
SELECT o_orderpriority, CAST(ordinal AS INT) AS ordinal, o_orderstatus AS group_label,
       round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS pct
FROM orders JOIN {_values(PRIORITIES)} lv(level, ordinal) ON level = o_orderpriority GROUP BY 1, 2, 3""",
    "goal_setting": f"""
WITH s AS (SELECT * FROM ({SURVEY_SQL}) WHERE group_name <> 'Residential'),
lv AS (SELECT * FROM {_values(FREQUENCY)} t(level, ordinal)),
k AS (SELECT goal_setting, "group" AS g FROM s JOIN lv ON level = goal_setting)
SELECT level AS goal_setting, CAST(ordinal AS INT) AS ordinal,
       round(count(*) FILTER (g = 1) / (SELECT count(*) FROM k WHERE g = 1), 6) AS pct_1,
       round(count(*) FILTER (g = 2) / (SELECT count(*) FROM k WHERE g = 2), 6) AS pct_2
FROM lv LEFT JOIN k ON level = goal_setting GROUP BY 1, 2""",
    "unpivot": """
WITH l AS (SELECT l_suppkey, l_quantity, l_discount, nullif(l_tax, 0.0) AS l_tax FROM lineitem),
u AS (SELECT * FROM l UNPIVOT INCLUDE NULLS (value FOR variable IN (l_quantity, l_discount, l_tax)))
SELECT l_suppkey, variable, count(*) AS n, count(value) AS n_known, round(sum(value), 4) AS total FROM u GROUP BY 1, 2""",
    "likert_diverging": _diverging(
        "SELECT 'o_orderpriority' AS variable, o_orderstatus AS group_label, o_orderpriority AS level FROM orders",
        "variable",
        PRIORITIES,
    ),
    "likert_reasons": _diverging(_REASONS_LONG, "variable", IMPORTANCE),
    "likert_scores": f"""
SELECT id_map_hash_id, mrmi_mrmi_1,
       CASE mrmi_mrmi_1 WHEN 'Not Important' THEN 1 WHEN 'Slightly Important' THEN 2 WHEN 'Somewhat Important' THEN 3
            WHEN 'Very Important' THEN 4 WHEN 'Extremely Important' THEN 5 END AS score,
       CASE mrmi_mrmi_1 WHEN 'Not Important' THEN 1 WHEN 'Slightly Important' THEN 2 WHEN 'Somewhat Important' THEN 3
            WHEN 'Very Important' THEN 5 WHEN 'Extremely Important' THEN 4 END AS draw_order
FROM ({SURVEY_SQL})""",
    "high_intent": _INTENT,
    "high_intent_parts": " UNION ALL ".join(
        f"""SELECT p_brand, '{c}' AS indicator, round(avg(CAST(regexp_matches({c}, 'red|blue|PROMO') AS INT)), 6) AS pct_high,
count(*) AS n FROM part WHERE regexp_matches({c}, '[a-zA-Z]') GROUP BY 1"""
        for c in ("p_name", "p_type")
    ),
    "text_numeric": """
WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_type, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS sd, count(*) AS n
FROM e WHERE k BETWEEN 10 AND 90 GROUP BY 1""",
    "survey_hours": f"""
WITH s AS (SELECT "group", CASE WHEN "group" = 2 AND hours = '8' THEN '8 hours' ELSE hours END AS answer
           FROM ({SURVEY_SQL})),
k AS (SELECT "group", try_cast(answer AS DOUBLE) AS x FROM s WHERE regexp_matches(answer, '[0-9]'))
SELECT "group", CASE WHEN count(x) = count(*) THEN round(avg(x), 6) END AS mean,
       CASE WHEN count(x) = count(*) THEN round(stddev_samp(x), 6) END AS sd, count(*) AS n FROM k GROUP BY 1""",
    "token_clean": """
WITH t AS (SELECT page_id, url, string_split(url, '/') AS p FROM pages)
SELECT page_id, p[3] AS host, p[5] AS page, string_split(p[3], '.')[2] AS site,
       contains(url, '?') AS has_query, string_split(p[5], '?')[1] AS page_clean FROM t""",
    "activity_profile": _profile(
        """SELECT l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0.0) AS l_tax, l_returnflag, l_linestatus,
l_linenumber FROM lineitem""",
        "CASE WHEN l_linestatus = 'F' THEN 'Blended students' ELSE 'Other students' END",
        "blended_binary",
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        {
            "completed": "l_returnflag = 'R'",
            "certified": "l_linenumber > 5",
            "viewed": "l_quantity > 0",
            "explored": "l_returnflag = 'A'",
        },
        4,
    ),
    "activity_log": _profile(
        f"SELECT * FROM ({ACTIONS_SQL}) WHERE roles = 'Student'",
        "CASE WHEN coalesce(blended = 1, false) THEN 'Blended students' ELSE 'Other students' END",
        "blended_binary",
        ["nevents", "ndays_act", "nplay_video", "npause_video", "nvideos_total_watched", "nchapters", "nforum_posts",
         "grade"],
        {p: f"{p} = 1" for p in ("completed", "certified", "viewed", "explored")},
        6,
    ),
    "round_even": """
SELECT o_orderkey, CAST(round_even(floor(o_totalprice) / 2, 0) AS BIGINT) AS half_even FROM orders""",
}
