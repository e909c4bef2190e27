from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from trialloom.operators.columns import except_for, from_to, sorted_by_level, with_prefix
from trialloom.operators.crosstab import crosstab_long, crosstab_pct, frequency, to_long, with_midpoint
from trialloom.operators.describe import activity_profile, country_share, median_interval, numeric_answers
from trialloom.operators.funnel import STAGES, participant_type, percentile_long, percentile_profile
from trialloom.operators.joins import attribute_join, natural_left_join
from trialloom.operators.likert import IMPORTANCE, diverging_shares, high_intent, with_scores
from trialloom.operators.progress import course_progress, later_signups
from trialloom.plans.report import activity_tables, prepare, survey_tables


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_crosstab_keeps_declared_levels(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("b", "x"), ("a", "y"), (None, "x"), ("zz", "x"), ("a", None)], "r string, c string"
    )
    out = rows(crosstab_pct(df, "r", ["a", "b", "c"], "c", ["x", "y", "never"]), "r", "pct_x", "pct_y", "pct_never")
    assert out == [("a", 2 / 3, 1.0, None), ("b", 1 / 3, 0.0, None), ("c", 0.0, 0.0, None)]
    long = crosstab_long(df, "r", ["a", "b"], "c", ["x", "y"])
    sums = {r["group_label"]: r["s"] for r in long.groupBy("group_label").agg(F.sum("pct").alias("s")).collect()}
    assert sums == {"x": pytest.approx(1.0), "y": pytest.approx(1.0)}


def test_crosstab_labels_may_hold_the_prefix(spark):
    df = spark.createDataFrame([("a", "x pct_1"), ("a", "pct_")], "r string, c string")
    long = crosstab_long(df, "r", ["a"], "c", ["x pct_1", "pct_"])
    assert {r["group_label"] for r in long.collect()} == {"x pct_1", "pct_"}


def test_column_choice_and_level_order(spark):
    df = spark.createDataFrame([("low", 1, 2, 3), ("high", 1, 2, 3), ("?", 1, 2, 3), (None, 1, 2, 3)], "v string, q_a int, q_b int, z int")
    assert with_prefix(df, "q_", "z") == ["q_a", "q_b", "z"] and from_to(df, "q_a", "z") == ["q_a", "q_b", "z"]
    assert except_for(df, "v", "z") == ["q_a", "q_b"]
    for wrong in (lambda: from_to(df, "z", "v"), lambda: except_for(df, "nope")):
        with pytest.raises(ValueError):
            wrong()
    got = [r.v for r in sorted_by_level(df, "v", ["low", "high"], descending=True, then=["v"]).collect()]
    assert got == ["high", "low", None, "?"]


def test_frequency_counts_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    assert rows(frequency(df, "v"), "v", "n", "percent") == [("a", 2, 0.5), ("b", 1, 0.25), (None, 1, 0.25)]
    mid = with_midpoint(frequency(df, "v"), ["b", "a"], "v")
    assert rows(mid, "v", "midpoint") == [("a", 0.5), ("b", 0.125)]


def test_unpivot_keeps_null(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "i int, a double, b double")
    assert rows(to_long(df, ["i"], ["a", "b"]), "variable", "value") == [("a", 2.0), ("b", None)]


def test_diverging_shares(spark):
    df = spark.createDataFrame(
        [(1, "Very Important"), (1, "Extremely Important"), (1, "Not Important"), (1, ""), (2, "Not Important"), (2, None),
         (3, "Very Important")],
        "group int, m string",
    )
    out = diverging_shares(df, ["m"], "group", IMPORTANCE, {1: "blended", 2: "comparison"}).collect()
    assert len(out) == 10
    by = {(r["group_label"], r["level"]): r for r in out}
    assert by["blended", "Very Important"]["pct"] == pytest.approx(1 / 3)
    assert by["blended", "Very Important"]["pct_top2"] == pytest.approx(2 / 3)
    assert (by["blended", "Very Important"]["score"], by["blended", "Very Important"]["draw_order"]) == (4, 5)
    assert by["blended", "Not Important"]["pct"] == pytest.approx(-1 / 3)
    # nobody in the group chose a top level
    assert by["comparison", "Not Important"]["pct"] == -1.0
    assert by["comparison", "Extremely Important"]["pct"] == 0.0
    assert not any(r["top2"] for r in out if r["group_label"] == "comparison")


def test_scores(spark):
    df = spark.createDataFrame([("Extremely Important",), ("Very Important",), ("maybe",), (None,)], "m string")
    assert rows(with_scores(df, "m", IMPORTANCE), "score", "draw_order") == [(4, 5), (5, 4), (None, None), (None, None)]


def test_high_intent_ignores_blanks(spark):
    df = spark.createDataFrame(
        [(1, "All lectures"), (1, "Some"), (1, ""), (1, None), (2, "")], "group int, intent_lecture string"
    )
    out = rows(high_intent(df, ["intent_lecture"], "group"), "group", "indicator", "pct_high", "n")
    assert out == [(1, "intent_lecture", 0.5, 2)]


def test_numeric_answers(spark):
    df = spark.createDataFrame([(1, "2"), (1, "4"), (1, "none"), (1, None), (2, "3 or 4"), (2, "1")], "g int, a string")
    out = rows(numeric_answers(df, "a", ["g"]), "g", "mean", "sd", "n")
    assert out == [(1, 3.0, pytest.approx(2**0.5), 2), (2, None, None, 2)]


def test_activity_profile_matches_direct_moments(spark):
    data = [(i % 3 == 0, i % 2 == 0, i % 5 == 0, float(i * i % 17) if i % 7 else None, i % 4 == 0) for i in range(200)]
    df = spark.createDataFrame(data, "p boolean, q boolean, r boolean, m double, b boolean")
    out = activity_profile(
        df, ["m"], {"P": F.col("p"), "Q": F.col("q"), "R": F.when(F.col("r"), True)},
        F.when(F.col("b"), "yes").otherwise("no"), "grp",
    )
    got = {(r["population"], r["grp"]): r for r in out.collect()}
    for i, name in enumerate("PQR"):
        for b in (True, False):
            xs = [d[3] for d in data if d[i] and d[4] is b and d[3] is not None]
            r = got[name, "yes" if b else "no"]
            assert r["n"] == len(xs)
            assert (r["min"], r["max"]) == (min(xs), max(xs))
            assert r["mean"] == pytest.approx(statistics.mean(xs))
            assert r["sd"] == pytest.approx(statistics.stdev(xs))
            assert r["se"] == pytest.approx(statistics.stdev(xs) / len(xs) ** 0.5)


def test_activity_profile_single_row_has_no_sd(spark):
    df = spark.createDataFrame([(True, 4.0)], "p boolean, m double")
    r = activity_profile(df, ["m"], {"P": F.col("p")}, F.lit("g"), "grp").first()
    assert (r["mean"], r["sd"], r["se"], r["n"]) == (4.0, None, None, 1)


def test_median_interval_counts_missing_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), ("c", None)], "g string, x double")
    out = {r["g"]: r for r in median_interval(df, ["g"], "x").collect()}
    assert out["a"]["n"] == 3 and out["a"]["median"] == 2.0
    assert out["a"]["se"] == pytest.approx(2**0.5 / 3**0.5)
    assert out["a"]["hi_int"] == pytest.approx(2 + 2.58 * (2 / 3) ** 0.5)
    assert out["b"]["se"] is None and out["c"]["mean"] is None and out["c"]["n"] == 1


def test_participant_type_is_strict(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 0, 0), (1, 1, 1, 0, 0), (1, 1, 1, 1, 1), (1, 0, 1, 0, 0), (0, 0, 0, 0, 0), (1, None, 0, 0, 0)],
        ", ".join(f"{s} int" for s in STAGES),
    )
    assert [r[0] for r in df.select(participant_type()).collect()] == ["viewed", "completed", "blended", None, None, None]


def test_country_share_drops_unclassified(spark):
    df = spark.createDataFrame([("viewed", "US"), ("viewed", "DE"), ("viewed", None), (None, "US")], "group_cat string, cc_by_ip string")
    assert rows(country_share(df), "group_cat", "pct") == [("viewed", 0.5)]


def test_percentiles_count_missing_in_n(spark):
    df = spark.createDataFrame([(i, "viewed", float(i) if i else None) for i in range(11)], "k int, group_cat string, x double")
    long = percentile_long(df, {"x": "percentile_x"}, ["k"], ["group_cat"], k=10)
    r = percentile_profile(long, labels={}).first()
    assert (r["n"], r["mean"], r["median"]) == (11, 5.5, 5.5)


def test_joins(spark):
    left = spark.createDataFrame([(1, "c", 5), (2, None, 6), (3, "x", 7)], "i int, k string, v int")
    right = spark.createDataFrame([("c", "one"), (None, "two"), ("c", "three")], "k string, w string")
    assert rows(natural_left_join(left, right), "i", "w") == [(1, "one"), (1, "three"), (2, "two"), (3, None)]
    unique = spark.createDataFrame([("c", "one")], "k string, w string")
    assert rows(attribute_join(left, unique, "k"), "i", "w") == [(1, "one"), (2, None), (3, None)]


def test_progress_and_signups(spark):
    seen = spark.createDataFrame(
        [("u", "c", "v1"), ("u", "c", "v1"), ("u", "c", None), ("w", "c", "v2"), ("w", "c", "v1"), ("u", "d", "z")],
        "learner string, course string, video string",
    )
    out = rows(course_progress(seen, "learner", "course", "video"), "learner", "course", "used", "items", "progress")
    assert out == [("u", "c", 1, 2, 50.0), ("u", "d", 1, 1, 100.0), ("w", "c", 2, 2, 100.0)]
    listed = spark.createDataFrame([("c", 8)], "course string, total int")
    out = rows(course_progress(seen, "learner", "course", "video", listed), "learner", "course", "items", "progress")
    assert out == [("u", "c", 8, 12.5), ("u", "d", 1, 100.0), ("w", "c", 8, 25.0)]
    exposed = spark.createDataFrame([("u", 10), ("w", 10), ("x", 1)], "learner string, at int")
    starts = spark.createDataFrame([("u", 9), ("u", 11), ("u", 12), ("w", 10)], "learner string, started int")
    out = rows(later_signups(exposed, starts, "learner", "at", "started"), "learner", "later_signups")
    assert out == [("u", 2), ("w", 0), ("x", 0)]


def test_report_end_to_end(spark):
    n = 400
    survey = spark.range(n).selectExpr(
        "concat('u', id) AS id_map_hash_id", "concat('org/C', id % 2, '_r', id % 3, '/t') AS enrollment_course_id",
        "CASE WHEN id % 10 = 0 THEN 'Residential' ELSE 'x' END AS group_name", "cast(1 + id % 2 as int) AS group",
        "cast(id % 101 as double) AS likely_complete_1",
        *[f"element_at(array('Not Important', 'Very Important', 'Extremely Important', ''), cast((id + {i}) % 4 as int) + 1) "
          f"AS mrmi_mrmi_{i}" for i in range(1, 11)],
        "'All' AS intent_lecture", "'Some' AS intent_assess", "'frequently' AS forums", "cast(id % 9 as string) AS hours",
        "cast(id % 4 as string) AS oc_comp", "'Always' AS goal_setting", "'Very familiar' AS fam",
    )
    actions = spark.range(n).selectExpr(
        "concat('u', id) AS id_map_hash_id", "concat('org/C', id % 2, '_r', id % 3, '/t') AS enrollment_course_id",
        "CASE WHEN id % 20 = 0 THEN 'Staff' ELSE 'Student' END AS roles", "1 AS viewed",
        "cast(id % 2 = 0 as int) AS explored", "cast(id % 4 = 0 as int) AS completed", "cast(id % 8 = 0 as int) AS certified",
        "CASE WHEN id % 16 = 0 THEN 1 END AS blended", "cast(id as double) AS nevents", "cast(id % 7 as double) AS ndays_act",
        "1.0D AS nplay_video", "2.0D AS npause_video", "cast(id % 5 as double) AS nvideos_total_watched",
        "3.0D AS nchapters", "cast(id % 3 as double) AS nforum_posts", "id / 400 AS grade", "cast(id as double) AS nvideo",
        "ln(id + 1) AS log_nevents", "ln(id + 2) AS log_nvideo", "ln(id % 7 + 1) AS log_ndays_act",
        "CASE WHEN id % 2 = 0 THEN 'US' ELSE 'DE' END AS cc_by_ip",
    )
    survey, actions = prepare(survey, actions)
    assert actions.filter("likely_complete_1 IS NULL").count() > 0
    for name, table in {**survey_tables(survey), **activity_tables(actions)}.items():
        assert table.count() > 0, name
    assert {r[0] for r in actions.select("group_cat").distinct().collect()} == {
        "viewed", "explored", "completed", "certified", "blended"
    }
