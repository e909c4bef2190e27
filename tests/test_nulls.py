from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions.nulls import (
    case_when, clamp, flag, if_else, join_same, level_name, lookup, member, ordinal, proportion, row_mean, strict_mean,
)
from trialloom.functions.scalars import (
    age_from_birth_year, course_of_run, cut, detect, int_div, modulo, paste, reverse_code, round_even, to_number, token,
)


def values(df, *cols):
    row = df.select(*cols).first()
    return tuple(row)


def test_strict_and_skipping_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "g string, x double")
    out = {
        r["g"]: (r["s"], r["m"], r["p"])
        for r in df.groupBy("g")
        .agg(strict_mean("x").alias("s"), F.avg("x").alias("m"), proportion(F.col("x") > 2).alias("p"))
        .collect()
    }
    assert out == {"a": (None, 1.0, None), "b": (3.0, 3.0, 0.5), "c": (None, None, None)}


def test_membership_and_conditionals_on_null(spark):
    df = spark.createDataFrame([(None, None)], "x int, s string")
    out = values(
        df,
        member("x", [1, 2]),
        member("s", ["a"]),
        if_else(F.col("x") > 1, 1, 0),
        case_when((F.col("x") > 1, F.lit(1)), (F.col("x") <= 1, F.lit(0))),
        flag(F.col("x") == 1),
        clamp("x", 0, 1),
        ordinal("s", ["a", "b"]),
        lookup("x", {1: "one"}),
    )
    assert out == (False, False, None, None, None, None, None, None)


def test_levels(spark):
    df = spark.createDataFrame([("b", 2), ("z", 9)], "s string, i int")
    rows = df.select(ordinal("s", ["a", "b"]).alias("o"), level_name("i", ["a", "b"]).alias("n")).collect()
    assert [tuple(r) for r in rows] == [(2, "b"), (None, None)]


def test_row_mean_needs_all(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(row_mean("a", "b")).collect()] == [2.0, None]


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "i int, k string")
    right = spark.createDataFrame([(None, "n"), ("a", "x"), ("a", "y")], "k string, v string")
    out = sorted((r["i"], r["v"]) for r in join_same(left, right, ["k"]).collect())
    assert out == [(1, "n"), (2, "x"), (2, "y"), (3, None)]
    same = left.select("k").distinct()
    assert join_same(left, same, ["k"]).count() == 3


def test_scalars(spark):
    df = spark.createDataFrame(
        [("org/MIT_run1/2016", "7 h", None, 0.55, 1.0, -1)], "run string, h string, n string, b double, lo double, i int"
    )
    out = values(
        df,
        course_of_run("run"),
        token("run", 3, "/"),
        token("run", 9, "/"),
        to_number("h"),
        detect("h", "[0-9]"),
        paste("run", "n", sep="|"),
        cut("b", (0, 0.55, 0.7), ("low", "medium")),
        cut("lo", (0, 0.55, 0.7), ("low", "medium")),
        modulo("i", 3),
        int_div("i", 3),
        reverse_code("i"),
        age_from_birth_year(F.lit(1980)),
        round_even(F.lit(2.5)),
    )
    assert out == (
        "MIT", "2016", None, None, True, "org/MIT_run1/2016|NA", "low", None, 2, -1, 11, 37, 2.0
    )
    plain = spark.createDataFrame([("org/C1/t",), ("nothing",)], "run string")
    assert [r[0] for r in plain.select(course_of_run("run")).collect()] == ["C1", None]
