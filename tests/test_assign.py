from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trialloom.operators.assign import (
    decode_factors, even_randomizer, mask_where, permuted_blocks, remove_counterfactual, strata_bins,
    with_service_override,
)
from trialloom.operators.balance import adjust_p, balance_table, proportion_statistic, proportion_test
from trialloom.operators.checks import unseen_answers


def test_blocks_hold_every_arm_once(spark):
    sizes = {"a": 600, "b": 7, "c": 3, "d": 6, "e": 1}
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, strata string")
    for rows_per_cell in (50, 100_000):
        out = permuted_blocks(df, "strata", ["id"], rows_per_cell=rows_per_cell).collect()
        assert len(out) == len(rows)
        blocks = defaultdict(list)
        for r in out:
            blocks[r["strata"], r["c"]].append(r["cond"])
        for s, n in sizes.items():
            mine = [sorted(arms) for (t, _), arms in blocks.items() if t == s]
            full = [arms for arms in mine if len(arms) == 6]
            short = [arms for arms in mine if len(arms) < 6]
            assert len(full) == n // 6 and all(arms == [1, 2, 3, 4, 5, 6] for arms in full)
            assert [len(a) for a in short] == ([n % 6] if n % 6 else [])
            assert all(len(set(a)) == len(a) for a in short)


def test_assignment_is_reproducible_and_seeded(spark):
    df = spark.range(0, 300).selectExpr("id", "cast(id % 4 as string) as strata")
    first = {r["id"]: r["cond"] for r in permuted_blocks(df, "strata", ["id"]).collect()}
    again = {r["id"]: r["cond"] for r in permuted_blocks(df.repartition(7), "strata", ["id"], rows_per_cell=9).collect()}
    other = {r["id"]: r["cond"] for r in permuted_blocks(df, "strata", ["id"], seed=1).collect()}
    assert first == again and first != other


def test_factor_decoding(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 7)], "cond int")
    rows = decode_factors(df).orderBy("cond").collect()
    assert [(r["affirm"], r["plans"]) for r in rows] == [(0, 1), (0, 2), (0, 0), (1, 1), (1, 2), (1, 0)]
    assert [r["plans_any"] for r in rows] == [1, 1, 0, 1, 1, 0]


def test_strata_bins(spark):
    df = spark.createDataFrame(
        [(3, 6, 4, 3), (2, 5, 3, 4), (1, 0, 0, 5), (None, 1, 1, None)], "intent_assess int, hours int, crs_finish int, educ int"
    )
    assert [r["strata"] for r in strata_bins(df).collect()] == ["1 1 2 2", "0 0 1 1", "0 0 0 0", "NA 0 1 NA"]


def test_even_randomizer_counts(spark):
    df = spark.range(0, 1001)
    for size in (60, 100_000):
        out = even_randomizer(df, ["id"], 3, "arm", 4, size)
        counts = sorted(r["count"] for r in out.groupBy("arm").count().collect())
        assert counts == [333, 334, 334]


def test_service_override(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 1, 0), (None, 1, 0), (1, None, 0)], "ok int, service int, own int")
    out = with_service_override(df, {"arm": "service"}, {"arm": "own"}, "ok")
    assert [r["arm"] for r in out.collect()] == [1, 0, 0, 0]


def test_masking(spark):
    df = spark.createDataFrame(
        [(0, 2, 1, 1, 1), (1, 1, 1, 1, 1), (None, 0, 1, 1, 1)],
        "affirm int, plans int, affirm_values_1 int, longplans_time_3 int, shortplans_time_3 int",
    )
    out = [tuple(r)[2:] for r in remove_counterfactual(df).collect()]
    assert out == [(None, 1, None), (1, None, 1), (1, None, None)]
    assert mask_where(df, "^none$", F.lit(True)).collect() == df.collect()


def test_unseen_answers(spark):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (None, "x"), (0, None)], "affirm int, essay string")
    out = unseen_answers(df, {"unseen": (["essay"], F.col("affirm") == 1)}).collect()
    assert [r["unseen"] for r in out] == [True, False, True, False]


def test_proportion_test_against_known_values(spark):
    df = spark.createDataFrame([(15, 25, 0.5), (50, 100, 0.5), (0, 4, 0.5)], "x int, n int, p double")
    rows = df.select(
        proportion_statistic("x", "n", 0.5).alias("s"), F.round(proportion_test("x", "n", 0.5), 4).alias("p")
    ).collect()
    # 15 of 25: (|15 - 12.5| - 0.5)^2 / 6.25 = 0.64, p = 0.4237
    assert [(round(r["s"], 6), r["p"]) for r in rows] == [(0.64, 0.4237), (0.0, 1.0), (2.25, 0.1336)]


def test_balance_table_with_missing_arm(spark):
    df = spark.createDataFrame([("s", 1), ("s", 0), ("t", 1), ("t", None)], "stratum string, affirm int")
    rows = {r["stratum"]: r for r in balance_table(df, ["stratum"], {"affirm": 0.5}).collect()}
    assert rows["s"]["share"] == 0.5 and rows["s"]["p_value"] == 1.0
    assert rows["t"]["share"] is None and rows["t"]["p_value"] is None


def test_multiplicity(spark):
    ps = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.005, "e": None}
    df = spark.createDataFrame(list(ps.items()), "t string, p_value double")
    out = {r["t"]: r for r in adjust_p(df, tie_break=["t"]).collect()}
    near = lambda c: {t: None if out[t][c] is None else round(out[t][c], 6) for t in ps}
    assert near("p_bonferroni") == {"a": 0.04, "b": 0.16, "c": 0.12, "d": 0.02, "e": None}
    assert near("p_holm") == {"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.02, "e": None}
    assert near("p_bh") == {"a": 0.02, "b": 0.04, "c": 0.04, "d": 0.02, "e": None}


def test_arm_counts_even_over_strata(spark):
    df = spark.range(0, 1200).selectExpr("id", "cast(id % 2 as string) as strata")
    counts = Counter(r["cond"] for r in permuted_blocks(df, "strata", ["id"], rows_per_cell=100).collect())
    assert set(counts.values()) == {200}


@pytest.mark.parametrize("rows_per_cell", [40, 100_000])
def test_adjusted_p_of_large_families(spark, rows_per_cell):
    """A scan over many ranges gives what one pass over the sorted family gives."""
    rng = random.Random(8)
    rows = [(i, "a" if i % 3 else None, None if i % 11 == 0 else rng.choice([rng.random() ** 4, 0.001, 0.5])) for i in range(1500)]
    df = spark.createDataFrame(rows, "t int, family string, p double").repartition(4)
    out = {r.t: r for r in adjust_p(df, "p", ["family"], ["t"], rows_per_cell).collect()}
    for family in ("a", None):
        known = sorted((p, t) for t, f, p in rows if f == family and p is not None)
        m, high, low, holm, bh = len(known), 0.0, 1.0, {}, {}
        for i, (p, t) in enumerate(known, start=1):
            holm[t] = high = max(high, min(1.0, (m - i + 1) * p))
        for i, (p, t) in reversed(list(enumerate(known, start=1))):
            bh[t] = low = min(low, 1.0, m / i * p)
        for p, t in known:
            assert (out[t].p_holm, out[t].p_bh, out[t].p_bonferroni) == (holm[t], pytest.approx(bh[t]), min(1.0, m * p))
    assert all(out[t].p_holm is out[t].p_bh is out[t].p_bonferroni is None for t, _, p in rows if p is None)
