from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trialloom.operators import ranks
from trialloom.operators.ranks import exact_median, tile, with_ntile, with_rank


def md5(*parts):
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


def expected_tiles(rows, k, legacy=False):
    """Plain tile numbers of (id, value) rows, ties by hash."""
    known = sorted((v, md5(i), i) for i, v in rows if v is not None)
    n, out = len(known), {i: None for i, v in rows if v is None}
    q, r = divmod(n, k)
    for rank, (_, _, i) in enumerate(known, start=1):
        if legacy:
            out[i] = k * (rank - 1) // n + 1
        elif rank <= r * (q + 1):
            out[i] = (rank - 1) // (q + 1) + 1
        else:
            out[i] = r + (rank - r * (q + 1) - 1) // q + 1
    return out


def skewed(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        u = rng.random()
        value = 0.0 if u < 0.4 else None if u < 0.45 else rng.choice([rng.gauss(0, 1), rng.expovariate(0.1)])
        rows.append((i, value))
    return rows


@pytest.mark.parametrize("legacy", [False, True])
@pytest.mark.parametrize("k", [3, 100])
@pytest.mark.parametrize("rows_per_cell", [50, 10_000])
def test_ntile_with_heavy_value(spark, k, rows_per_cell, legacy):
    rows = skewed(2_000)
    df = spark.createDataFrame(rows, "i int, x double").repartition(4)
    out = with_ntile(df, "x", k, ["i"], legacy=legacy, rows_per_cell=rows_per_cell)
    assert {r["i"]: r["tile"] for r in out.collect()} == expected_tiles(rows, k, legacy)


@pytest.mark.parametrize("fan,rows_per_cell", [(2, 60), (4, 30), (256, 20)])
def test_cells_stay_small_at_any_size(spark, monkeypatch, fan, rows_per_cell):
    """Several levels of limits; no cell, and no block of offsets, grows with the table."""
    monkeypatch.setattr(ranks, "FAN", fan)
    monkeypatch.setattr(ranks, "RANGES_PER_BLOCK", 3)
    for n in (700, 4_000):
        rows = skewed(n, seed=4)
        df = spark.createDataFrame(rows, "i int, x double").repartition(4)
        out = with_ntile(df, "x", 100, ["i"], rows_per_cell=rows_per_cell)
        assert {r["i"]: r["tile"] for r in out.collect()} == expected_tiles(rows, 100)
        known = df.filter("x is not null").withColumn("_tie", F.md5(F.col("i").cast("string")))
        cells = ranks._place(known, [], "x", "_tie", rows_per_cell, F.count(F.lit(1)))
        sizes = [r["count"] for r in cells.rows.groupBy("_cell", "_sub").count().collect()]
        # tie ranges are even up to chance
        assert max(sizes) <= 2 * rows_per_cell and cells.depth >= 1


def test_signed_zero_nan_and_infinity(spark):
    special = [0.0, -0.0, float("inf"), float("-inf"), float("nan")]
    rows = [(i, special[i % 5] if i % 3 else float(i % 11) - 5) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, x double").repartition(3)
    out = {r["i"]: r["rank"] for r in with_rank(df, "x", ["i"], rows_per_cell=60).collect()}
    order = sorted(rows, key=lambda r: (r[1] != r[1], 0.0 if r[1] != r[1] else r[1] + 0.0, md5(r[0])))
    assert out == {i: k for k, (i, _) in enumerate(order, start=1)}


def test_more_tiles_than_rows(spark):
    rows = [(1, 5.0), (2, 1.0), (3, None)]
    df = spark.createDataFrame(rows, "i int, x double")
    assert {r["i"]: r["tile"] for r in with_ntile(df, "x", 10, ["i"]).collect()} == {1: 2, 2: 1, 3: None}


def test_groups_hot_cold_and_null(spark):
    rng = random.Random(3)
    groups = ["hot"] * 1200 + ["warm"] * 90 + [None] * 300 + ["one"]
    rows = [(i, g, float(rng.randrange(40))) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "i int, g string, x double")
    out = {r["i"]: r["tile"] for r in with_ntile(df, "x", 7, ["i"], ["g"], rows_per_cell=100).collect()}
    for g in ("hot", "warm", None, "one"):
        part = [(i, x) for i, h, x in rows if h == g]
        want = expected_tiles(part, 7)
        assert {i: out[i] for i, _ in part} == want


def test_hash_rank_is_a_permutation(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(700)], "i int, g int")
    out = with_rank(df, None, ["i"], ["g"], rows_per_cell=20, seed=5).collect()
    for g in (0, 1):
        mine = sorted((md5(5, i), i) for i in range(700) if i % 2 == g)
        assert {r["i"]: r["rank"] for r in out if r["g"] == g} == {i: k for k, (_, i) in enumerate(mine, start=1)}
        assert {r["total"] for r in out if r["g"] == g} == {350}


def test_no_single_partition_exchange_over_rows(spark):
    df = spark.range(0, 5_000, 1, 4).selectExpr("id", "cast(id % 97 as double) as x")
    ranked = with_rank(df, "x", ["id"], rows_per_cell=500)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    rows_side = [line for line in plan.splitlines() if "SinglePartition" in line]
    # the only single-task step is the running sum over cell sizes
    assert len(rows_side) <= 1
    assert ranked.count() == 5_000


@pytest.mark.parametrize("rows_per_cell", [40, 10_000])
def test_exact_median(spark, rows_per_cell):
    rng = random.Random(9)
    rows = [("big", None if rng.random() < 0.1 else float(rng.choice([0, 0, 0, 7, rng.random() * 50]))) for _ in range(901)]
    rows += [("even", float(i)) for i in range(80)] + [("one", 3.5), ("none", None), (None, 1.0), (None, 2.0)]
    rows += [("flat", 2.0)] * 300
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    out = {r["g"]: r["median"] for r in exact_median(df, "x", ["g"], rows_per_cell).collect()}
    for g in {g for g, _ in rows} - {"none"}:
        xs = sorted(x for h, x in rows if h == g and x is not None)
        mid = len(xs) // 2
        want = xs[mid] if len(xs) % 2 else (xs[mid - 1] + xs[mid]) / 2
        assert out[g] == want
    assert "none" not in out
    whole = sorted(x for _, x in rows if x is not None)
    mid = len(whole) // 2
    want = whole[mid] if len(whole) % 2 else (whole[mid - 1] + whole[mid]) / 2
    assert exact_median(df, "x", rows_per_cell=rows_per_cell).first()["median"] == want


def test_tile_formula_matches_sql(spark):
    df = spark.range(1, 238).selectExpr("id as rank", "237 as total")
    got = {r["rank"]: r["t"] for r in df.withColumn("t", tile(10)).collect()}
    df.createOrReplaceTempView("r")
    want = {r["rank"]: r["t"] for r in spark.sql("SELECT rank, ntile(10) OVER (ORDER BY rank) AS t FROM r").collect()}
    assert got == want
