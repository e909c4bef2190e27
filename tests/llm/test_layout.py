"""Mixing, sharding, the pipeline and the registered queries."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from check import DATA, check, duck
from samples import awkward, empty, prose
from trialloom.llm import mixing, registry, sharding

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def unit(text):
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def brute_targets(sizes, weights, most):
    """Shares by weight; what is above a limit is given to the others again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        unit_share = left / sum(weight[s] for s in free)
        full = {s for s in free if unit_share * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: unit_share * weight[s] for s in free}
        for s in full:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        free -= full
    return target


@pytest.fixture(scope="module")
def mixed_rows():
    rows = []
    for i in range(400):
        source = [None, "a", "b", "c", "d", "é", "zz"][min(6, i % 11)]
        rows.append((i, prose(i, 1 + (i * 37) % 120), "en", source, 0))
    return rows + [(900, None, "en", "a", 0), (901, "", "en", "empty", 0), (901, "", "en", "empty", 0), (902, prose(3, 5000), "en", "b", 0)]


@pytest.mark.parametrize("cells", [4096, 3])
def test_mix(spark, mixed_rows, monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    docs = spark.createDataFrame(mixed_rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and r.taken == r.copies * r.size <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    targets = brute_targets(sizes, (5, 2, 1), 3)
    by = defaultdict(list)
    for r in got:
        assert r.target == pytest.approx(float(targets[r.source])) and r.source_size == sizes[r.source]
        by[r.source].append(r)
    for source, rows in by.items():
        assert abs(taken[source] - float(targets[source])) <= largest[source] / 2 + 1e-6
        # copies follow the expected number, and extra ones go to the lowest Pareto ranks
        expect = brute_expected([r.size for r in rows], float(targets[source]), 3)
        ranks = {True: [], False: []}
        for r, e in zip(rows, expect):
            assert r.copies - math.floor(e) in (0, 1)
            if p := e - math.floor(e):
                u = unit(f"{r.doc_id}:0:{hashlib.md5((r.text or '').encode()).hexdigest()}")
                ranks[r.copies > math.floor(e)].append(u / (1 - u) / (p / (1 - p)))
        assert max(ranks[True], default=0) <= min(ranks[False], default=math.inf)


def brute_expected(sizes, target, most):
    """Expected copies by root of size: the level is searched by halving."""
    if not sum(sizes):
        return [0.0] * len(sizes)
    expected = lambda level: [min(most, level * math.sqrt(max(s, 1))) for s in sizes]
    low, high = 0.0, 3.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(e * s for e, s in zip(expected(middle), sizes)) < target else (low, middle)
    return expected(low)


def test_mix_follows_its_inclusion_probabilities(spark):
    """Documents of 64 words are taken twice as often as those of 16, whatever the draw, and not in the order of u alone."""
    rows = [(i, " ".join(["w"] * (64 if i % 2 else 16)), "a") for i in range(3000)] + [(9000 + i, "x " * 100, "b") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = Counter()
    for seed in range(3):
        got = mixing.mix(docs, weights=(1, 15), share=0.3, seed=seed, most=3).where("source = 'a'").collect()
        for r in got:
            share[r.size] += r.copies / 4500
        e = dict(zip((16, 64), brute_expected([16, 64], got[0].target / 1500, 3)))
        u = lambda r: unit(f"{r.doc_id}:{seed}:{hashlib.md5(r.text.encode()).hexdigest()}")
        assert max(u(r) for r in got if r.copies) > min(u(r) for r in got if not r.copies)
    assert 0 < e[16] < e[64] < 1 and e[64] == pytest.approx(2 * e[16])
    assert share[16] == pytest.approx(e[16], abs=0.03) and share[64] == pytest.approx(e[64], abs=0.03)


def test_mix_awkward(spark):
    docs = awkward(spark)
    got = mixing.mix(docs)
    assert {*docs.columns} - {"size", "copies"} <= {*got.columns}
    assert got.count() == 15
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.repeat_rows(got).count() == sum(r.copies for r in got.collect())
    blank = spark.createDataFrame([(1, None, None, "s"), (2, "", None, None)], "doc_id long, text string, lang string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2


@pytest.mark.parametrize("rows_per_cell", [3, 50_000])
def test_rendezvous(spark, rows_per_cell):
    rows = [(i, prose(i, i % 7), None) for i in range(500)] + [(None, "x", None), (None, "y", None), (7, "", None), (7, "", None), (8, None, None)]
    weights = [1.0, 2.0, 1.0, 4.0]
    got = sharding.rendezvous(spark.createDataFrame(rows, "doc_id long, text string, shard int"), weights, rows_per_cell=rows_per_cell).collect()
    slots = defaultdict(list)
    for r in got:
        key = "null id" if r.doc_id is None else str(r.doc_id)
        bids = [-math.log(unit(f"{key}:{s}")) / w for s, w in enumerate([*weights, 2.0])]
        assert (r.shard, r.grown_shard) == (bids.index(min(bids[:4])), bids.index(min(bids)))
        assert r.grown_shard in (r.shard, 4)
        text = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = len(slots[3]) / len(got)
    assert 0.42 < share < 0.58


def test_rendezvous_awkward(spark, tmp_path):
    docs = awkward(spark)
    clash = docs.select("doc_id", "text", *[F.lit(1).alias(f"__{c}") for c in ("s", "c", "n", "order", "cell", "before", "count", "shard", "its_cell")])
    got = sharding.rendezvous(clash, [1.0] * 3)
    assert got.count() == 15 and {*clash.columns} < {*got.columns}
    got = sharding.rendezvous(docs, [1.0] * 24)
    assert got.count() == 15 and len(set(got.columns)) == len(got.columns)
    assert sharding.rendezvous(empty(spark), [1.0] * 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        sharding.rendezvous(docs, [1.0, 0.0])
    sharding.write_shards(docs, str(tmp_path / "shards"), [1.0] * 5)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 15


ORACLE = registry.ORACLE


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    sf = f"{DATA}/sf0.001"
    problem, rows, _ = check(spark, duck(sf), sf, name, registry.QUERIES[name], ORACLE.get(name))
    assert problem == "" and rows > 0


def test_pipeline(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}
    kept = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept = spark.createDataFrame(out.toPandas(), out.schema)
        counts.append(kept.count())
    rows = kept.collect()
    assert all(start[r.doc_id].text == r.text for r in rows)
    assert counts[0] <= len(start) and counts[1] < counts[0] and counts[2] <= counts[1]
    assert max(Counter(r.doc_id for r in rows).values()) <= 3
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.shard) for r in whole.collect()) == sorted((r.doc_id, r.shard) for r in rows)


def test_pipeline_stages_awkward(spark):
    sf = f"{DATA}/sf0.001"
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= 3 * docs.count(), name
            if stage is not corpus_pipeline.deal_shards:
                assert out.columns == docs.columns


def test_one_row_of_each_group_stays(spark):
    """Null and repeated ids: rows are told apart by themselves, not by their ids."""
    a, b, c, d = (prose(seed, 60) for seed in range(4))
    rows = [(None, a), (None, a), (1, b), (1, b), (2, c), (2, b + " more"), (5, d), (None, None), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, f"{DATA}/sf0.001")
    assert out.columns == docs.columns
    # texts without words resemble nothing
    wanted = [(None, a), (1, b), (2, c), (5, d), (None, None), (None, None), (3, ""), (3, "")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(wanted, key=str)
