"""Phrases against a count of every n-gram in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import awkward, empty
from trialloom.llm import collocations
from trialloom.llm.collocations import Packing

PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_words, min_count, inside, top):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(UPPER)):
            w = WORD.findall(piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= min_count}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        longer = [b for (o, q), b in found.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= inside * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((score, a, " ".join(p), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted(
        (lang, i + 1, phrase, a, left, right, n[lang], score)
        for lang, rows in out.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows, key=lambda r: (-r[0], -r[1], r[2].encode()))[:top])
    )


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "a\x01", "a", "x-y", "\x85"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(300):
        parts = rng.choices(words, weights, k=rng.randrange(0, 60))
        if i % 3 == 0:
            parts += ["New", "york", "City", rng.choice(["hall", "park", "."])] * 2
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "; "] if rng.random() < 0.2 else [" "]) for w in parts)
        rows.append((["en", "de", None, "und", "en"][i % 5], text))
    return rows + [("en", None), (None, ""), ("xx", " . "), ("yy", "solo")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "lang string, text string").repartition(7)


@pytest.mark.parametrize(
    "options,memory",
    [
        ((3, 10, 50, 2000), {}),
        ((3, 4, 100, 25), {"CHUNK_WORDS": 150, "HELD_WORDS": 300}),
        ((5, 3, 60, 40), {"CHUNK_WORDS": 400, "BUCKET_ENTRIES": 20, "ROUND_BUCKETS": 8, "NUMBER_RANGES": 3}),
        ((2, 2, 50, 10**6), {"BUCKET_ENTRIES": 500}),
    ],
)
def test_collocations(docs, monkeypatch, options, memory):
    for name, value in memory.items():
        monkeypatch.setattr(collocations, name, value)
    got = sorted(map(tuple, collocations.collocations(docs, *options).collect()))
    assert got == brute(corpus(), *options)
    assert got


def test_awkward(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    rows = collocations.collocations(awkward(spark), min_count=2).collect()
    assert {r.lang for r in rows} == {"und"}
    assert {(r.phrase, r.a, r.l, r.r) for r in rows if r.phrase.startswith("same")} == {("same same same", 2998, 3000, 2999)}


@pytest.mark.parametrize("size,bits", [(2, 1), (2, 7), (3, 17), (3, 21), (3, 33), (5, 25), (2, 40), (4, 31)])
def test_filters_lose_nothing(size, bits):
    rng = np.random.default_rng(size * bits)
    p = Packing(size, bits)
    numbers = [rng.integers(0, 1 << bits, 5000) for _ in range(size)]
    high, low = p.pack(numbers)
    assert all((a == b).all() for a, b in zip(p.unpack(high, low), numbers))
    wanted = Counter(zip(*(x.tolist() for x in numbers)))
    weight = rng.integers(1, 4, 5000) ** 9
    for bucket_bits in (0, 3, 6):
        blobs = {}
        for part in np.array_split(rng.permutation(5000), 3):
            found = collocations.counted(high[part], low[part], weight[part])
            for b, f in collocations.by_bucket(*found, p.total, bucket_bits):
                blobs.setdefault(b, []).append(f)
        total = Counter()
        for b, parts in blobs.items():
            h, lo, c = collocations.merge_filters(parts, p.total, bucket_bits, b)
            total.update(dict(zip(zip(*(x.tolist() for x in p.unpack(h, lo))), c.tolist())))
        sums = Counter()
        for key, w in zip(zip(*(x.tolist() for x in numbers)), weight.tolist()):
            sums[key] += w
        assert total == sums and len(wanted) == len(total)


def test_filters_are_small():
    rng = np.random.default_rng(1)
    p = Packing(3, 20)
    found = collocations.counted(*p.pack([rng.integers(0, 1 << 20, 100_000) for _ in range(3)]), np.ones(100_000, np.int64))
    assert len(collocations.make_filter(*found, p.total, 0)) < 6.5 * 100_000  # 7.5 bytes as packed numbers alone
    with pytest.raises(ValueError):
        Packing(5, 30)


def test_score_is_exact(spark):
    rng = random.Random(2)
    rows = [(a := rng.randrange(10, 10**12), rng.randrange(a, 10**13), rng.randrange(a, 10**13)) for _ in range(300)]
    rows += [(k, k, k * m) for k in (10, 10**6, 10**12) for m in (1, 3, 7, 10**6)]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", collocations.exact_score("a", "l", "r"))
    assert dict(df.dtypes)["s"] == "bigint"
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in df.collect())
    assert df.select(F.max("s")).first()[0] == 10**6
