"""Periodic runs against a search by the definition."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import awkward, awkward_rows, empty, frame, prose
from trialloom.llm import runs
from trialloom.llm.text import words


def brute(seq):
    """All (start, length, smallest period) of maximal stretches with length >= max(6, 4 q)."""
    found, n = {}, len(seq)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, k, q) for (s, k), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(5)
    for _ in range(400):
        yield [rng.randrange(2) for _ in range(rng.randrange(0, 80))]
    for _ in range(300):
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        yield [rng.randrange(3) for _ in range(rng.randrange(9))] + (unit * 9)[: rng.randrange(1, 9 * len(unit))] + [rng.randrange(3) for _ in range(rng.randrange(9))]
    for q in range(1, 40):  # the shortest run of each period at every offset of the blocks
        for pad in range(0, 40, 3):
            yield [100 + i for i in range(pad)] + [i % q for i in range(max(6, 4 * q))] + [200 + i for i in range(pad % 5)]
    yield [0] * 3000
    yield [i % 700 for i in range(2900)] + [0] * 9


@pytest.mark.parametrize("together", [1, 1 << 17])
def test_runs(monkeypatch, together):
    monkeypatch.setattr(runs, "SEARCH_WORDS", together)
    seqs = list(sequences())
    got = runs.search([" ".join(map(str, s)) for s in seqs])
    for seq, found, best, text in zip(seqs, got["runs"].to_pylist(), got["best"], got["collapsed"]):
        wanted = brute(seq)
        assert [(r["start"], r["length"], r["period"]) for r in found] == wanted
        order = sorted(range(len(wanted)), key=lambda i: (-Fraction(wanted[i][1], wanted[i][2]), wanted[i][0], wanted[i][2]))
        assert best == (order[0] if order else None)
        drop = {i for s, k, q in wanted for i in range(s + q, s + k)}
        assert text == " ".join(str(w) for i, w in enumerate(seq) if i not in drop)


def test_successor():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 64, 200):
        values = rng.permutation(n)
        tree = runs.WaveletTree(values)
        lo = rng.integers(0, n + 1, 300)
        hi = np.minimum(n, lo + rng.integers(0, n + 1, 300))
        x = rng.integers(0, n, 300)
        wanted = [min((v for v in values[a:b] if v >= c), default=-1) for a, b, c in zip(lo, hi, x)]
        assert tree.successor(lo, hi, x).tolist() == wanted


def test_names():
    rng = np.random.default_rng(3)
    symbols = np.concatenate([rng.integers(0, 3, 300), [9]])
    for k, name in enumerate(runs.block_names(symbols)):
        blocks = [tuple(symbols[i : i + 2**k]) for i in range(len(symbols))]
        order = sorted(blocks)
        assert name.tolist() == [order.index(b) for b in blocks]


def planted(doc_id, text):
    """The words of a document as the contract of the query changes them."""
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_digests(spark):
    rows = [(i, prose(i, i % 90, 40)) for i in range(300)] + [(r[0], r[1]) for r in awkward_rows()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    changed = docs.select("doc_id", runs.with_repeated_tail(F.col("doc_id"), F.col("text"), words("text")).alias("text"))
    got = sorted(map(tuple, runs.digests(runs.periodic_runs(changed)).collect()), key=str)
    wanted = []
    for i, text in rows:
        w = planted(i, text)
        found = brute(w) if len(w) < 3000 or len(set(w)) == 1 else []
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
        drop = {j for s, k, q in found for j in range(s + q, s + k)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        kept = " ".join(x.decode() for j, x in enumerate(w) if j not in drop)
        wanted.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept)))
    assert got == sorted(wanted, key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_awkward(spark):
    assert runs.periodic_runs(awkward(spark)).count() == len(awkward_rows())
    assert runs.digests(runs.periodic_runs(empty(spark))).count() == 0
    same = runs.periodic_runs(frame(spark, ["x " * 6, "x " * 5, "a b " * 4, "a b " * 3 + "a"])).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r.runs] for r in same] == [[(0, 6, 1)], [], [(0, 8, 2)], []]
    assert [r.collapsed for r in same] == ["x", "x x x x x", "a b", "a b a b a b a"]
    with pytest.raises(ValueError):
        runs.find_runs(np.arange(3), min_exponent=2)
