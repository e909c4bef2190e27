"""Words and pairs of tiles that are worked on by arrays, against one at a time."""

from __future__ import annotations

import numpy as np

from trialloom.llm import passages
from trialloom.llm.text import TextHashes


def test_words_of_texts():
    texts = [b"", b"one two", b"  two\tthree\n", b"x" * 40 + b" " + b"y" * 32, "é  日本".encode(), b"one"]
    offsets, h = TextHashes().split(texts)
    found = [w for t in texts for w in t.split()]
    assert np.diff(offsets).tolist() == [len(t.split()) for t in texts]
    assert len(h) == len(found) and len(set(h.tolist())) == len(set(found))
    assert len({(w, x) for w, x in zip(found, h.tolist())}) == len(set(found))


def test_compare_is_exact():
    rng, bound, t = np.random.default_rng(4), passages.Bound(46, 80), 46
    xs, ys = [], []
    for k in range(200):
        x = rng.choice(10_000, 46 + k % 30, replace=k % 4 == 0)
        y = x[int(rng.integers(0, 8)) :] if k % 3 else x.copy()
        y = np.concatenate([y, rng.integers(0, 10_000, max(0, 46 - len(y)) + k % 5)])
        y[rng.random(len(y)) < 0.04] = -1
        xs.append(x), ys.append(y)
    side = lambda lists: passages.Side(np.concatenate(lists).astype(np.int64), np.cumsum([0, *map(len, lists)]), t)
    rows, facts = passages.compare(side(xs), side(ys), bound)
    got = {r: (f[0], f[5]) for r, f in zip(rows.tolist(), facts.tolist())}
    expected = {}
    for k, (x, y) in enumerate(zip(xs, ys)):
        a, b = ([set(v[i : i + t].tolist()) for i in range(len(v) - t + 1)] for v in (x, y))
        near = [(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if 100 * len({v for v in p & q if v >= 0}) >= 80 * (len(p) + len(q) - len({v for v in p & q if v >= 0}))]
        if near:
            expected[k] = sum(1 << i for i in {i for i, _ in near}), sum(1 << j for j in {j for _, j in near})
    assert len(expected) > 40 and got == expected
