"""Jaccard join, decontamination and repeated passages against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from samples import TEXT, awkward, empty, frame, prose

from trialloom.llm import components, decontaminate, ngram_join, passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(5)
    texts = []
    for group in range(6):
        base = prose(group, 150, 3000)
        texts += [edited(base, rng, rng.randrange(0, 9)) for _ in range(25)]
    # a chain: neighbours link, the ends do not
    step = prose(99, 200, 3000)
    for _ in range(12):
        texts.append(step)
        step = edited(step, rng, 3)
    return texts + ["a b c", "A B c", "a b", "a", "", None, "x y z q", TEXT, TEXT.upper()]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_are_exact(spark, near_texts, k, percent):
    report = {}
    got = ngram_join.jaccard_components(frame(spark, near_texts), k, percent, report=report).orderBy("doc_id").collect()
    assert report["order 1"] >= report["order 2"] >= report["order 3"] > 0
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == brute_components(near_texts, k, percent)


def test_every_order_filters(spark):
    """A pair is passed on as far as its prefixes meet, and only what meets under all orders is verified."""
    sets = spark.createDataFrame(
        [(1, [1, 2], [5]), (2, [2], [5, 6]), (3, [2], [7]), (4, [9], [5]), (5, [], [5])], "set_id long, prefix0 array<int>, prefix1 array<int>"
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5)], "a long, b long")
    got = ngram_join._filtered(pairs, sets, "pairs").collect()
    assert {(r.a, r.b): r.passed for r in got} == {(1, 2): 2, (1, 3): 1, (1, 4): 0, (1, 5): 0}


def test_jaccard_leftovers_are_compared(spark, near_texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", 1)  # more is left for the last comparison
    got = ngram_join.jaccard_components(frame(spark, near_texts)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == brute_components(near_texts, 3, 90)


def brute_links(texts, k, percent):
    sets = [frozenset(shingle_set(t, k)) for t in texts]
    near = {x: sum(x != y and 100 * len(x & y) >= percent * len(x | y) for y in set(sets) if x and y) for x in set(sets)}
    return [near[x] for x in sets]


@pytest.mark.parametrize("block", [256, 4])
@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_links_are_all_counted(spark, near_texts, k, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block, raising=False)
    got = ngram_join.jaccard_components(frame(spark, near_texts), k, percent).orderBy("doc_id").collect()
    assert [r.n_links for r in got] == brute_links(near_texts, k, percent)


def test_jaccard_awkward(spark):
    got = ngram_join.jaccard_components(awkward(spark)).collect()
    assert len(got) == 15
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == 0 and by[2].n_shingles == 0 and by[2].component_id == 2 and by[5].n_shingles == 1
    assert by[(1 << 60) + 1].component_id == 0  # one more word in front
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


def test_sketch_bounds_the_overlap(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(200):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 3000))).astype(np.uint64)
        x, y = (np.unique(np.concatenate([base[rng.random(len(base)) < q], rng.integers(0, 1 << 63, int(rng.integers(1, 60))).astype(np.uint64)])) for q in (0.97, (0.95, 0.5)[_ % 2]))
        common = len(np.intersect1d(x, y))
        rows.append((len(x), ngram_join.sketch(x).tolist(), len(y), ngram_join.sketch(y).tolist(), 100 * common >= 80 * (len(x) + len(y) - common)))
    df = spark.createDataFrame(rows, "n int, p array<long>, m int, q array<long>, linked boolean")
    may = ngram_join._may_link("n", "p", "m", "q", 80)
    assert df.where("linked").count() > 20 and df.where("linked").where(~may).count() == 0
    assert df.where(~may).count() > 20


def test_components(spark):
    links = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("q", "q"), ("z", "y"), ("x", "y")]
    got = components.connected(spark.createDataFrame(links, "a string, b string")).collect()
    assert {tuple(r) for r in got} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x"), ("z", "x")}
    assert components.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_masks_lose_nothing():
    window, harmed = decontaminate.WINDOW, decontaminate.WINDOW - decontaminate.MATCHED
    for lost in itertools.combinations(range(window), harmed):
        assert any(
            not set(lost) & {at + k for k in mask} for mask in decontaminate.MASKS for at in range(window - mask[-1])
        ), lost


def brute_overlaps(docs, items):
    out = set()
    for d, text in enumerate(docs):
        w = WORD.findall((text or "").translate(LOWER))
        for i, item in enumerate(items):
            v = WORD.findall((item or "").translate(LOWER))
            lines = []
            for shift in range(-len(v), len(w) + 1):
                eq = [0 <= p + shift < len(w) and w[p + shift] == v[p] for p in range(len(v))]
                lo, hi = max(0, -shift), min(len(v), len(w) - shift)
                if any(sum(eq[s : s + 13]) >= 11 for s in range(lo, hi - 12)):
                    lines.append(sum(eq))
            if lines:
                out.add((d, i, len(lines), max(lines)))
    return out


def test_overlaps_are_exact(spark):
    rng = random.Random(2)
    items = [prose(100 + i, 15 + 3 * i, 500) for i in range(12)] + ["too short", None, ""]
    docs = []
    for i in range(60):
        item = items[i % 12]
        docs.append(" ".join([prose(i, rng.randrange(60), 500), edited(item, rng, rng.randrange(0, 6)), prose(900 + i, rng.randrange(40), 500)]))
    docs += [items[0], items[3].upper(), " ".join(items[5].split()[:12]), " ".join(items[5].split()[:13]), None, "", items[4] + " " + items[4], items[6].replace(" ", "\n")]
    got = decontaminate.overlaps(frame(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_overlaps(docs, items)


def test_decontamination_awkward(spark):
    bench = spark.createDataFrame([(1, TEXT), (None, TEXT), (2, None)], "item_id long, text string")
    got = decontaminate.overlaps(awkward(spark), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (0, 1, None, (1 << 60) + 1) for i in (1, None)}
    left = decontaminate.without_overlaps(awkward(spark), bench)
    assert left.columns == awkward(spark).columns
    assert left.count() == 9  # both rows with id 1, and both with a null id, go together
    assert decontaminate.overlaps(empty(spark), bench).count() == 0
    assert decontaminate.without_overlaps(awkward(spark), bench.limit(0)).count() == 15


def test_compact_windows_hold_every_minimum():
    rng = np.random.default_rng(1)
    for n, t, top in ((1, 1, 5), (7, 3, 3), (60, 8, 12), (200, 46, 10**9), (50, 46, 2)):
        v = rng.integers(0, top, n).astype(np.uint64) << np.uint64(32)
        windows = passages.compact_windows(v, t)
        for a in range(n):
            for b in range(a + t - 1, n):
                c = a + int(np.argmin(v[a : b + 1]))
                assert sum(x <= a and b <= z and a <= y <= b for x, y, z in windows) == 1
                assert any(y == c and x <= a and b <= z for x, y, z in windows)


def test_blocks():
    """Runs of a block are the runs of its texts, and equal windows have equal hashes anywhere."""
    h = np.random.default_rng(3).integers(0, 1 << 63, 300).astype(np.uint64)
    parts = [h, h[:3], h[:0], h[100:200], h[:49], h[:50]]
    offsets = np.cumsum([0, *map(len, parts)])
    block = passages.Block(offsets, np.concatenate(parts), 50)
    prints = block.fingerprints()
    assert (prints[100:151] == prints[303 : 303 + 51]).all()
    assert len(np.unique(prints[:251])) == 251
    alone = [passages.Block(np.array([0, len(p)]), p, 50).bands() for p in parts]
    for band, (first, last, place, key) in enumerate(block.bands()):
        who = block.text_of(first)
        assert sorted(set(who.tolist())) == [0, 3, 5]
        for d in (0, 3, 5):
            own = who == d
            a, b, c, k = alone[d][band]
            assert (first[own] - offsets[d] == a).all() and (last[own] - offsets[d] == b).all()
            assert (place[own] - offsets[d] == c).all() and (key[own] == k).all()
            assert a[0] == 0 and b[-1] == len(parts[d]) - 50 and (a[1:] == b[:-1] + 1).all()


def covered(rows, docs):
    out = {d: set() for d in range(docs)}
    for r in rows:
        out[r.doc_id] |= set(range(r.first_word, r.last_word + 1))
    return out


def test_repeated_passages(spark):
    shared, line = prose(7, 70, 10**5), prose(8, 30, 10**5)
    docs = [" ".join([prose(20 + i, 100, 10**6), shared, prose(60 + i, 90, 10**6)]) for i in range(5)]
    docs += [" ".join([prose(200 + i, 80, 10**6), line, prose(260 + i, 90, 10**6)]) for i in range(20)]  # too short to count
    near = shared.split()
    near[35] = "changed"
    docs += [" ".join([prose(400, 60, 10**6), *near]), prose(500, 120, 10**6), None, "", "short"]
    docs += [prose(500, 120, 10**6)]
    got = passages.repeated_passages(frame(spark, docs)).collect()
    hit = {r.doc_id for r in got} | {r.other_id for r in got}
    assert hit == {0, 1, 2, 3, 4, 25, 26, 30}
    both = covered(got, len(docs))
    for d in (1, 2, 3, 4):
        assert set(range(100, 170)) <= both[d] and len(both[d]) <= 85  # similar windows reach a few words over the edges
    assert any(r.exact for r in got) and any(not r.exact for r in got)
    assert passages.repeated_passages(empty(spark)).count() == 0
    assert {r.doc_id for r in passages.repeated_passages(awkward(spark)).collect()} <= {8, None, 0, 1}


def test_hot_key_loses_no_near_passage(spark):
    """60 pairs of near copies that all share one key; many have no other key in common."""
    pool = prose(1000, 20_000, 10**6).split()
    value = passages.shingles(passages.WordHashes()([w.encode() for w in pool]))
    least = [int(np.argmin(passages.mix(value ^ np.uint64(0x9E3779B97F4A7C15 * (2 * f + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(1))) for f in passages.BANDS[0]]
    line = [w for i in least for w in pool[i : i + passages.SHINGLE]]
    docs = []
    for c in range(60):
        passage = [*prose(2000 + c, 20, 10**6).split(), *line, *prose(3000 + c, 20, 10**6).split()]
        near = [*passage]
        near[10 if c % 2 else 38] = "changed"
        docs += [" ".join([prose(4000 + 4 * c + 2 * i, 40, 10**6), *w, prose(4001 + 4 * c + 2 * i, 40, 10**6)]) for i, w in enumerate((passage, near))]
    got = passages.repeated_passages(frame(spark, docs)).collect()
    assert {tuple(sorted((r.doc_id, r.other_id))) for r in got} == {(2 * c, 2 * c + 1) for c in range(60)}


def brute_passages(texts, width=50, percent=80):
    """(text, first word, last word, class) of all passages, by comparing every window with all of the other texts."""
    t, lists = width - 4, [WORD.findall((x or "").translate(LOWER)) for x in texts]
    windows = [(d, s, frozenset(tuple(w[p : p + 5]) for p in range(s, s + t))) for d, w in enumerate(lists) for s in range(len(w) - width + 1)]
    number = {x: k for k, x in enumerate(sorted({x for _, _, xs in windows for x in xs}))}
    has = np.zeros((len(windows), len(number)), dtype=np.float32)
    for i, (_, _, xs) in enumerate(windows):
        has[i, [number[x] for x in xs]] = 1
    size, own = has.sum(1), np.array([d for d, _, _ in windows])
    both = has @ has.T
    near = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (own[:, None] != own[None, :])
    found, of = [], {}
    for i in np.flatnonzero(near.any(1)).tolist():
        d, s, _ = windows[i]
        if found and found[-1][0] == d and s - found[-1][2] < width:
            found[-1][2] = s
        else:
            found.append([d, s, s])
        of[i] = len(found) - 1
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        a, b = sorted((find(of[i]), find(of[j])))
        root[b] = a
    return {(d, a, b + width - 1, *found[find(k)][:2]) for k, (d, a, b) in enumerate(found)}


def linked_words(texts, d, first, e, other, percent=80):
    x, y = (shingle_set(" ".join(WORD.findall(texts[k].translate(LOWER))[s : s + 50]), 5) for k, s in ((d, first), (e, other)))
    return 100 * len(x & y) >= percent * len(x | y)


def changed(words, rng):
    """One to three changes: words replaced, put in, left out, or two halves in the other order."""
    w = list(words)
    for _ in range(rng.randrange(1, 4)):
        at, kind = rng.randrange(len(w)), rng.randrange(8)
        if kind < 4:
            w[at] = f"new{rng.randrange(10**6)}"
        elif kind < 6:
            w.insert(at, f"new{rng.randrange(10**6)}")
        elif kind < 7:
            del w[at]
        else:
            w = w[at:] + w[:at]
    return w


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_are_exact(spark, seed):
    """All passages and classes, of texts with changed copies, chains, joined passages, repeats and copies of one text."""
    rng = random.Random(seed)
    pool = [prose(700 + 10 * seed + k, rng.choice([50, 52, 58, 70]), 10**5).split() for k in range(8)]
    pool += [("again and again it says so " * 12).split()[: rng.choice([50, 60])], [*prose(800 + seed, 30, 10**5).split()] * 2, ["same"] * 60]
    texts = []
    for k in range(70):
        parts = [prose(9000 + 100 * seed + k, rng.randrange(25), 10**6).split()]
        for _ in range(rng.randrange(1, 3)):
            line = rng.choice(pool)
            parts += [changed(line, rng) if rng.random() < 0.7 else line, prose(20_000 + rng.randrange(10**6), rng.randrange(25), 10**6).split()]
        texts.append(" ".join(w for p in parts for w in p))
    step = prose(600 + seed, 55, 10**5).split()
    for _ in range(10):  # neighbours are linked, the ends are not
        texts.append(" ".join(step))
        step = changed(step, rng)
    twice = " ".join(prose(500 + seed, 60, 10**5) for _ in range(2))  # equal to itself only
    texts += [twice, None, "", "short", texts[3], texts[3].upper(), texts[5]]
    got = passages.repeated_passages(frame(spark, texts)).collect()
    expected = brute_passages(texts)
    assert len(expected) > 40 and len({x[3:] for x in expected}) > 5
    assert len(got) == len(expected)
    assert {(r.doc_id, r.first_word, r.last_word, r.class_id, r.class_word) for r in got} == expected
    for r in got:
        assert r.doc_id != r.other_id and linked_words(texts, r.doc_id, r.first_word, r.other_id, r.other_word)
        mine, other = (WORD.findall(texts[d].translate(LOWER))[s : s + 50] for d, s in ((r.doc_id, r.first_word), (r.other_id, r.other_word)))
        assert r.exact == (mine == other) or not r.exact
