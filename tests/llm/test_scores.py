"""Scores learned from labels or from the corpus, and the statistics of single texts."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from samples import awkward, empty, frame, labels, prose

from trialloom.llm import kneser_ney, quality, rules, secrets, toxicity
from trialloom.llm.text import WordHashes, held_out, lower_words, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def labelled(spark):
    """Junk and insults among clean texts, with labels for most of them."""
    rng = random.Random(4)
    texts, marks = [], []
    for i in range(600):
        w = prose(i, 80, 300).split()
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            w = [x + "%%%" for x in w] if i % 2 else [w[k // 8] for k in range(80)]
        if toxic:
            for _ in range(4):
                w[rng.randrange(80)] = rng.choice(["idiot", "m0ron,", "l0wend" + w[0], "Lowend" + w[1]])
        texts.append(" ".join(w))
        marks.append((i, int(not bad), int(toxic)))
    return frame(spark, texts), labels(spark, marks[:560]), marks


def accuracy(rows, marks, at):
    return np.mean([r.predicted == marks[r.doc_id][at] for r in rows if r.held_out])


def test_held_out(spark):
    got = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "d long").select("d", held_out("d").alias("h")).collect()
    assert all(r.h == (r.d is None or zlib.crc32(str(r.d).encode()) % 5 == 0) for r in got)


def test_words(spark):
    texts = ["A b\x0bC\x1cd \x85 e", "", None, " x ", "a b c É"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(words("t", lower=True).alias("w")).collect()
    for t, r in zip(texts, got):
        assert [w.encode() for w in r.w] == lower_words(t)
        assert len(r.w) == len(WORD.findall(t or ""))


def test_toxicity(spark, labelled):
    docs, known, marks = labelled
    lexicon = toxicity.fit_lexicon(docs, known)
    assert any(e.startswith(" iowend"[:5]) for e in lexicon.weights)
    assert accuracy(toxicity.score_documents(docs, lexicon).collect(), marks, 2) > 0.97


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): 3.0, toxicity.fold("trash"): 3.0})
    a = lexicon.automaton()
    for text in ("IDIOT", "1d10t", "іdiоt", "ïdïöt!", "you (idiot)", "ｉdiot"):
        assert toxicity.weigh(text, a)[0] == 3.0, text
    assert toxicity.weigh("the trash can is full", a)[0] == 0.0
    assert toxicity.weigh("trash, and the trash can", a)[0] == 3.0
    assert toxicity.weigh("idiotic", a)[0] == 0.0 and toxicity.weigh(None, a) == (0.0, 0)
    assert toxicity.weigh("", toxicity.Lexicon({}, ()).automaton()) == (0.0, 0)


def test_quality(spark, labelled):
    docs, known, marks = labelled
    model = quality.fit_neighbours(docs, known)
    assert accuracy(quality.score_documents(docs, model).collect(), marks, 1) > 0.95


def test_votes():
    """Blocked products against one product per pair."""
    rng = np.random.default_rng(1)
    vectors, latent = (rng.standard_normal((n, 6)).astype(np.float32) for n in (300, 70))
    vectors, latent = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (vectors, latent))
    y = rng.integers(0, 2, 300).astype(float)
    model = quality.Neighbours(np.zeros((1, 6)), vectors, y, np.where(y == 1, 0.7, 1.6), 0.5)
    for x, got in zip(latent, model.vote(latent)):
        cosine = np.array([x @ v for v in model.vectors])
        near = np.argsort(-cosine)[: model.nearest]
        w = np.maximum(cosine[near], 0).astype(float) ** model.power * model.votes[near]
        assert got == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-4)


def test_models_without_labels(spark):
    for known in (labels(spark), labels(spark, [(0, None, None), (None, 1, 1), (1, 1, 0)])):
        docs = awkward(spark)
        got = toxicity.score_documents(docs, toxicity.fit_lexicon(docs, known)).collect()
        assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
        got = quality.score_documents(docs, quality.fit_neighbours(docs, known)).collect()
        assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
        assert rules.apply_rules(docs, known).count() == 15
    none = empty(spark)
    assert toxicity.score_documents(none, toxicity.fit_lexicon(none, labels(spark))).count() == 0
    assert quality.score_documents(none, quality.fit_neighbours(none, labels(spark))).count() == 0
    assert rules.apply_rules(none, labels(spark)).count() == 0


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rule_statistics():
    rng = random.Random(8)
    texts = ["", None, "a", "a b c", "a b c a b c", "x\nx\n\n \nx y\nx y", "é|# é|#\n"]
    texts += ["".join(rng.choice("ab  \n\t#é") for _ in range(rng.randrange(200))) for _ in range(200)]
    for t in texts:
        assert rules.measure(t)[:5] == brute_statistics(t), t


def test_rules(spark, labelled):
    docs, known, marks = labelled
    got = rules.apply_rules(docs, known, lost=0.01).collect()
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [r.kept for r in got if marks[r.doc_id][1]]
    bad = [r.kept for r in got if not marks[r.doc_id][1]]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_forest_paths():
    x = np.random.default_rng(5).standard_normal((500, 3))
    forest = rules.grow(x, trees=40, sample=64)

    def path(tree, row, node=0):
        feature, split, left, length = tree
        if feature[node] < 0:
            return length[node]
        return path(tree, row, left[node] + (row[feature[node]] >= split[node]))

    for row, got in zip(x[:20], forest.anomaly(x[:20])):
        mean = np.mean([path(t, row) for t in forest.trees])
        assert got == pytest.approx(2 ** (-mean / rules.expected_path(64)))
    assert forest.anomaly(np.array([[9.0, 9.0, 9.0]]))[0] > forest.anomaly(np.zeros((1, 3)))[0]


def brute_model(train):
    """Interpolated modified Kneser-Ney of order two with dictionaries."""
    raw, pairs = Counter(), Counter()
    for t in train:
        w = [*lower_words(t), "</s>"]
        raw.update(w)
        pairs.update(zip(["<s>", *w], w))
    left = Counter(b for _, b in pairs)
    total, kinds = Counter(), {}
    for (a, _), c in pairs.items():
        total[a] += c
        kinds.setdefault(a, [0, 0, 0])[min(c, 3) - 1] += 1

    def d(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        return kneser_ney.discounts(n)

    dl, dp, v = d(left), d(pairs), len(raw)
    kinds_left = [sum(min(c, 3) == k for c in left.values()) for k in (1, 2, 3)]
    gamma = sum(x * y for x, y in zip(dl, kinds_left)) / len(pairs)

    def low(w):
        c = left[w]
        return (c - dl[min(c, 3) - 1] if c else 0) / len(pairs) + gamma / (v + 1)

    def prob(a, w):
        if not total[a]:
            return low(w)
        c = pairs[a, w]
        return ((c - dp[min(c, 3) - 1] if c else 0) + sum(x * y for x, y in zip(dp, kinds[a])) * low(w)) / total[a]

    return raw, prob


@pytest.mark.parametrize("per_bucket", [40, 1_000_000])
def test_kneser_ney(spark, per_bucket):
    texts = [prose(i, 40 + i, 60) + (" the the" if i % 2 else "") for i in range(60)] + [prose(1, 41, 60).upper(), "", None, "new words only here", "w1"]
    docs = frame(spark, texts)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    raw, prob = brute_model(train)
    model = kneser_ney.fit(docs.where(~held_out("doc_id", 10)), per_bucket=per_bucket)
    n, v = sum(raw.values()), len(raw)
    assert (model.tokens, model.types) == (n, v) and (model.buckets > 20) == (per_bucket == 40)
    for r in kneser_ney.perplexities(docs, model).collect():
        w = [*lower_words(texts[r.doc_id]), "</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in raw for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((raw[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(prob(a, b)) for a, b in zip(["<s>", *w], w)))
    vocabulary = [*raw, "unseen"]
    for a in ("<s>", b"w1", "unseen"):
        assert sum(prob(a, w) for w in vocabulary) == pytest.approx(1.0)


def test_kneser_ney_awkward(spark):
    docs = awkward(spark)
    got = kneser_ney.perplexities(docs, kneser_ney.fit(docs)).collect()
    assert len(got) == 15 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got if r.doc_id in (2, 3, 4)) == [1, 1, 1]
    model = kneser_ney.fit(empty(spark))
    assert (model.tokens, model.types) == (0, 0)
    assert kneser_ney.perplexities(docs, model).count() == 15
    assert kneser_ney.perplexities(empty(spark), model).count() == 0


def test_kneser_ney_open_files(spark, monkeypatch):
    """A task that looks into many buckets keeps no file of them open, and maps no more tables than it may."""
    texts = [prose(i, 60, 900) for i in range(40)]
    model = kneser_ney.fit(frame(spark, texts), per_bucket=5)
    keys, before = kneser_ney._with_before([kneser_ney.token_keys(t, WordHashes()) for t in texts])

    def held():
        with open("/proc/self/maps") as maps:
            return len(os.listdir("/proc/self/fd")), sum(model.shelf.uri.rsplit("/", 1)[-1] in m for m in maps)

    files, _ = held()
    look = model.reader()
    first = model.score(keys, before, look)
    assert model.buckets > 300 and held()[0] <= files + 5 and held()[1] > 1000
    monkeypatch.setattr(kneser_ney, "MAPPED", 100)
    del look
    few = model.reader()
    for got, want in zip(model.score(keys, before, few), first):
        np.testing.assert_array_equal(got, want)
    assert held()[1] <= 100


def test_entropy_counts():
    rng = random.Random(9)
    for rule in secrets.CLASSES:
        for _ in range(30):
            run = "".join(rng.choice("abcdefABCDEF0123456789") for _ in range(rng.randrange(20, 90)))
            marked = set()
            for a in range(len(run) - rule.width + 1):
                piece = run[a : a + rule.width]
                h = -sum(c / rule.width * math.log2(c / rule.width) for c in Counter(piece).values())
                if h >= rule.limit - 1e-12 and len({secrets._kind_of(c) for c in piece}) >= rule.kinds:
                    marked |= set(range(a, a + rule.width))
            assert {i for a, b in secrets.dense_spans(run, rule) for i in range(a, b)} == marked


def test_secrets_of_one_case():
    rng = random.Random(4)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        keys = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(300)]
        assert sum(bool(secrets.find_secrets(f"see {k} there")[1]) for k in keys) >= 280
    for text in ("internationalization2024", "z" * 26 + "1", "section" * 5 + "7"):
        assert secrets.find_secrets(text)[1] == [], text


def test_secrets(spark):
    key = "AKIA" + "Q7XW2N5ZP8RT4LVB"
    cases = {
        'my Password = "hunter22x" ok': ["assign:3:24"],
        f"é日 {key} end": ["access:3:23"],
        "d " + "0af93" * 5: ["hex:2:27"],
        "token: abc": [],
        "secret=token:abcdefgh": [],
        "aws_api_key='Zm9vYmFy'": ["assign:4:21"],
        "id 123e4567-e89b-12d3-a456-426614174000 x": [],
        "blob qX7vT2mK9pLz4RwY8sNb3HcD x": ["entropy:5:29"],
        "abcdefghijklmnopqrstuvwxyzabcdefgh": [],
        "passWORD=ſecret": [],
    }
    rows = {r.doc_id: r for r in secrets.scan(frame(spark, list(cases))).collect()}
    for i, (text, want) in enumerate(cases.items()):
        assert rows[i].spans == ",".join(want), text
        base = ",".join(w for w in want if not w.startswith("entropy"))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert secrets.redact("my password=hunter22x.") == "my [secret]"
    assert secrets.redact(None) is None
    got = secrets.scan(awkward(spark)).collect()
    assert len(got) == 15 and {r.doc_id for r in got} >= {None, (1 << 60) + 1}
    assert secrets.scan(empty(spark)).count() == 0
