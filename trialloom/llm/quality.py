"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes a weighted term vector: hashed words, and shape terms that say how its words and lines look (marks at the
end of words, capitals, repetition, bars, length). A truncated singular value decomposition over a bounded labelled
sample turns it into a short latent vector. The labelled vectors are broadcast; every document is compared with all of
them by blocked matrix products, and the labels of the nearest ones are averaged, weighted by similarity.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.text import WordHashes, find_words, held_out, labelled_sample, map_texts

DIMENSIONS = 4096
#: Shape terms, in the first places of a vector.
SHAPES = ("present", "marked", "upper", "bars", "adjacent", "repeated lines", "rare", "dense", "digits", "stops", "commas", "lines", "triples", "long", "single")
SHAPE_WEIGHT = 8.0
BLOCK = 512


def term_vector(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's terms; a text without words has only the term that every text has."""
    text = text or ""
    found = find_words(text)
    n = len(found)
    shape = np.zeros(len(SHAPES), dtype=np.float32)
    shape[0] = 0.25
    if not n:
        return np.arange(1), shape[:1]
    counts = Counter(found)
    lines = [line for line in text.split("\n") if line.strip()]
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?)\"'")
    shape[1:] = [
        marked / n,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
        sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / n,
        sum(a == b for a, b in zip(found, found[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(counts) / n / 2,
        max(counts.values()) / n,
        sum(c for w, c in counts.items() if any(map(str.isdigit, w))) / n,
        text.count(".") / n,
        text.count(",") / n,
        len(lines) / n,
        1 - len(set(zip(found, found[1:], found[2:]))) / max(1, n - 2),
        sum(len(w) * c for w, c in counts.items()) / n / 20,
        math.log(n) / 20,
    ]
    words = list(counts)
    places = hashes([w.encode().lower() for w in words]) % np.uint64(DIMENSIONS - len(SHAPES)) + np.uint64(len(SHAPES))
    places, at = np.unique(places.astype(np.int64), return_inverse=True)
    values = np.log1p(np.bincount(at, weights=np.array([counts[w] for w in words], dtype=float)))
    values /= max(np.linalg.norm(values), 1e-9)
    return np.concatenate([np.arange(len(SHAPES)), places]), np.concatenate([shape * SHAPE_WEIGHT, values]).astype(np.float32)


@dataclass(frozen=True)
class Neighbours:
    """The projection, the labelled latent vectors, and what a vote of each counts."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float
    nearest: int = 25
    power: float = 6.0

    def scorer(self) -> Callable[[list], dict]:
        hashes = WordHashes()

        def latent(texts: list) -> np.ndarray:
            out = np.zeros((len(texts), self.projection.shape[1]), dtype=np.float32)
            for i, text in enumerate(texts):
                places, values = term_vector(text, hashes)
                out[i] = values @ self.projection[places]
            return _unit(out)

        def score(texts: list) -> dict:
            parts = [self.vote(latent(texts[i : i + BLOCK])) for i in range(0, len(texts), BLOCK)]
            return {"score": np.concatenate(parts) if parts else np.zeros(0)}

        return score

    def vote(self, latent: np.ndarray) -> np.ndarray:
        """Mean label of the nearest labelled vectors, by similarity; the share of good labels where none is similar."""
        if not len(self.labels):
            return np.full(len(latent), self.prior)
        cosine = latent @ self.vectors.T
        k = min(self.nearest, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0).astype(float) ** self.power * self.votes[near]
        total = weight.sum(1)
        return np.where(total > 1e-12, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _decompose(x: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 12, x.shape[1]))).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return q @ vt[:rank].T


def fit_neighbours(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, rank: int = 48
) -> Neighbours:
    """Learn the space and keep the labelled vectors of at most ``per_class`` documents of each class.

    Votes are weighted so that the classes count as often as they occur among all labels. Without labels every
    document gets the score one half.
    """
    sample, totals = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    n = sum(totals.values())
    prior = totals.get(1, 0) / n if n else 0.5

    def start():
        hashes = WordHashes()

        def work(texts: list) -> dict:
            found = [term_vector(t, hashes) for t in texts]
            return {"places": [a for a, _ in found], "values": [b for _, b in found]}

        return work

    rows = map_texts(sample.repartition(8, F.xxhash64("text")), start, "places array<int>, values array<float>").orderBy("id").toArrow().to_pydict()
    y = np.array(rows["label"], dtype=float)
    x = np.zeros((len(y), DIMENSIONS), dtype=np.float32)
    for i, (places, values) in enumerate(zip(rows["places"], rows["values"])):
        x[i, places] = values
    if not len(y):
        return Neighbours(np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), y, y, prior)
    weight = np.log1p(len(x) / (1.0 + (x > 0).sum(0))).astype(np.float32)
    weight[: len(SHAPES)] = 1.0
    x *= weight
    basis = _decompose(x, rank)
    share = {c: max((y == c).mean(), 1e-9) for c in (0.0, 1.0)}
    votes = np.where(y == 1, prior / share[1.0], (1 - prior) / share[0.0])
    return Neighbours((basis * weight[:, None]).astype(np.float32), _unit(x @ basis).astype(np.float32), y, votes, prior)


def score_documents(docs: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``score`` and ``predicted``.

    Null and empty texts are scored by the only term they have. Repeated rows and null ids are scored like any other;
    an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_texts(rows, model.scorer, "score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
