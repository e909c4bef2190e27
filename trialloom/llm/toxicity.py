"""Toxicity by a weighted lexicon.

Texts are folded first: accents, look-alike letters of other alphabets, digits and signs that stand for letters. An
Aho-Corasick automaton then finds all lexicon entries in one pass. Entries are whole words or beginnings of words; a
word counts with its best entry. Words inside an exception phrase do not count. The sum of weights, together with
itself over the square root of the length, goes through a logistic curve fitted on labelled rows.

The lexicon starts with a short list of insults and learns weights and further entries from labelled documents: how
much more often an entry occurs in toxic texts, per word, than in others.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from trialloom.llm.text import find_words, held_out, labelled_sample, small_batches

# General insults to start from, phrases in which such words are harmless, and look-alike characters.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile".split()
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pathetic fallacy", "sore loser rule", "disgusting smell of")
LOOK_ALIKES = {
    "a": "аαɑ@4", "b": "ЬвβƄ8", "c": "сϲ", "d": "ԁ", "e": "еєε3", "g": "ɡ9", "h": "һ", "i": "іιı1l|", "j": "јϳ", "k": "кκ",
    "m": "м", "n": "пη", "o": "оοσ0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ԝω",
    "x": "хχ", "y": "уγ", "z": "ᴢ2",
}
PRIOR_WEIGHT = 3.0
PREFIXES = (4, 5, 6, 7)
#: Signs that stand for a letter only in front of one.
_signs = re.compile(r"[@$|](?=[^\W_])")


def _fold_table() -> dict[int, str]:
    folded = {}
    for point in [*range(0xC0, 0x250), *range(0xFF01, 0xFF5F), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(point))[0].lower()
        if base.isascii() and base.isalnum():
            folded[point] = base
    for letter, others in LOOK_ALIKES.items():
        for other in others:
            folded[ord(other)] = letter
    folded.update({point: "i" for point, base in folded.items() if base == "l"})
    return folded


FOLDED = _fold_table()
SIGNS = {"@": "a", "$": "s", "|": "i"}
#: ASCII characters: letters and digits folded, all others blank.
ASCII = {c: FOLDED.get(ord(chr(c).lower()), chr(c).lower()) if chr(c).isalnum() else " " for c in range(128)}
_not_ascii = re.compile(r"[^\x00-\x7f]+")


def fold(text: str) -> str:
    """Folded text with a blank at both ends; everything but letters and digits is blank."""
    if "@" in text or "$" in text or "|" in text:
        text = _signs.sub(lambda m: SIGNS[m[0]], text)
    if not text.isascii():
        # a replacement for each such character that occurs is much faster than a table look-up for each character
        text = text.lower()
        for c in set("".join(_not_ascii.findall(text))):
            text = text.replace(c, FOLDED.get(ord(c), c if c.isalnum() else " "))
    return f" {text.translate(ASCII)} "


def entries(text: str) -> list[str]:
    """Possible lexicon entries of a folded text: ' word ' and ' beginning', once for each occurrence."""
    out = []
    for w in text.split():
        out.append(f" {w[:40]} ")
        out += [f" {w[:k]}" for k in PREFIXES if len(w) >= k]
    return out


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, and the logistic curve over (log sum, sum by root length, log length)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 1.5, 1.0, 0.0)

    def automaton(self):
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            made.add_word(fold(phrase), (len(fold(phrase)), None))
        if len(made):
            made.make_automaton()
        return made


def weigh(text: str | None, automaton) -> tuple[float, int]:
    """Sum of the weights of the words that match and are in no exception phrase, and the number of words."""
    folded = fold(text or "")
    best: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    if len(automaton):
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                free.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    total = sum(w for at, w in best.items() if not any(a <= at < b for a, b in free)) if free else sum(best.values())
    return total, len(folded.split())


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), total / np.sqrt(n + 25.0), np.log(n + 25.0) - 5.0], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 6000,
    max_entries: int = 20_000,
    min_docs: int = 3,
    min_weight: float = 1.5,
    min_evidence: float = 4.0,
) -> Lexicon:
    """Learn entries and the curve from at most ``per_class`` labelled documents of each class.

    Two thirds of them give the entries, the others the curve. ``max_entries`` bounds the lexicon, heaviest evidence
    first. Without examples of both classes the starting list is used with a fixed curve.
    """
    sample, totals = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    start = {fold(w): PRIOR_WEIGHT for w in INSULTS}
    if not (totals.get(0) and totals.get(1)):
        return Lexicon(start)
    role = F.pmod(F.xxhash64(F.lit("role"), "id"), F.lit(3)).cast("int")
    sample = sample.select("text", "label", role.alias("role")).repartition(8, F.xxhash64("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, seen = (Counter(), Counter()), (Counter(), Counter())

        def flush():
            keys = list({*hits[0], *hits[1]})
            if not keys:
                return
            yield pd.DataFrame({"entry": pd.Series(keys, dtype=object)} | {f"{name}{y}": [c[y][k] for k in keys] for name, c in (("hits", hits), ("docs", seen)) for y in (0, 1)})
            for c in (*hits, *seen):
                c.clear()

        for batch in batches:
            for text, y in zip(batch["text"], batch["label"]):
                found = Counter(entries(fold(text)))
                hits[y].update(found)
                seen[y].update(found.keys())
                hits[y][""] += len(text.split())
                seen[y][""] += 1
                if len(hits[0]) + len(hits[1]) > 300_000:
                    yield from flush()
        yield from flush()

    sums = [F.sum(c).alias(c) for c in ("hits0", "hits1", "docs0", "docs1")]
    counted = sample.where("role < 2").mapInPandas(count, "entry string, hits0 long, hits1 long, docs0 long, docs1 long").groupBy("entry").agg(*sums)
    whole = counted.where("entry = ''").first()
    if whole is None or not (whole["docs0"] and whole["docs1"]):
        return Lexicon(start)
    ratio = F.log((F.col("hits1") + 0.5) / (whole["hits1"] + 1.0)) - F.log((F.col("hits0") + 0.5) / (whole["hits0"] + 1.0))
    spread = F.sqrt(1.0 / (F.col("docs1") + 0.5) + 1.0 / (F.col("docs0") + 0.5))
    kept = (
        counted.where((F.col("entry") != "") & (F.col("docs1") >= min_docs))
        .select("entry", ratio.alias("weight"), (ratio / spread).alias("evidence"))
        .where((F.col("weight") >= min_weight) & (F.col("evidence") >= min_evidence))
        .orderBy(F.desc("evidence"), "entry")
        .limit(max_entries)
        .collect()
    )
    lexicon = Lexicon({**start, **{r["entry"]: float(min(r["weight"], 8.0)) for r in kept}})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [weigh(t, automaton) for t in batch["text"]]
            yield pd.DataFrame({"total": [x[0] for x in found], "n": [x[1] for x in found], "label": batch["label"]})

    rows = sample.where("role = 2").mapInPandas(measure, "total double, n long, label int").orderBy("total", "n", "label").toPandas()
    y = rows["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return lexicon
    share = totals[1] / (totals[0] + totals[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    beta = _logistic(features(rows["total"].to_numpy(), rows["n"].to_numpy()), y, weight)
    return Lexicon(lexicon.weights, lexicon.exceptions, tuple(float(b) for b in beta))


def toxicity(text: Column | str, lexicon: Lexicon) -> Column:
    """Probability that a text is toxic; null and empty texts are scored as texts without words."""

    small_batches(SparkSession.active())

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, beta = lexicon.automaton(), np.array(lexicon.curve)
        for texts in batches:
            found = [weigh(t, automaton) for t in texts]
            x = features(np.array([f[0] for f in found], float), np.array([f[1] for f in found], float))
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30))))

    return score(text)


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``score`` and ``predicted``.

    Repeated rows and null ids are scored like any other; an empty table gives no rows; other columns are not read.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), toxicity(F.col(text_col), lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
