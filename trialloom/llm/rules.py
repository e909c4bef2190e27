"""Quality rules: an isolation forest over rule statistics.

Each text gives a few statistics (symbols, repeated lines and words, word lengths and so on). A forest of random splits,
each tree grown on a small sample, isolates unusual texts in few steps: the shorter the mean path, the more anomalous.
The threshold comes from labelled rows: the lowest anomaly at which still no more than a given share of the good
documents is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.text import find_words, map_texts
from trialloom.session import materialise

_symbols = re.compile(r"[#*$%&|<>]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("symbol_rate", "mark_words", "upper_words", "dup_lines", "repeat_words", "distinct_words", "adjacent_equal", "mean_length", "bar_words")
MIN_WORDS = 50


def repeated_windows(found: list[str], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which occurs more than once, its first occurrence included."""
    if len(found) <= width:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in found], dtype=np.int64)
    # pairs, then triples and so on, as small numbers: exact for any text
    code = ids
    for k in range(1, width):
        _, code = np.unique(code[:-1] * (len(ids) + 1) + ids[k:], return_inverse=True)
    often = np.bincount(code)[code] > 1
    covered = np.zeros(len(found) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(often), 1)
    np.add.at(covered, np.flatnonzero(often) + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> tuple[float, ...]:
    """The base counts and the statistics of one text; all zero for a text without words."""
    text = text or ""
    found = find_words(text)
    n = len(found)
    symbols = len(_symbols.findall(text))
    lines = Counter(line for line in text.split("\n") if find_words(line))
    dup = sum(lines.values()) - len(lines)
    chars = sum(map(len, found))
    repeats = repeated_windows(found)
    if not n:
        return (0, 0, symbols, 0, 0, *[0.0] * len(STATISTICS))
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:?)\"'" for w in found)
    return (
        n, chars, symbols, dup, repeats,
        symbols / n, marked / n, sum(len(w) > 1 and w.isupper() for w in found) / n, dup / max(1, sum(lines.values())), repeats / n,
        len(set(found)) / math.sqrt(n), sum(a == b for a, b in zip(found, found[1:])) / n, chars / n, sum(w == "|" for w in found) / n,
    )


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (feature or -1, split, left child; the right one follows it; path length at a leaf)."""

    trees: tuple[tuple[np.ndarray, ...], ...]
    sample: int
    threshold: float = 1.0

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus mean path over the path expected: near 1 for what is isolated at once."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                down = rows[inner]
                node = at[down]
                at[down] = left[node] + (x[down, feature[node]] >= split[node])
            total += length[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(expected_path(self.sample), 1e-9))


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _tree(x: np.ndarray, box: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    feature, split, left, length = [-1], [0.0], [0], [0.0]
    todo = [(np.arange(len(x)), box, 0)]
    for at, (rows, (low, high), level) in enumerate(todo):
        wide = np.flatnonzero(high > low)
        if level >= depth or len(rows) < 2 or not len(wide):
            length[at] = level + expected_path(len(rows))
            continue
        f = feature[at] = int(rng.choice(wide))
        split[at] = float(rng.uniform(low[f], high[f]))
        left[at] = len(todo)
        right = x[rows, f] >= split[at]
        below, above = np.array([low, high]), np.array([low, high])
        below[1, f] = above[0, f] = split[at]
        todo += [(rows[~right], below, level + 1), (rows[right], above, level + 1)]
        for _ in range(2):
            feature.append(-1), split.append(0.0), left.append(0), length.append(0.0)
    return tuple(np.array(a) for a in (feature, split, left, length))


def grow(x: np.ndarray, box: np.ndarray | None = None, trees: int = 150, sample: int = 256, seed: int = 7) -> Forest:
    """Trees over samples of ``x``. Splits are drawn over ``box`` (lowest and highest values, of ``x`` by default) and its
    parts, so a region that holds no sample is a leaf near the root even where the sample does not vary at all."""
    box = np.array([x.min(0), x.max(0)]) if box is None else box
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = max(1, math.ceil(math.log2(max(2, sample))))
    return Forest(tuple(_tree(x[rng.choice(len(x), sample, replace=False)], box, depth, rng) for _ in range(trees)) if sample else (), sample)


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = 4000,
    lost: float = 0.005,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the base counts, ``anomaly``, ``base_failed`` and ``kept``.

    The forest grows on at most ``fit_rows`` good labelled documents that pass the base rules (the first by hash of their
    id), with splits over the range of all labelled ones. The threshold is taken over all labelled rows that pass the base rules: the anomaly
    that splits them best, but never one that would lose more than ``lost`` of the good ones. Without good examples every
    row that passes the base rules is kept. Null texts count as empty; repeated rows and null ids are judged like any
    other; an empty table gives no rows. Other columns are not read.
    """

    def statistics(texts: list) -> dict:
        found = [measure(t) for t in texts]
        return {**{c: [r[k] for r in found] for k, c in enumerate(BASE)}, "x": [list(map(float, r[len(BASE) :])) for r in found]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = map_texts(rows, lambda: statistics, ", ".join(f"{c} long" for c in BASE) + ", x array<double>")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).alias("label"))
    rows = materialise(rows, "statistics")
    passed = rows.where(~F.col("base_failed")).join(known, "doc_id").select("doc_id", "x", "label")
    good = passed.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).toPandas()
    if not len(good):
        return rows.select("doc_id", *BASE, F.lit(0.0).alias("anomaly"), "base_failed", (~F.col("base_failed")).alias("kept"))
    ends = passed.agg(*[f(F.col("x")[k]).alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(len(STATISTICS))]).first()
    forest = grow(np.stack(good["x"].to_numpy()), np.array(ends, dtype=float).reshape(2, -1))

    @F.pandas_udf("double")
    def anomaly(x: pd.Series) -> pd.Series:
        return pd.Series(forest.anomaly(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    # anomalies on a fixed grid: the table of counts has a fixed size
    grid = 2000
    cells = passed.select(F.floor(anomaly("x") * grid).cast("int").alias("cell"), "label").groupBy("cell").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).toPandas()
    threshold = _threshold(cells, lost) / grid
    scored = rows.withColumn("anomaly", anomaly("x"))
    return scored.select("doc_id", *BASE, "anomaly", "base_failed", (~F.col("base_failed") & (F.col("anomaly") < threshold)).alias("kept"))


def _threshold(cells: pd.DataFrame, lost: float) -> int:
    """The first cell to be dropped: right more often than any other, with at most a share ``lost`` of the good dropped."""
    cells = cells.sort_values("cell", ascending=False)
    good = cells["good"].cumsum().to_numpy()
    bad = (cells["n"] - cells["good"]).cumsum().to_numpy()
    allowed = good <= lost * cells["good"].sum()
    gain = np.where(allowed, bad - good, -1)
    best = int(np.argmax(gain)) if len(gain) else -1
    return int(cells["cell"].iloc[best]) if best >= 0 and gain[best] > 0 else 1 << 20
