"""Awkward inputs shared by the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, shard int, copies int, label string, id string, n int, rule string"
TEXT = "the quick brown fox jumps over the lazy dog while seven wizards boil jugs of green tea and nobody minds the noise they make"


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward_rows() -> list[tuple]:
    big = (1 << 60) + 1
    texts = [
        (0, TEXT, "a"), (1, TEXT, "a"), (1, TEXT, "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", ""), (5, "one", "b"),
        (6, "two words", "b"), (7, prose(1, 30_000, 5000), "b"), (8, "same " * 3000, "c"), (9, "é ß 日本  x", "c"),
        (None, TEXT + " more", "a"), (None, None, None), (big, "idiot " + TEXT, None), (10, "A b\x0bC\x1cd \x85 e", "d"),
    ]
    return [(i, t, None, s, None, 0.5, "big", 7, 9, "x", "y", 3, "z") for i, t, s in texts]


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or [], "doc_id bigint, quality int, toxic int")


def frame(spark: SparkSession, texts: list[str | None], first: int = 0) -> DataFrame:
    return spark.createDataFrame([(first + i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
