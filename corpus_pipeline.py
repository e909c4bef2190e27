"""The training-data pipeline over ``documents``: toxic documents, near duplicates and benchmark passages go, then the
sources are mixed and the rows dealt to shards.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from trialloom.llm.text import fresh, table
from trialloom.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half.

    Every row is judged by its own text, so repeated rows and ids stay or go alike; null and empty texts hold no
    lexicon entry. Rows without id are judged, but teach nothing. An empty table stays empty.
    """
    lexicon = toxicity.fit_lexicon(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return docs.withColumn(score, toxicity.toxicity(F.col("text"), lexicon)).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by five-word shingles at 0.8 or more, the one with the smallest id.

    Exactly one row of a group stays, whatever the ids: a row is known by its id and a hash of its text, null ids come
    last, and of rows equal in both one stays. Rows without words are no copies of anything and stay. An empty table
    stays empty.
    """
    key, row = fresh(docs, "key"), fresh(docs, "row")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # the operator leaves keys empty on rows of its own, so they have to be allowed to be NULL
    rows = docs.withColumn(key, F.when(F.xxhash64("text").isNotNull(), own.cast(f"struct<no_id:boolean,doc_id:{id_type},text:bigint>")))
    groups = ngram_join.jaccard_components(rows, k=5, percent=80, id_col=key)
    groups = materialise(groups.select(F.col("doc_id").alias(key), "component_id", "n_shingles"), "near-duplicates")
    gone = groups.where(F.col(key) != F.col("component_id")).select(key)
    kept = rows.join(gone, key, "left_anti")
    names = [F.col(f"`{c}`") for c in docs.columns]
    repeated = groups.where("n_shingles > 0").where(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    if repeated.isEmpty():
        return kept.select(*names)
    first = kept.join(repeated, key, "left_semi").groupBy(key).agg(F.first(F.struct(*names)).alias(row))
    return kept.join(repeated, key, "left_anti").select(*names).unionByName(first.select(f"{row}.*"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of ``benchmark``.

    Ids of overlapping rows go, with every row that has such an id; null and empty texts overlap with nothing. An empty
    table stays empty.
    """
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources; a document that is taken more than once is there as often.

    A null source is a source of its own; texts without words have size 0. Rows equal in id and text are drawn alike.
    An empty table stays empty.
    """
    return mixing.repeat_rows(mixing.mix(docs)).select(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot.

    Equal ids share a shard and null ids share one; equal rows take neighbouring slots. An empty table gives no rows.
    """
    return sharding.rendezvous(docs, [1.0] * 24)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", deal_shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
