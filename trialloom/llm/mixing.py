"""Mixing sources to target weights by Pareto order sampling.

Sources share the wanted number of words by weight; no target exceeds a multiple of its source, and the excess is
shared again. Within a source a document's expected number of copies grows with a power of its size, up to the same
multiple, at the one level where the expected words add up to the target. The whole part of that number is taken for
certain; the fraction left over is the document's inclusion probability p. Documents are then ranked by
``(u / (1 - u)) / (p / (1 - p))`` with a uniform u from a hash, and taken in this order until the words still wanted are
reached, so the sample's size is fixed to within one document.

The last rank taken is found from sums over ranges of ranks, twice refined, so no task sorts a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trialloom.llm.sharding import record_key, unit
from trialloom.llm.text import WORD, fresh
from trialloom.session import materialise

CELLS = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def numbered(sources: DataFrame, name: str) -> DataFrame:
    """Sources with ``place``: their position by code point, null last, from one distributed sort."""
    ordered = sources.orderBy(F.col(name).asc_nulls_last())
    schema = StructType([*ordered.schema.fields, StructField("place", LongType())])
    return sources.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


def source_targets(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): written once, then shared by weight until no target is above its limit."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), turn)
    found = materialise(numbered(sizes, "source").withColumn("weight", weight).withColumn("limit", most * F.col("source_size")), "sources")
    wanted = found.agg(F.sum("source_size")).first()[0] or 0
    wanted = wanted if share == 1 else wanted * share
    level, before = 0.0, None
    while level != before:
        full = F.col("limit") / F.col("weight") < level
        taken, rest = found.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        level, before = ((wanted - (taken or 0)) / rest if rest else level), level
    return found.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _pull(size: Column, power: float) -> Column:
    """What a document's expected copies are in proportion to; one without words counts as one of one word."""
    return F.pow(F.greatest(size, F.lit(1)), F.lit(power))


def expected_copies(size: Column, level: Column, power: float, most: int) -> Column:
    """Copies of a document of this size; at a null level all documents are taken as often as is allowed."""
    return F.coalesce(F.least(F.lit(float(most)), level * _pull(size, power)), F.lit(float(most)))


def source_levels(rows: DataFrame, targets: DataFrame, power: float, most: int) -> DataFrame:
    """``targets`` with the ``level`` of each source's expected copies and the words ``wanted`` beside its whole copies.

    Only the counts of each size are ordered, not documents: if the sizes from some size upwards are taken ``most``
    times, the rest of the target is shared by the sizes up to it. The largest size that then stays within ``most``
    gives the level.
    """
    sizes = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    known = sizes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    whole = Window.partitionBy("source")
    upto = whole.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = F.sum(F.col("n") * F.col("size") * _pull(F.col("size"), power)).over(upto)
    beyond = most * (F.col("source_size") - F.sum(F.col("n") * F.col("size")).over(upto))
    known = known.withColumn("level", F.try_divide(F.col("target") - beyond, drawn))
    fits = F.col("level") * _pull(F.col("size"), power) <= most
    level = F.max_by("level", F.when(fits, F.col("size"))).over(whole)
    known = known.withColumn("level", F.when(F.col("source_size") == 0, 0.0).otherwise(level))
    taken = F.sum(F.col("n") * F.col("size") * F.floor(expected_copies(F.col("size"), F.col("level"), power, most)))
    return known.groupBy("source", "source_size", "target", "level").agg((F.col("target") - taken).alias("wanted"))


def _rank(u: Column, p: Column) -> Column:
    """The Pareto rank, brought to the range 0 to 1; null for p = 0."""
    q = F.try_divide(u / (1 - u), p / (1 - p))
    return q / (1 + q)


def _fraction(copies: Column) -> Column:
    return copies - F.floor(copies)


def _last_ranks(rows: DataFrame) -> DataFrame:
    """(source, last): the highest rank taken, from rows of (source, size, rank, wanted)."""
    whole = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.where("wanted > 0").withColumn("low", F.lit(0.0))
    width = 1.0
    for _ in range(2):
        width /= CELLS
        part = part.withColumn("cell", F.least(F.floor((F.col("rank") - F.col("low")) / width), F.lit(CELLS - 1)))
        sums = part.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.first("low").alias("low"))
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(whole), F.lit(0)))
        # the last cell that begins before enough words are taken: the last rank is in it
        edge = sums.where("before < wanted").groupBy("source").agg(F.max_by(F.struct("cell", "before", "low"), "cell").alias("edge"))
        edge = edge.select(F.col("source").alias("s"), F.col("edge.cell").alias("c"), F.col("edge.before").alias("b"), (F.col("edge.low") + F.col("edge.cell") * width).alias("from"))
        part = part.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        part = part.select("source", "size", "rank", (F.col("wanted") - F.col("b")).alias("wanted"), F.col("from").alias("low"))
    running = Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = F.sum("size").over(running) - F.col("size") / 2 <= F.col("wanted")
    cut = part.withColumn("in", nearest).groupBy("source", "low").agg(F.max(F.when(F.col("in"), F.col("rank"))).alias("last"))
    # no rank of the cell is taken: everything below the cell is
    return cut.select("source", F.coalesce("last", F.col("low") - 2.0**-60).alias("last"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    power: float = 0.5,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``, replacing columns of these names.

    ``copies`` is how often the document is taken, ``taken`` the words this makes. Expected copies grow with size to the
    ``power``: at 0 all documents of a source are equally likely, at 1 long ones are taken by their words. A null text
    has no words; a document without words is taken as often as one of one word would be, and adds nothing. Null is a source of its own, last in order. Rows
    equal in id and text share one decision. Reruns agree: ranks come from a hash of id, text and seed. A source without
    words gets target 0. An empty table gives no rows.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    u = unit(F.concat(record_key(id_col), F.lit(f":{seed}:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    rows = docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), u.alias("u"))
    rows = materialise(rows, "sizes")
    targets = materialise(source_targets(rows.select("source", "size"), weights, share, most), "targets")
    targets = materialise(source_levels(rows, targets, power, most), "levels")
    keys = targets.select(F.col("source").alias("s"), "level", "wanted").where("wanted > 0")
    drawn = rows.join(keys, F.col("source").eqNullSafe(F.col("s"))).withColumn("p", _fraction(expected_copies(F.col("size"), F.col("level"), power, most)))
    last = _last_ranks(drawn.where("p > 0").select("source", "size", _rank(F.col("u"), F.col("p")).alias("rank"), "wanted")).withColumnRenamed("source", "s")
    rule = targets.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.struct(*[F.col(c) for c in ("source", "source_size", "target", "level", "last")]).alias(rule_name := fresh(docs, "rule"))
    )
    rule = materialise(rule, "rules")
    r = F.col(rule_name)
    copies = expected_copies(F.col("size"), r["level"], power, most)
    extra = F.coalesce(_rank(u, _fraction(copies)) <= r["last"], F.lit(False))
    out = docs.join(rule, F.col(source_col).eqNullSafe(r["source"])).withColumn("size", n_words(F.col(text_col)))
    out = out.withColumns({"source_size": r["source_size"], "target": r["target"], "copies": F.floor(copies).cast("long") + extra.cast("long")})
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*docs.columns, *added)


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` says."""
    return mixed.where("copies > 0").withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))

