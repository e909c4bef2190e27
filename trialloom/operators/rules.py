"""Rules and validations of a survey as data: evaluated by joins against responses, no condition written by hand.

Responses are unpivoted to *facts*: a choice that was taken (``q://Q2/1``) or a field with its value. Each rule becomes
one row with its tree, folded from the deepest level up, "and" binding tighter than "or"; each response gets its facts,
meets the rules of its survey and evaluates them inside the row. Truth has three values: a term that cannot be decided
is NULL.

Tables made of a codebook may be as large as responses while their files, or the files they come from, are small. So
they are counted, and broadcast only below a row limit; tables of responses are never broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.scalars import to_number
from trialloom.operators.ranks import BROADCAST_ROWS
from trialloom.session import materialise


def _book(df: DataFrame, count: int) -> DataFrame:
    """A table of a codebook, to be broadcast only if its counted rows are few; Spark's own guess goes by file sizes."""
    return F.broadcast(df) if count <= BROADCAST_ROWS else df.hint("merge")


def facts(responses: DataFrame, ids: Sequence[str], survey: str, answers: Mapping[str, str], fields: Sequence[str], questions: DataFrame) -> DataFrame:
    """``ids``, ``left`` and ``value``: one row per answer given and per known embedded field.

    ``answers`` maps a question's export tag to the column with the chosen id; ``questions`` gives the question's own id.
    """
    given = [F.struct(F.lit(tag).alias("tag"), F.col(c).cast("string").alias("value")) for tag, c in answers.items()]
    rows = responses.select(*ids, F.col(survey).alias("_survey"), F.inline(F.array(*given))).filter(F.col("value").isNotNull())
    named = materialise(questions.select(F.col("survey").alias("_s"), F.col("tag").alias("_t"), "qid"), "questions")
    chosen = rows.join(_book(named, named.count()), (F.col("_survey") == F.col("_s")) & (F.col("tag") == F.col("_t")))
    chosen = chosen.select(*ids, F.concat(F.lit("q://"), "qid", F.lit("/"), "value").alias("left"), F.lit(None).cast("string").alias("value"))
    if not fields:
        return chosen
    known = [F.struct(F.lit(c).alias("left"), F.col(c).cast("string").alias("value")) for c in fields]
    return chosen.unionByName(responses.select(*ids, F.inline(F.array(*known))).filter(F.col("value").isNotNull()))


def _truth(term: Column, there: bool, value: Column) -> Column:
    """Truth of a term beside the value of the fact it names, or where there is no such fact."""
    operator, right = term["operator"], term["right"]
    numbers = to_number(value).isNotNull() & to_number(right).isNotNull()

    def compared(test) -> Column:
        return F.when(numbers, test(to_number(value), to_number(right))).otherwise(test(value, right))

    return (
        F.when(operator == "Selected", F.lit(there))
        .when(operator == "NotSelected", F.lit(not there))
        .when(operator == "EqualTo", compared(lambda a, b: a == b))
        .when(operator == "NotEqualTo", compared(lambda a, b: a != b))
        .when(operator == "GreaterThan", compared(lambda a, b: a > b))
        .when(operator == "LessThan", compared(lambda a, b: a < b))
    )


def _with_runs(base: DataFrame, depth: int) -> DataFrame:
    """Terms with, for every level of ``_path``, the number of "or"s before it among its siblings, as ``_runs``.

    A group hangs on what precedes it by the conjunction of its first term. This is work on the rules alone.
    """
    # dealt once by rule; every window below lies within that
    terms = base.repartition("survey", "target").withColumn("_runs", F.array().cast("array<int>"))
    for level in range(1, depth + 1):
        inside = F.size("_path") >= level
        key = ["survey", "target", inside]
        group = Window.partitionBy(*key, F.slice("_path", 1, level)).orderBy("_path", "conjunction")
        siblings = Window.partitionBy(*key, F.slice("_path", 1, level - 1)).orderBy(F.get("_path", F.lit(level - 1)))
        terms = terms.withColumn("_first", F.row_number().over(group) == 1)
        starts = F.col("_first") & F.coalesce(F.col("conjunction") == "Or", F.lit(False)) & (F.dense_rank().over(siblings) > 1)
        terms = terms.withColumn("_start", starts.cast("int")).withColumn("_run", F.sum("_start").over(siblings).cast("int"))
        terms = terms.withColumn("_runs", F.when(inside, F.array_append("_runs", F.col("_run"))).otherwise(F.col("_runs"))).drop("_first", "_start", "_run")
    return terms


def _trees(rules: DataFrame) -> tuple[DataFrame, int, int]:
    """One row per rule: ``survey``, ``target`` and ``tree``; how many levels a tree has, and how many terms there are.

    A tree of n levels is an "or" of "and"s of trees of n - 1 levels, as arrays of arrays; one of no levels is a term.
    """
    base = materialise(rules.withColumn("_path", F.split("path", r"\.").cast("array<int>")), "rule-terms")
    depth, count = base.agg(F.max(F.size("_path")), F.count(F.lit(1))).first()
    depth = depth or 0
    key = ["survey", "target"]
    rows = _with_runs(base, depth).select(*key, "_path", "_runs", F.struct("left", "operator", "right").alias("tree"))
    for level in range(depth, 0, -1):
        here = F.size("_path") == level
        # what lies higher up stays a group of its own
        up = lambda c: F.when(here, F.slice(c, 1, level - 1)).otherwise(F.col(c)).alias(c)  # noqa: E731, B023
        run = F.when(here, F.element_at("_runs", level)).alias("_run")
        rows = rows.select(*key, up("_path"), up("_runs"), run, "tree")
        rows = rows.groupBy(*key, "_path", "_runs", "_run").agg(F.collect_list("tree").alias("tree"))
        rows = rows.groupBy(*key, "_path", "_runs").agg(F.collect_list("tree").alias("tree"))
    return materialise(rows.select(*key, "tree"), "rule-trees"), depth, count


def _holds(tree: Column, levels: int, known: Column) -> Column:
    """Three-valued truth of a tree beside the facts of a response; a fact that is there twice counts with each value."""
    if levels:
        return F.exists(tree, lambda run: F.forall(run, lambda part: _holds(part, levels - 1, known)))
    named = lambda fact: fact["left"] == tree["left"]
    each = F.forall(F.filter(known, named), lambda fact: _truth(tree, True, fact["value"]))
    return F.when(F.exists(known, named), each).otherwise(_truth(tree, False, F.lit(None).cast("string")))


def rule_truth(responses: DataFrame, ids: Sequence[str], survey: str, rules: DataFrame, found: DataFrame) -> DataFrame:
    """``ids``, ``target`` and ``holds`` for every rule of a response's survey.

    ``rules`` has the columns of the codebook's rule table, ``found`` those of ``facts``; ``ids`` are unique.
    """
    trees, depth, count = _trees(rules)
    trees = _book(trees.withColumnRenamed("survey", "_s"), count)
    held = found.groupBy(*[F.col(c).alias(f"_f_{c}") for c in ids]).agg(F.collect_list(F.struct("left", "value")).alias("_facts"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_f_{c}") for c in ids])
    # dealt once by response; a response that is there twice counts once
    rows = responses.select(*ids, F.col(survey).alias("_survey")).repartition(*ids).distinct()
    rows = rows.join(held.hint("merge"), same, "left").join(trees, F.col("_survey") == F.col("_s"))
    known = F.coalesce("_facts", F.array().cast(held.schema["_facts"].dataType))
    return rows.select(*ids, "target", _holds(F.col("tree"), depth, known).alias("holds"))


def breaches(responses: DataFrame, ids: Sequence[str], survey: str, answers: Mapping[str, str], validations: DataFrame) -> DataFrame:
    """``ids``, ``tag`` and one flag per kind of rule that the survey's ``validations`` lay on the answer.

    A rule that a question does not have is never broken; only ``missing`` looks at blank answers.
    """
    given = [F.struct(F.lit(tag).alias("tag"), F.col(c).cast("string").alias("value")) for tag, c in answers.items()]
    rows = responses.select(*ids, F.col(survey).alias("_survey"), F.inline(F.array(*given)))
    own = validations.withColumnsRenamed({"survey": "_s", "tag": "_t"})
    rows = rows.join(own, (F.col("_survey") == F.col("_s")) & (F.col("tag") == F.col("_t")))
    blank = F.col("value").isNull() | (F.trim("value") == "")
    number = to_number("value")
    outside = (number < F.col("min_value")) | (number > F.col("max_value"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        *ids,
        "tag",
        flag(F.col("requested") & blank).alias("missing"),
        flag((F.col("content_type") == "ValidNumber") & ~blank & number.isNull()).alias("not_numeric"),
        flag((F.col("content_type") == "ValidNumber") & ~blank & outside).alias("out_of_range"),
        flag(~blank & (F.char_length("value") < F.col("min_chars"))).alias("too_short"),
    )
