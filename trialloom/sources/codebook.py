"""Survey definitions to flat codebook tables.

A definition is one JSON document with a list of elements whose payload shape depends on the element kind
and whose maps are keyed by number-like text. Each document is parsed once to VARIANT and exploded; the
work is spread over documents, and one document is bounded by what a person can answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """One row per definition file: ``definition`` text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "definition")


def _text(element: Column | str, path: str) -> Column:
    return F.try_variant_get(element, path, "string")


def elements(definitions: DataFrame, column: str = "definition") -> DataFrame:
    """``survey``, ``kind`` and the element itself, one row per element."""
    doc = definitions.select(F.parse_json(F.col(column)).alias("_doc"))
    return (
        doc.select(
            F.try_variant_get("_doc", "$.SurveyEntry.SurveyName", "string").alias("survey"),
            F.explode(F.variant_get("_doc", "$.SurveyElements", "array<variant>")).alias("element"),
        )
        .withColumn("kind", _text("element", "$.Element"))
    )


def _question_elements(definitions: DataFrame, column: str) -> DataFrame:
    return elements(definitions, column).filter(F.col("kind") == "SQ")


def questions(definitions: DataFrame, column: str = "definition") -> DataFrame:
    """``questions(survey, tag, qid, type, selector, sub_selector, text)``."""
    return _question_elements(definitions, column).select(
        "survey",
        _text("element", "$.Payload.DataExportTag").alias("tag"),
        _text("element", "$.Payload.QuestionID").alias("qid"),
        _text("element", "$.Payload.QuestionType").alias("type"),
        _text("element", "$.Payload.Selector").alias("selector"),
        _text("element", "$.Payload.SubSelector").alias("sub_selector"),
        _text("element", "$.Payload.QuestionText").alias("text"),
    )


def _options(definitions: DataFrame, column: str, field: str) -> DataFrame:
    """Explode one keyed map of options; a payload holding a list uses 1-based positions as keys."""
    node = f"$.Payload.{field}"
    keyed = F.try_variant_get("element", node, "map<string,variant>")
    listed = F.try_variant_get("element", node, "array<variant>")
    from_list = F.map_from_entries(
        F.transform(listed, lambda v, i: F.struct((i + 1).cast("string").alias("key"), v.alias("value")))
    )
    return (
        _question_elements(definitions, column)
        .select(
            "survey",
            _text("element", "$.Payload.DataExportTag").alias("tag"),
            F.try_variant_get("element", "$.Payload.RecodeValues", "map<string,string>").alias("_recode"),
            # recode numbers belong to the answer columns of a matrix, otherwise to the choices
            F.try_variant_get("element", "$.Payload.Answers", "map<string,variant>").isNotNull().alias("_matrix"),
            F.explode(F.coalesce(keyed, from_list)).alias("option_id", "_option"),
        )
        .select(
            "survey",
            "tag",
            "option_id",
            F.trim(_text("_option", "$.Display")).alias("label"),
            F.when(F.col("_matrix") == F.lit(field == "Answers"), F.try_element_at("_recode", F.col("option_id")))
            .alias("recode"),
        )
    )


def choices(definitions: DataFrame, column: str = "definition") -> DataFrame:
    """``choices(survey, tag, choice_id, label, recode)``."""
    return _options(definitions, column, "Choices").withColumnRenamed("option_id", "choice_id")


def answers(definitions: DataFrame, column: str = "definition") -> DataFrame:
    """Answer columns of matrix questions: ``answers(survey, tag, answer_id, label, recode)``."""
    return _options(definitions, column, "Answers").withColumnRenamed("option_id", "answer_id")


def _empty_variants() -> Column:
    return F.array().cast("array<variant>")


def _numbered(node: Column) -> Column:
    """Entries of a map that are keyed by numbers; none for anything else."""
    members = F.map_filter(F.try_variant_get(node, "$", "map<string,variant>"), lambda k, v: k.rlike("^[0-9]+$"))
    return F.coalesce(F.map_entries(members), F.array().cast("array<struct<key:string,value:variant>>"))


def _walk(start: Column, children, steps: Column) -> Column:
    """All nodes of a tree: ``start``, their children, and so on for ``steps`` levels.

    The walk is a fold inside the row; a level that has no children leaves nothing to do for the ones after it.
    """

    def deeper(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["level"], children))
        return F.struct(F.concat(state["found"], below).alias("found"), below.alias("level"))

    first = F.struct(start.alias("found"), start.alias("level"))
    return F.aggregate(F.array_repeat(F.lit(0), steps), first, deeper, lambda state: state["found"])


_PLACED = "array<struct<path:array<int>,node:variant>>"


def _terms(logic: Column) -> Column:
    """All terms of a rule tree with their paths; a term is a node without numbered members.

    No branch is longer than the number of opening braces in the text of the tree.
    """

    def members(placed: Column) -> Column:
        return F.transform(
            _numbered(placed["node"]),
            lambda e: F.struct(F.concat(placed["path"], F.array(e["key"].cast("int"))).alias("path"), e["value"].alias("node")),
        ).cast(_PLACED)

    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), logic.alias("node"))).cast(_PLACED)
    nodes = _walk(root, members, F.regexp_count(F.to_json(logic), F.lit(r"\{")))
    return F.filter(nodes, lambda n: (F.size(n["path"]) > 0) & (F.size(_numbered(n["node"])) == 0))


def _flow_nodes(element: Column) -> Column:
    """Flow nodes of all nesting levels; there are no more levels than members named Flow."""
    nodes = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), _empty_variants())
    steps = F.regexp_count(F.to_json(element), F.lit('"Flow"'))
    return _walk(nodes(element, "$.Payload.Flow"), lambda n: nodes(n, "$.Flow"), steps)


_SOURCES = "array<struct<target:string,logic:variant>>"


def _source(target: Column, logic: Column) -> Column:
    return F.struct(target.alias("target"), logic.alias("logic"))


def _branch_sources(element: Column) -> Column:
    return F.transform(_flow_nodes(element), lambda n: _source(_text(n, "$.FlowID"), F.try_variant_get(n, "$.BranchLogic", "variant")))


def _question_sources(element: Column, *paths: str) -> Column:
    tag = _text(element, "$.Payload.DataExportTag")
    return F.array(*[_source(tag, F.try_variant_get(element, p, "variant")) for p in paths])


_DISPLAY = "$.Payload.DisplayLogic"
_CUSTOM = "$.Payload.Validation.Settings.CustomValidation.Logic"


def _rule_rows(definitions: DataFrame, column: str, branches: bool, paths: Sequence[str]) -> DataFrame:
    """One row per rule term, from one parse of each document.

    ``path`` gives the numbers that lead to the term, ``group_no`` and ``term_no`` the first and the last of them.
    """
    element = F.col("element")
    nothing = F.array().cast(_SOURCES)
    found = F.when(F.col("kind") == "FL", _branch_sources(element).cast(_SOURCES) if branches else nothing)
    found = found.when(F.col("kind") == "SQ", _question_sources(element, *paths).cast(_SOURCES) if paths else nothing)
    rows = elements(definitions, column).select("survey", F.inline(found)).filter(F.col("logic").isNotNull())
    return rows.select("survey", "target", F.inline(_terms(F.col("logic")))).select(
        "survey",
        "target",
        F.concat_ws(".", F.col("path").cast("array<string>")).alias("path"),
        F.element_at("path", 1).alias("group_no"),
        F.element_at("path", -1).alias("term_no"),
        _text("node", "$.LogicType").alias("logic_type"),
        _text("node", "$.LeftOperand").alias("left"),
        _text("node", "$.Operator").alias("operator"),
        _text("node", "$.RightOperand").alias("right"),
        _text("node", "$.Conjuction").alias("conjunction"),
    )


def display_rules(definitions: DataFrame, column: str = "definition") -> DataFrame:
    """When a question is shown, keyed by its export tag."""
    return _rule_rows(definitions, column, False, [_DISPLAY])


def custom_validation_rules(definitions: DataFrame, column: str = "definition") -> DataFrame:
    """Conditions an answer has to meet, keyed by the question's export tag."""
    return _rule_rows(definitions, column, False, [_CUSTOM])


def branch_rules(definitions: DataFrame, column: str = "definition") -> DataFrame:
    """When a branch of the survey flow is taken, keyed by its flow id; at any depth of the flow."""
    return _rule_rows(definitions, column, True, [])


def rules(definitions: DataFrame, column: str = "definition") -> DataFrame:
    """Branch, display and custom validation rules in one table, from one scan of the definitions."""
    return _rule_rows(definitions, column, True, [_DISPLAY, _CUSTOM])


def validations(definitions: DataFrame, column: str = "definition") -> DataFrame:
    """``validations(survey, tag, requested, content_type, min_value, max_value, min_chars, min_choices, max_choices)``."""
    settings = "$.Payload.Validation.Settings"
    numeric = f"{settings}.ValidNumber"
    return _question_elements(definitions, column).select(
        "survey",
        _text("element", "$.Payload.DataExportTag").alias("tag"),
        (_text("element", f"{settings}.ForceResponse") == "RequestResponse").alias("requested"),
        _text("element", f"{settings}.ContentType").alias("content_type"),
        _text("element", f"{numeric}.Min").try_cast("double").alias("min_value"),
        _text("element", f"{numeric}.Max").try_cast("double").alias("max_value"),
        _text("element", f"{settings}.MinChars").try_cast("int").alias("min_chars"),
        _text("element", f"{settings}.MinChoices").try_cast("int").alias("min_choices"),
        _text("element", f"{settings}.MaxChoices").try_cast("int").alias("max_choices"),
    )
