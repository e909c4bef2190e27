from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trialloom.operators.rules import facts, rule_truth
from trialloom.operators.checks import (
    answer_missing, choice_count_off, failure_counts, not_numeric, recode, too_short, with_checks,
)
from trialloom.session import scratch_path, small_frame
from trialloom.sources.codebook import answers, choices, questions, read_definitions, rules, validations
from trialloom.sources.harmonise import harmonise
from trialloom.sources.tables import flexible_date, load_snapshot, read_catalogue, read_csv, save_snapshot


def term(left, operator, right=None, joiner=None):
    out = {"LogicType": "Question", "LeftOperand": left, "Operator": operator, "Type": "Expression"}
    if right is not None:
        out["RightOperand"] = right
    if joiner:
        out["Conjuction"] = joiner
    return out


def logic(*terms):
    return {"0": {**{str(i): t for i, t in enumerate(terms)}, "Type": "If"}, "Type": "BooleanExpression"}


def question(tag, **payload):
    return {"Element": "SQ", "Payload": {"DataExportTag": tag, "QuestionID": f"Q_{tag}", "QuestionType": "MC", **payload}}


SURVEY = {
    "SurveyEntry": {"SurveyName": "tiny"},
    "SurveyElements": [
        {"Element": "BL", "Payload": {"1": {"Type": "Default"}}},
        {"Element": "NT", "Payload": None},
        {
            "Element": "FL",
            "Payload": {
                "Type": "Root",
                "Flow": [
                    {"Type": "Standard", "FlowID": "F1"},
                    {
                        "Type": "Branch", "FlowID": "F2", "BranchLogic": logic(term("q://a", "Displayed")),
                        "Flow": [
                            {
                                "Type": "Branch", "FlowID": "F3", "BranchLogic": logic(term("plans", "EqualTo", "2")),
                                "Flow": [
                                    {
                                        "Type": "Branch", "FlowID": "F4", "BranchLogic": logic(term("x", "NotEqualTo", 1)),
                                        "Flow": [{"Type": "Group", "Flow": [{"Type": "Branch", "FlowID": "F6", "BranchLogic": logic(term("deep", "Displayed"))}]}],
                                    }
                                ],
                            }
                        ],
                    },
                ],
            },
        },
        question(
            "intent", Selector="SAVR", QuestionText="<b>How?</b>",
            Choices={"2": {"Display": "All "}, "3": {"Display": "Most"}, "10": {"Display": "None"}},
            RecodeValues={"2": "4", "3": 3},
            DisplayLogic=logic(term("q://s/1", "Selected"), term("q://s/2", "NotSelected", joiner="Or")),
        ),
        question(
            "grid", QuestionType="Matrix", SubSelector="SingleAnswer", Choices={"1": {"Display": "row"}},
            Answers={"1": {"Display": "Very"}, "2": {"Display": "Not"}}, RecodeValues={"1": "5", "2": "1"},
        ),
        question("listed", Choices=[{"Display": "a"}, {"Display": "b"}]),
        question("bare"),
        question(
            "hours",
            Validation={
                "Settings": {
                    "ForceResponse": "RequestResponse", "Type": "ContentType", "ContentType": "ValidNumber",
                    "ValidNumber": {"Min": "0", "Max": "100"}, "MinChars": "",
                    "CustomValidation": {"Logic": logic(term("q://h/text", "DoesNotContain", "x"))},
                }
            },
        ),
        question("values", Validation={"Settings": {"ForceResponse": "OFF", "MinChoices": "2", "MaxChoices": "12"}}),
    ],
}


@pytest.fixture(scope="module")
def definitions(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("defs")
    (folder / "tiny.json").write_text(json.dumps(SURVEY, indent=1))
    return read_definitions(spark, str(folder))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_questions(definitions):
    out = {r["tag"]: r for r in questions(definitions).collect()}
    assert set(out) == {"intent", "grid", "listed", "bare", "hours", "values"}
    assert (out["intent"]["survey"], out["intent"]["text"], out["grid"]["type"]) == ("tiny", "<b>How?</b>", "Matrix")


def test_choices_and_answers(definitions):
    assert rows(choices(definitions), "tag", "choice_id", "label", "recode") == sorted(
        [
            ("intent", "2", "All", "4"), ("intent", "3", "Most", "3"), ("intent", "10", "None", None),
            ("grid", "1", "row", None), ("listed", "1", "a", None), ("listed", "2", "b", None),
        ],
        key=str,
    )
    assert rows(answers(definitions), "tag", "answer_id", "label", "recode") == [
        ("grid", "1", "Very", "5"), ("grid", "2", "Not", "1")
    ]


def test_rules(definitions):
    out = rows(rules(definitions), "target", "left", "operator", "right", "conjunction")
    assert out == sorted(
        [
            ("F2", "q://a", "Displayed", None, None), ("F3", "plans", "EqualTo", "2", None),
            ("F4", "x", "NotEqualTo", "1", None), ("F6", "deep", "Displayed", None, None), ("intent", "q://s/1", "Selected", None, None),
            ("intent", "q://s/2", "NotSelected", None, "Or"), ("hours", "q://h/text", "DoesNotContain", "x", None),
        ],
        key=str,
    )


def test_rules_of_any_depth_from_one_scan(spark, tmp_path):
    flow, logic = {"FlowID": "F40", "BranchLogic": {"0": {"0": {"LogicType": "Question", "LeftOperand": "end"}}}}, {"LeftOperand": "leaf"}
    for i in range(39, 0, -1):
        flow = {"FlowID": f"F{i}", "Flow": [flow, {"FlowID": "x"}]}
    for i in range(12):
        logic = {str(i % 3): logic, "Type": "Group"}
    doc = {"SurveyEntry": {"SurveyName": "s"}, "SurveyElements": [
        {"Element": "FL", "Payload": {"Flow": [flow]}},
        {"Element": "SQ", "Payload": {"DataExportTag": "q", "DisplayLogic": logic}},
        {"Element": "SQ", "Payload": {"DataExportTag": "none", "DisplayLogic": "text"}},
        {"Element": "NT"},
    ]}
    path = str(tmp_path / "defs")
    spark.createDataFrame([(json.dumps(doc),), (None,)], "definition string").write.parquet(path)
    out = rules(spark.read.parquet(path))
    assert rows(out, "target", "path", "left") == [("F40", "0.0", "end"), ("q", "2.1.0.2.1.0.2.1.0.2.1.0", "leaf")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_recode_of_large_codebook(spark):
    """A choice listed twice counts once; rows stay single."""
    book = spark.range(100_000).select(F.lit("s").alias("survey"), F.lit("a").alias("tag"), F.col("id").cast("string").alias("choice_id"), (F.col("id") * 2).cast("string").alias("recode"))
    book = book.unionByName(book.limit(0)).unionByName(spark.createDataFrame([("s", "a", "7", "99"), ("s", "b", "1", "5"), ("t", "a", "1", "6")], book.schema))
    df = spark.createDataFrame([(1, "s", "7", 1), (2, "s", "99999", None), (3, "t", "1", 1), (4, None, "1", 1), (5, "s", None, 2)], "i int, survey string, a string, b int")
    out = recode(df, ["a", "b"], book, prefix="c_")
    assert sorted((r.i, r.c_a, r.c_b) for r in out.collect()) == [(1, 14.0, 5.0), (2, 199998.0, None), (3, 6.0, None), (4, None, None), (5, None, None)]


def test_rule_truth(spark):
    """Groups and terms fold from the deepest level; "and" binds tighter than "or"; what is unknown stays so."""
    terms = [
        # a or b and (c or not d)
        ("s", "t1", "0.0", "a", "Selected", None, None), ("s", "t1", "0.1", "b", "Selected", None, "Or"),
        ("s", "t1", "0.2.0", "c", "Selected", None, "And"), ("s", "t1", "0.2.1", "d", "NotSelected", None, "Or"),
        # (x = 10) or (y > 2)
        ("s", "t2", "0.0", "x", "EqualTo", "10", None), ("s", "t2", "1.0", "y", "GreaterThan", "2", "Or"),
        ("s", "t3", "0.0", "a", "Displayed", None, None), ("s", "t3", "0.1", "b", "Selected", None, "And"),
    ]
    table = spark.createDataFrame(terms, "survey string, target string, path string, left string, operator string, right string, conjunction string")
    cases = [(i, [k for k, on in zip("abcd", f"{i:04b}") if on == "1"], x, y) for i, (x, y) in enumerate([("10", "1"), ("10.0", None), ("9", "3"), (None, None)] * 4)]
    responses = spark.createDataFrame([(i, "s") for i, *_ in cases] + [(99, "other")], "i int, survey string")
    known = [(i, k, None) for i, on, _, _ in cases for k in on] + [(i, k, v) for i, _, x, y in cases for k, v in (("x", x), ("y", y)) if v]
    out = {(r.i, r.target): r.holds for r in rule_truth(responses, ["i"], "survey", table, spark.createDataFrame(known, "i int, left string, value string")).collect()}
    for i, on, x, y in cases:
        a, b, c, d = (k in on for k in "abcd")
        assert out[i, "t1"] == (a or (b and (c or not d)))
        left, right = None if x is None else float(x) == 10, None if y is None else float(y) > 2
        assert out[i, "t2"] == (True if left or right else None if None in (left, right) else False)
        assert out[i, "t3"] == (None if b else False)
    assert len(out) == 48


def test_rules_of_large_codebook(spark):
    """A codebook of many rows in small files is not broadcast, nor are responses; one of few rows is."""
    n = 250_000
    book = spark.range(n).select(F.concat(F.lit("s"), "id").alias("survey"), F.lit("t").alias("target"), F.lit("0.0").alias("path"), F.lit("q://Q1/1").alias("left"), F.lit("Selected").alias("operator"), F.lit(None).cast("string").alias("right"), F.lit(None).cast("string").alias("conjunction"))
    tags = book.select("survey", F.lit("a").alias("tag"), F.lit("Q1").alias("qid"))
    # one response and its answer come twice
    responses = spark.createDataFrame([(1, "s1", "1"), (2, "s2", "2"), (3, f"s{n}", "1"), (4, None, "1"), (1, "s1", "1"), (5, "s5", None)], "i int, survey string, a string")

    def truth(limit):
        known = facts(responses, ["i"], "survey", {"a": "a"}, [], tags.filter(limit))
        out = rule_truth(responses, ["i"], "survey", book.filter(limit), known)
        return sorted((r.i, r.holds) for r in out.collect()), "BroadcastExchange" in out._jdf.queryExecution().executedPlan().toString()

    assert truth("true") == ([(1, True), (2, False), (5, False)], False)
    assert truth("survey IN ('s1', 's2')") == ([(1, True), (2, False)], True)


def test_rule_terms_beside_facts(spark):
    """A fact with two values counts with both; a comparison without its fact is unknown."""
    terms = [("s", "t", "0.0", "x", "GreaterThan", "5", None), ("s", "u", "0.0", "x", "NotEqualTo", "a", None), ("s", "u", "0.1", "y", "Selected", None, "And"), ("s", None, "0.0", "x", "Selected", None, None)]
    table = spark.createDataFrame(terms, "survey string, target string, path string, left string, operator string, right string, conjunction string")
    responses = spark.createDataFrame([(i, "s") for i in range(4)], "i int, survey string")
    known = spark.createDataFrame([(0, "x", "7"), (0, "x", "6"), (0, "y", None), (1, "x", "7"), (1, "x", "4"), (2, "y", None), (None, "x", "7")], "i int, left string, value string")
    out = {(r.i, r.target): r.holds for r in rule_truth(responses, ["i"], "survey", table, known).collect()}
    assert [out[i, "t"] for i in range(4)] == [True, False, None, None]
    assert [out[i, "u"] for i in range(4)] == [True, False, None, False]
    assert [out[i, None] for i in range(4)] == [True, True, False, False]


def test_validations(definitions):
    out = {r["tag"]: r for r in validations(definitions).collect()}
    assert (out["hours"]["requested"], out["hours"]["max_value"], out["hours"]["min_chars"]) == (True, 100.0, None)
    assert (out["values"]["requested"], out["values"]["min_choices"], out["bare"]["requested"]) == (False, 2, None)


def test_recode(spark, definitions):
    responses = spark.createDataFrame(
        [(1, "tiny", "2", 3), (2, "tiny", "10", None), (3, "other", "2", 2), (4, "tiny", "99", 2)],
        "i int, survey string, intent string, other int",
    )
    out = rows(recode(responses, ["intent"], choices(definitions)), "i", "intent")
    assert out == [(1, 4.0), (2, None), (3, None), (4, None)]


def test_checks(spark):
    df = spark.createDataFrame(
        [("5", "long enough", 1, 1), ("500", "tiny", 1, None), ("abc", None, 0, 0), ("", " ", None, None), (None, "", 1, 1)],
        "h string, essay string, a int, b int",
    )
    names = {
        "missing": answer_missing("h"), "number": not_numeric("h", 0, 100), "short": too_short("essay", 10),
        "choices": choice_count_off(["a", "b"], 1, 1),
    }
    out = with_checks(df, names)
    assert [tuple(r)[4:] for r in out.collect()] == [
        (False, False, False, True, 1), (False, True, True, False, 2), (False, True, False, True, 2),
        (True, False, False, True, 2), (True, False, False, True, 2),
    ]
    assert tuple(failure_counts(out, list(names)).first()) == (5, 2, 2, 1, 4, 5)


def test_flexible_date(spark):
    texts = ["9/22/2016", "12/23/16", "09/27/2016", "1/4/17", " 6/1/16 ", "", None, "soon"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(flexible_date("t")).collect()] == [
        dt.date(2016, 9, 22), dt.date(2016, 12, 23), dt.date(2016, 9, 27), dt.date(2017, 1, 4), dt.date(2016, 6, 1),
        None, None, None,
    ]


def test_catalogue(spark, tmp_path):
    path = tmp_path / "courses.csv"
    path.write_text(
        '"school","year_term","number","name","short_name","start","end","intermediate_outcome","on_demand","new_course",'
        '"Phase","course_url","notes"\n'
        '"A","T1","X1","Ballet, and ""Riots"" ",,"9/22/2016","12/23/16","videos",0,"Rerun",,"http://e.org/a ",\n'
        '"B",,,"Untimed",,,,"assessments",,,,,\n'
    )
    first, second = read_catalogue(spark, str(path)).orderBy("school").collect()
    assert (first["name"], first["on_demand"], first["course_url"]) == ('Ballet, and "Riots"', 0, "http://e.org/a")
    assert (first["start"], first["end"], first["short_name"]) == (dt.date(2016, 9, 22), dt.date(2016, 12, 23), None)
    assert (second["start"], second["on_demand"], second["number"]) == (None, None, None)


def test_snapshots_and_csv(spark):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"q', 1.5)], "i int, s string, x double")
    path = scratch_path(spark, "test")
    save_snapshot(df, path)
    save_snapshot(df, path)
    assert rows(load_snapshot(spark, path), "i", "s", "x") == rows(df, "i", "s", "x")
    csv = scratch_path(spark, "test")
    df.write.option("escape", '"').csv(csv, header=True)
    assert rows(read_csv(spark, csv, df.schema), "i", "s", "x") == rows(df, "i", "s", "x")


def test_harmonise(spark):
    out = harmonise(
        {
            "MIT": spark.createDataFrame([(1, 2)], "id int, gender_pcs int"),
            "Stanford": spark.createDataFrame([(3, 1, "z")], "id int, sex int, pob string"),
        }
    )
    assert rows(out, "id", "sex", "pob", "institution") == [(1, 2, None, "MIT"), (3, 1, "z", "Stanford")]


def test_harmonise_aligns_codes(spark):
    out = harmonise(
        {
            "Harvard": spark.createDataFrame([(1, 185, 187), (2, 9, None)], "id int, pob int, country int"),
            "MIT": spark.createDataFrame([(3, 187)], "id int, country int"),
        },
        recodes={"Harvard": {"pob_own_codes": {185: 187}}},
    )
    got = rows(out, "id", "pob", "pob_own_codes", "institution")
    assert got == [(1, 187, 187, "Harvard"), (2, None, None, "Harvard"), (3, 187, None, "MIT")]


def test_small_frame_is_local(spark):
    schema = spark.createDataFrame([(1, "a")], "i int, s string").schema
    df = small_frame(spark, [(1, None), (2, "b")], schema)
    assert rows(df, "i", "s") == [(1, None), (2, "b")]
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
