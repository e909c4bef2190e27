"""Files, survey codebooks, rules, recoding, validation and harmonising."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators.checks import (
    answer_missing, choice_count_off, failure_counts, not_numeric, recode, too_short, with_checks,
)
from trialloom.operators.rules import breaches, facts, rule_truth
from trialloom.registry.inputs import SURVEY_SQL, read, survey
from trialloom.session import materialise, scratch_path, spread
from trialloom.sources.codebook import answers, choices, display_rules, questions, rules, validations
from trialloom.sources.harmonise import harmonise
from trialloom.sources.tables import load_snapshot, read_catalogue, read_csv, save_snapshot

# one definition per part, with the shapes real definitions have: keyed and listed options, a matrix, nested
# branches, rules joined by "or", elements that are no questions
DEFINITION = """{"SurveyEntry":{"SurveyName":"S%1$d"},"SurveyElements":[
{"Element":"BL","Payload":[{"Type":"Default"}]},
{"Element":"FL","Payload":{"Flow":[{"Type":"Standard","FlowID":"F0"},{"Type":"Branch","FlowID":"F1","BranchLogic":
{"0":{"0":{"LogicType":"Question","LeftOperand":"q://Q1/Displayed","Operator":"Displayed"},"Type":"If"},
"Type":"BooleanExpression"},"Flow":[{"Type":"Branch","FlowID":"F2","BranchLogic":{"0":{"0":
{"LogicType":"EmbeddedField","LeftOperand":"affirm","Operator":"EqualTo","RightOperand":"%2$d"},"Type":"If"},
"Type":"BooleanExpression"},"Flow":[{"Type":"Group","FlowID":"F3","Flow":[{"Type":"Group","FlowID":"F4","Flow":[
{"Type":"Branch","FlowID":"F5","BranchLogic":{"0":{"0":{"LogicType":"Question","LeftOperand":"q://Q4/2",
"Operator":"Selected"},"Type":"If"},"Type":"BooleanExpression"}}]}]}]}]}]}},
{"Element":"SQ","Payload":{"DataExportTag":"kind","QuestionID":"Q1","QuestionType":"MC","Selector":"SAVR",
"SubSelector":"TX","QuestionText":"<b>%3$s</b>","Choices":{"1":{"Display":" %4$s "},"10":{"Display":"%5$s"}},
"RecodeValues":{"1":"%2$d","10":0},"DisplayLogic":{"0":{"0":{"LogicType":"Question","LeftOperand":"q://Q2/1",
"Operator":"Selected"},"1":{"LogicType":"Question","LeftOperand":"q://Q2/2","Operator":"NotSelected",
"Conjuction":"Or"},"Type":"If"},"Type":"BooleanExpression"}}},
{"Element":"SQ","Payload":{"DataExportTag":"grid","QuestionID":"Q2","QuestionType":"Matrix","Selector":"Likert",
"SubSelector":"SingleAnswer","QuestionText":"Rate","Choices":{"1":{"Display":"%4$s"}},
"Answers":{"1":{"Display":"Very"},"2":{"Display":"Not"}},"RecodeValues":{"1":"5","2":"%2$d"}}},
{"Element":"SQ","Payload":{"DataExportTag":"listed","QuestionID":"Q3","QuestionType":"TE","Selector":"SL",
"QuestionText":"Number","Choices":[{"Display":"%5$s"},{"Display":"other"}],"Validation":{"Settings":{
"ForceResponse":"RequestResponse","Type":"ContentType","ContentType":"ValidNumber","MinChars":"%2$d",
"ValidNumber":{"Min":"0","Max":"100"},"CustomValidation":{"Logic":{"0":{"0":{"LogicType":"Question",
"LeftOperand":"q://Q3/text","Operator":"DoesNotContain","RightOperand":"%4$s"},"Type":"If"},
"Type":"BooleanExpression"}}}}}},
{"Element":"SQ","Payload":{"DataExportTag":"values","QuestionID":"Q4","QuestionType":"MC","Selector":"MAVR",
"QuestionText":"Pick","DisplayLogic":{"0":{"0":{"0":{"LogicType":"Question","LeftOperand":"q://Q2/1",
"Operator":"Selected"},"1":{"LogicType":"EmbeddedField","LeftOperand":"plans","Operator":"GreaterThan",
"RightOperand":"%2$d","Conjuction":"And"},"Type":"Group"},"1":{"LogicType":"Question","LeftOperand":"q://Q1/10",
"Operator":"Selected","Conjuction":"Or"},"Type":"If"},"Type":"BooleanExpression"},"Validation":{"Settings":{"ForceResponse":"OFF","MinChoices":"2","MaxChoices":"12"}}}}]}"""


def definitions(spark, sf_dir):
    parts = spread(read(spark, sf_dir, "part"), "p_partkey")
    one_line = DEFINITION.replace("\n", "")
    return parts.select(
        F.format_string(one_line, "p_partkey", "p_size", "p_name", "p_type", "p_brand").alias("definition")
    )


def q_codebook_questions(spark, sf_dir):
    return questions(definitions(spark, sf_dir))


def q_codebook_choices(spark, sf_dir):
    return choices(definitions(spark, sf_dir))


def q_codebook_answers(spark, sf_dir):
    return answers(definitions(spark, sf_dir))


def q_rules(spark, sf_dir):
    return rules(definitions(spark, sf_dir)).drop("group_no", "term_no")


def q_validations(spark, sf_dir):
    return validations(definitions(spark, sf_dir))


def event_codebook(events):
    """One definition per event type, its choices being the codes seen in the log."""
    k = F.get_json_object("props", "$.k")
    seen = events.select("event_type", k.alias("k")).distinct()
    code = (F.lit(100) - F.col("k").cast("int")).cast("string")
    per_type = seen.groupBy("event_type").agg(
        F.map_from_entries(
            F.collect_list(F.struct("k", F.struct(F.concat(F.lit("k is "), "k").alias("Display"))))
        ).alias("Choices"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("k").cast("int") < 90, F.struct(F.col("k"), code.alias("code"))))
        ).alias("RecodeValues"),
    )
    payload = F.struct(
        F.lit("k").alias("DataExportTag"),
        F.lit("MC").alias("QuestionType"),
        F.col("Choices"),
        F.col("RecodeValues"),
    )
    return per_type.select(
        F.to_json(
            F.struct(
                F.struct(F.col("event_type").alias("SurveyName")).alias("SurveyEntry"),
                F.array(F.struct(F.lit("SQ").alias("Element"), payload.alias("Payload"))).alias("SurveyElements"),
            )
        ).alias("definition")
    )


def q_recode(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    responses = events.select(
        "event_id", F.col("event_type").alias("survey"), F.get_json_object("props", "$.k").alias("k")
    )
    coded = recode(responses, ["k"], choices(event_codebook(events)), prefix="code_")
    return coded.select("event_id", "k", F.col("code_k").cast("int").alias("code_k"))


def _line_responses(spark, sf_dir):
    """Every order line as a response to its part's survey."""
    lines = read(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("S"), "l_partkey").alias("survey"),
        F.when(q > 40, "10").when(q > 30, "1").alias("kind"),
        F.when(n % 3 > 0, n % 3).alias("grid"),
        F.when(n < 5, F.concat((3 * q).cast("int"), F.when(q > 48, " or so").otherwise(""))).alias("listed"),
        F.when(q % 2 == 0, "1").alias("values"),
        q.cast("int").alias("plans"),
    )


_TAGS = {t: t for t in ("kind", "grid", "listed", "values")}


def q_rule_breaches(spark, sf_dir):
    """Answers that break a validation of their survey, by question."""
    out = breaches(_line_responses(spark, sf_dir), ["l_orderkey", "l_linenumber"], "survey", _TAGS, validations(definitions(spark, sf_dir)))
    kinds = ["missing", "not_numeric", "out_of_range", "too_short"]
    return out.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in kinds])


def q_rule_display(spark, sf_dir):
    """Display rules of a response's survey, and whether a question was answered though its rule hid it."""
    # lines have no key, so each gets a number, written once before it is joined on
    responses = materialise(_line_responses(spark, sf_dir).withColumn("row_id", F.monotonically_increasing_id()), "responses")
    book, ids = definitions(spark, sf_dir), ["row_id"]
    choices_ = {t: t for t in ("kind", "grid")}
    known = facts(responses, ids, "survey", choices_, ["plans"], questions(book))
    shown = rule_truth(responses, ids, "survey", display_rules(book), known)
    answered = responses.select(*ids, F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("string").isNotNull().alias("answered")) for t in ("kind", "values")])))
    return shown.join(answered.hint("merge"), [*ids, "target"]).groupBy("target", "holds").agg(F.count(F.lit(1)).alias("n"), F.count_if("answered").alias("n_answered"))


def q_validate(spark, sf_dir):
    rows = survey(spark, sf_dir)
    ticks = [f"tick_{i}" for i in range(1, 11)]
    ticked = rows.withColumns(
        {t: (F.col(f"mrmi_mrmi_{i}") == "Very Important").cast("int") for i, t in enumerate(ticks, start=1)}
    )
    checks = {
        "hours_missing": answer_missing("hours"),
        "hours_not_numeric": not_numeric("hours", 0, 10),
        "comp_not_numeric": not_numeric("oc_comp"),
        "goal_too_short": too_short("goal_setting", 6),
        "choices_off": choice_count_off(ticks, 1, 3),
    }
    return failure_counts(with_checks(ticked, checks), list(checks), ["group"])


def q_harmonise(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    suppliers = read(spark, sf_dir, "supplier")
    sources = {
        "MIT": customers.select(
            F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("gender_pcs"), F.col("c_mktsegment").alias("country")
        ),
        "Stanford": suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("sex")),
        # asks for the country twice, with codes of its own in ``pob``, and numbers the sexes the other way round
        "Harvard": customers.select(
            F.col("c_custkey").alias("id"),
            F.col("c_nationkey").alias("pob"),
            F.col("c_mktsegment").alias("country"),
            (F.col("c_custkey") % 4).cast("int").alias("gender_pcs"),
        ),
    }
    return harmonise(sources, recodes={"Harvard": {"sex": {1: 2, 2: 1}}})


def q_catalogue_dates(spark, sf_dir):
    """A catalogue file made of the orders: quoted commas, trailing blanks and two date formats."""
    orders = read(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("date") + F.expr("INTERVAL 15 YEAR")
    text = F.when(F.col("o_orderstatus") == "F", F.date_format(start, "M/d/yyyy")).otherwise(
        F.date_format(start, "MM/dd/yy")
    )
    columns = {
        "school": F.col("o_orderstatus"),
        "year_term": F.lit(""),
        "number": F.col("o_orderkey").cast("string"),
        "name": F.concat(F.lit('The "'), F.col("o_orderpriority"), F.lit('", a course  ')),
        "short_name": F.lit(None).cast("string"),
        "start": F.when(F.col("o_orderpriority") != "1-URGENT", text),
        "end": F.lit(""),
        "intermediate_outcome": F.lit("videos"),
        "on_demand": F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_totalprice") > 200000).cast("int").cast("string")),
        "new_course": F.lit("Rerun"),
        "Phase": F.lit(""),
        "course_url": F.lit("http://x.example.org "),
        "notes": F.lit(""),
    }
    path = scratch_path(spark, "catalogue")
    orders.select(*[c.alias(n) for n, c in columns.items()]).write.option("escape", '"').option(
        "ignoreTrailingWhiteSpace", False
    ).option("ignoreLeadingWhiteSpace", False).csv(path, header=True)
    return read_catalogue(spark, path).select(
        "school",
        F.col("number").cast("long").alias("number"),
        "name",
        F.date_format("start", "yyyy-MM-dd").alias("start"),
        "end",
        "on_demand",
        "course_url",
    ).withColumn("end", F.date_format("end", "yyyy-MM-dd"))


def q_csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    lines.withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0))).write.csv(path, header=True)
    loaded = read_csv(spark, path, "l_orderkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string")
    return loaded.groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("n_known"), F.sum("l_quantity").alias("quantity")
    )


def q_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    save_snapshot(read(spark, sf_dir, "customer"), path, partition_by=("c_mktsegment",))
    return load_snapshot(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


QUERIES = {
    "codebook_questions": q_codebook_questions,
    "codebook_choices": q_codebook_choices,
    "codebook_answers": q_codebook_answers,
    "rules": q_rules,
    "validations": q_validations,
    "recode": q_recode,
    "rule_breaches": q_rule_breaches,
    "rule_display": q_rule_display,
    "validate": q_validate,
    "harmonise": q_harmonise,
    "catalogue_dates": q_catalogue_dates,
    "csv_scan": q_csv_scan,
    "roundtrip": q_roundtrip,
}

_TICKS = " + ".join(f"CAST(coalesce(mrmi_mrmi_{i} = 'Very Important', false) AS INT)" for i in range(1, 11))

_RESPONSES = """r AS (SELECT p_size, CASE WHEN l_quantity > 40 THEN '10' WHEN l_quantity > 30 THEN '1' END AS kind,
             CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 END AS grid,
             CASE WHEN l_linenumber < 5 THEN concat(CAST(3 * l_quantity AS INT), CASE WHEN l_quantity > 48 THEN ' or so' ELSE '' END) END AS listed,
             CASE WHEN l_quantity % 2 = 0 THEN '1' END AS vals, CAST(l_quantity AS INT) AS plans
      FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ORACLE = {
    "codebook_questions": """
SELECT concat('S', p_partkey) AS survey, 'kind' AS tag, 'Q1' AS qid, 'MC' AS type, 'SAVR' AS selector, 'TX' AS sub_selector,
       concat('<b>', p_name, '</b>') AS text FROM part
UNION ALL SELECT concat('S', p_partkey), 'grid', 'Q2', 'Matrix', 'Likert', 'SingleAnswer', 'Rate' FROM part
UNION ALL SELECT concat('S', p_partkey), 'listed', 'Q3', 'TE', 'SL', NULL, 'Number' FROM part
UNION ALL SELECT concat('S', p_partkey), 'values', 'Q4', 'MC', 'MAVR', NULL, 'Pick' FROM part""",
    "codebook_choices": """
SELECT concat('S', p_partkey) AS survey, 'kind' AS tag, '1' AS choice_id, p_type AS label, CAST(p_size AS VARCHAR) AS recode
FROM part
UNION ALL SELECT concat('S', p_partkey), 'kind', '10', p_brand, '0' FROM part
UNION ALL SELECT concat('S', p_partkey), 'grid', '1', p_type, NULL FROM part
UNION ALL SELECT concat('S', p_partkey), 'listed', '1', p_brand, NULL FROM part
UNION ALL SELECT concat('S', p_partkey), 'listed', '2', 'other', NULL FROM part""",
    "codebook_answers": """
SELECT concat('S', p_partkey) AS survey, 'grid' AS tag, '1' AS answer_id, 'Very' AS label, '5' AS recode FROM part
UNION ALL SELECT concat('S', p_partkey), 'grid', '2', 'Not', CAST(p_size AS VARCHAR) FROM part""",
    "rules": """
SELECT concat('S', p_partkey) AS survey, 'F1' AS target, '0.0' AS path, 'Question' AS logic_type, 'q://Q1/Displayed' AS left,
       'Displayed' AS operator, NULL AS right, NULL AS conjunction FROM part
UNION ALL SELECT concat('S', p_partkey), 'F2', '0.0', 'EmbeddedField', 'affirm', 'EqualTo', CAST(p_size AS VARCHAR), NULL FROM part
UNION ALL SELECT concat('S', p_partkey), 'F5', '0.0', 'Question', 'q://Q4/2', 'Selected', NULL, NULL FROM part
UNION ALL SELECT concat('S', p_partkey), 'kind', '0.0', 'Question', 'q://Q2/1', 'Selected', NULL, NULL FROM part
UNION ALL SELECT concat('S', p_partkey), 'kind', '0.1', 'Question', 'q://Q2/2', 'NotSelected', NULL, 'Or' FROM part
UNION ALL SELECT concat('S', p_partkey), 'values', '0.0.0', 'Question', 'q://Q2/1', 'Selected', NULL, NULL FROM part
UNION ALL SELECT concat('S', p_partkey), 'values', '0.0.1', 'EmbeddedField', 'plans', 'GreaterThan', CAST(p_size AS VARCHAR), 'And' FROM part
UNION ALL SELECT concat('S', p_partkey), 'values', '0.1', 'Question', 'q://Q1/10', 'Selected', NULL, 'Or' FROM part
UNION ALL SELECT concat('S', p_partkey), 'listed', '0.0', 'Question', 'q://Q3/text', 'DoesNotContain', p_type, NULL FROM part""",
    "validations": """
WITH q AS (SELECT concat('S', p_partkey) AS survey, p_size FROM part)
SELECT survey, tag, CASE tag WHEN 'listed' THEN true WHEN 'values' THEN false END AS requested,
       CASE tag WHEN 'listed' THEN 'ValidNumber' END AS content_type,
       CASE tag WHEN 'listed' THEN 0.0::DOUBLE END AS min_value, CASE tag WHEN 'listed' THEN 100.0::DOUBLE END AS max_value,
       CASE tag WHEN 'listed' THEN p_size END AS min_chars, CASE tag WHEN 'values' THEN 2 END AS min_choices,
       CASE tag WHEN 'values' THEN 12 END AS max_choices
FROM q, (VALUES ('kind'), ('grid'), ('listed'), ('values')) t(tag)""",
    "recode": """
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, k, CASE WHEN CAST(k AS INT) < 90 THEN 100 - CAST(k AS INT) END AS code_k FROM e""",
    "rule_breaches": f"""
WITH {_RESPONSES}
SELECT tag, count(*) AS n, count(*) FILTER (tag = 'listed' AND v IS NULL) AS missing,
       count(*) FILTER (tag = 'listed' AND v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL) AS not_numeric,
       count(*) FILTER (tag = 'listed' AND coalesce(try_cast(v AS DOUBLE) NOT BETWEEN 0 AND 100, false)) AS out_of_range,
       count(*) FILTER (tag = 'listed' AND coalesce(length(v) < p_size, false)) AS too_short
FROM (SELECT 'kind' AS tag, kind AS v, p_size FROM r UNION ALL SELECT 'grid', grid::VARCHAR, p_size FROM r
      UNION ALL SELECT 'listed', listed, p_size FROM r UNION ALL SELECT 'values', vals, p_size FROM r) GROUP BY tag""",
    "rule_display": f"""
WITH {_RESPONSES},
t AS (SELECT 'kind' AS target, (grid IS NOT NULL AND grid = 1) OR NOT (grid IS NOT NULL AND grid = 2) AS holds, kind IS NOT NULL AS answered FROM r
      UNION ALL SELECT 'values', (grid IS NOT NULL AND grid = 1 AND plans > p_size) OR (kind IS NOT NULL AND kind = '10'), vals IS NOT NULL FROM r)
SELECT target, holds, count(*) AS n, count(*) FILTER (answered) AS n_answered FROM t GROUP BY 1, 2""",
    "validate": f"""
WITH s AS (SELECT *, {_TICKS} AS ticks FROM ({SURVEY_SQL})),
f AS (SELECT "group", hours IS NULL OR trim(hours) = '' AS a,
             hours <> '' AND coalesce(try_cast(hours AS DOUBLE) NOT BETWEEN 0 AND 10, true) AS b,
             oc_comp <> '' AND try_cast(oc_comp AS DOUBLE) IS NULL AS c,
             goal_setting <> '' AND length(goal_setting) < 6 AS d, ticks < 1 OR ticks > 3 AS e FROM s)
SELECT "group", count(*) AS n, count(*) FILTER (a) AS hours_missing, count(*) FILTER (b) AS hours_not_numeric,
       count(*) FILTER (c) AS comp_not_numeric, count(*) FILTER (d) AS goal_too_short, count(*) FILTER (e) AS choices_off,
       count(*) FILTER (a OR b OR c OR d OR e) AS any_failure FROM f GROUP BY 1""",
    "harmonise": """
SELECT c_custkey AS id, c_nationkey AS sex, c_mktsegment AS pob, 'MIT' AS institution, NULL::BIGINT AS pob_own_codes FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, NULL, 'Stanford', NULL FROM supplier
UNION ALL SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 END, c_mktsegment, 'Harvard', c_nationkey FROM customer""",
    "catalogue_dates": """
SELECT o_orderstatus AS school, o_orderkey AS number, concat('The "', o_orderpriority, '", a course') AS name,
       CASE WHEN o_orderpriority <> '1-URGENT'
            THEN strftime(CAST(o_orderdate AS DATE) + INTERVAL 15 YEAR, '%Y-%m-%d') END AS start,
       CAST(NULL AS VARCHAR) AS "end",
       CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_totalprice > 200000 AS INT) END AS on_demand,
       'http://x.example.org' AS course_url FROM orders""",
    "csv_scan": """
SELECT l_suppkey, l_returnflag, count(*) AS n, count(nullif(l_quantity, 7)) AS n_known,
       sum(nullif(l_quantity, 7)) AS quantity FROM lineitem GROUP BY 1, 2""",
    "roundtrip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
}
