"""Question/answer items made of dialogue turns: validation, error analytics, judge input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import generation, repair, validation
from assaykit.plans.registry import query, sql_list, table
from assaykit.schemas import REPAIR_CATEGORIES


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation results: a user turn is the question, the assistant turn right after it the item.

    The turn pairs meet in an equality join on (conversation, turn), whose keys are unique, so one long conversation
    is spread like many short ones.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    given = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    lines = F.split("answer", "\n", -1)
    item = F.struct(
        "question", "answer",
        F.split("question", "[.!?]", -1)[0].alias("equipment_problem"),
        F.split("question", ", ", -1).alias("tools_required"),
        lines.alias("steps"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("safety_info"),
        F.slice(lines, F.lit(4), F.size(lines)).alias("tips"),
    )
    return asked.join(given, ["conv_id", "turn"], "left").select(
        F.format_string("c%d_t%d", "conv_id", "turn").alias("trace_id"),
        F.when(F.col("answer").isNotNull(), item).alias("item"),
        generation.element(REPAIR_CATEGORIES, F.col("conv_id")).alias("category"),
        F.when(F.length("answer") % 7 == 0, F.array(F.lit("attempt 1: timeout"))).otherwise(
            F.array().cast("array<string>")).alias("generation_errors"),
    )


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate_items(results(spark, sf_dir))


def _few(field: str, length: str, least: int, blank: str, name: str) -> str:
    plural = "s" if least > 1 else ""
    return (f"CASE WHEN {length} < {least} THEN '{field}: List should have at least {least} item{plural} after validation, "
            f"not ' || {length} WHEN {blank} THEN '{field}: Value error, Each {name} must be a non-empty string' END")


def _blank(values: str) -> str:
    return f"len(list_filter({values}, lambda s: regexp_full_match(s, '\\s*'))) > 0"


def _short(field: str) -> str:
    return f"CASE WHEN len({field}) < 1 THEN '{field}: String should have at least 1 character' END"


ITEMS_SQL = f"""
WITH raw AS (
  SELECT printf('c%d_t%d', q.conv_id, q.turn) AS trace_id, {sql_list(REPAIR_CATEGORIES)}[(q.conv_id % 5 + 1)::INT] AS category,
    q.text AS question, a.text AS answer, string_split(a.text, chr(10)) AS lines, string_split(q.text, ', ') AS tools,
    string_split_regex(q.text, '[.!?]')[1] AS problem, coalesce(string_split(a.text, chr(10))[2], '') AS safety,
    string_split(a.text, chr(10))[4:] AS tips
  FROM conversations q LEFT JOIN conversations a
    ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user'),
found AS (
  SELECT *, CASE WHEN answer IS NULL THEN ['Generation produced no item'] ELSE list_filter([
      {_short('question')}, {_short('answer')},
      CASE WHEN len(problem) < 1 THEN 'equipment_problem: String should have at least 1 character' END,
      {_few('tools_required', 'len(tools)', 1, _blank('tools'), 'tool')},
      {_few('steps', 'len(lines)', 3, _blank('lines'), 'step')},
      CASE WHEN len(safety) < 1 THEN 'safety_info: String should have at least 1 character' END,
      {_few('tips', 'len(tips)', 1, _blank('tips'), 'tip')}], lambda e: e IS NOT NULL) END AS errors
  FROM raw),
items AS (SELECT *, len(errors) = 0 AS passed,
    list_concat(CASE WHEN len(answer) % 7 = 0 THEN ['attempt 1: timeout'] ELSE [] END, errors) AS all_errors FROM found)
"""


@query("item_validation", ITEMS_SQL + """
SELECT trace_id, category, passed, passed AS has_item, array_to_string(all_errors, '; ') AS errors FROM items""")
def item_validation(spark, sf_dir):
    return checked(spark, sf_dir).select(
        "trace_id", "metadata.category", F.col("metadata.passed_validation").alias("passed"),
        F.col("item").isNotNull().alias("has_item"),
        F.array_join("metadata.validation_errors", "; ").alias("errors"))


@query("item_pass_rate", ITEMS_SQL + """
SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (passed)::DOUBLE / count(*) AS pass_rate
FROM items""")
def item_pass_rate(spark, sf_dir):
    return validation.pass_rate(checked(spark, sf_dir))


@query("item_errors_by_field", ITEMS_SQL + """
SELECT string_split(e, ':')[1] AS field, count(*) AS n_errors
FROM (SELECT unnest(all_errors) AS e FROM items) GROUP BY 1""")
def item_errors_by_field(spark, sf_dir):
    errors = checked(spark, sf_dir).select(F.explode("metadata.validation_errors").alias("e"))
    return errors.groupBy(F.split("e", ":")[0].alias("field")).agg(F.count("*").alias("n_errors"))


@query("valid_split_union", ITEMS_SQL + """
SELECT category, count(*) FILTER (passed) AS n_valid, count(*) FILTER (NOT passed) AS n_invalid, count(*) AS n_all
FROM items GROUP BY category""")
def valid_split_union(spark, sf_dir):
    flagged = checked(spark, sf_dir).withColumn("is_valid", F.col("metadata.passed_validation"))
    valid, invalid = validation.split_valid(flagged)
    both = repair.with_corrected(valid, invalid)  # bag union
    return both.groupBy("metadata.category").agg(
        F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_invalid"),
        F.count("*").alias("n_all"))


ITEM_TEMPLATE = ("Asked {question}\nabout {equipment_problem}\ntold {answer}\n{steps}\nwith {tools_required}\nminding {safety_info}\n"
                 "and {tips}")


@query("judge_input", ITEMS_SQL + """
SELECT trace_id, 'Asked ' || question || chr(10) || 'about ' || problem || chr(10) || 'told ' || answer || chr(10)
  || array_to_string(list_transform(lines, lambda s, i: '  ' || i || '. ' || s), chr(10)) || chr(10)
  || 'with ' || array_to_string(tools, ', ') || chr(10) || 'minding ' || safety || chr(10) || 'and ' || array_to_string(tips, ', ') AS judge_text
FROM items WHERE passed""")
def judge_input(spark, sf_dir):
    with_item = checked(spark, sf_dir).where(F.col("item").isNotNull())
    return with_item.select("trace_id", generation.item_text(ITEM_TEMPLATE).alias("judge_text"))


JUDGE_FLAGS_SQL = """
SELECT field_path, category, count(*) AS n FROM (
  SELECT 'hallucination_score' AS field_path, l_linenumber AS v, 5 AS hi FROM lineitem
  UNION ALL SELECT 'awkward_language_score', (l_quantity % 8)::INT, 5 FROM lineitem
  UNION ALL SELECT 'quality_score', (l_quantity % 13)::INT, 10 FROM lineitem)
  CROSS JOIN (SELECT 'format_violation' AS category)
WHERE v NOT BETWEEN 0 AND hi GROUP BY ALL
"""


@query("judge_range_check", JUDGE_FLAGS_SQL)
def judge_range_check(spark, sf_dir):
    scores = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("hallucination_score"),
        (F.col("l_quantity") % 8).cast("int").alias("awkward_language_score"),
        (F.col("l_quantity") % 13).cast("int").alias("quality_score"))
    errors = scores.select(F.explode(validation.pair_judgement_errors()).alias("e"))
    return errors.groupBy("e.field_path", "e.category").agg(F.count("*").alias("n"))


@query("judge_flag_check", """
SELECT field_path, category, count(*) AS n FROM (
  SELECT 'incomplete_answer' AS field_path, CASE WHEN l_linenumber <> 7 THEN l_linenumber - 1 END AS v FROM lineitem
  UNION ALL SELECT 'poor_quality_tips', (l_quantity % 3)::INT FROM lineitem
), LATERAL (SELECT CASE WHEN v IS NULL THEN 'missing_field' ELSE 'format_violation' END AS category)
WHERE v IS NULL OR v NOT BETWEEN 0 AND 1 GROUP BY ALL""")
def judge_flag_check(spark, sf_dir):
    """Flags of the item judge are 0 or 1; anything else, or none, is an error."""
    flags = ["incomplete_answer", "poor_quality_tips"]
    scores = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") - 1).alias(flags[0]),
        (F.col("l_quantity") % 3).cast("int").alias(flags[1]))
    errors = scores.select(F.explode(validation.judgement_errors("", flags)).alias("e"))
    return errors.groupBy("e.field_path", "e.category").agg(F.count("*").alias("n"))
