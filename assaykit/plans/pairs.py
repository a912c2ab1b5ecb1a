"""Validation, labels, analytics and repair of resume/job pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import dates, text
from assaykit.operators import agreement, failures, labels, repair, validation
from assaykit.operators.failures import flag_correlation
from assaykit.operators.hotkeys import last_per_key
from assaykit.plans.pair_view import (
    AS_OF, PAIRS_SQL, PROFICIENCY_LEVELS, SKILLS, _normal, _parse, _pick, label_ctes_sql, pairs,
)
from assaykit.plans.registry import query, sql_list, sql_strings, table
from assaykit.schemas import FIT_LEVELS, PAIR_FAILURES, WRITING_STYLES
from assaykit.session import store


def pid() -> Column:
    return F.col("metadata.pair_id").alias("pair_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat labels with their group fields, from one pass over the pairs."""
    keep = [
        F.col("metadata.fit_level").alias("fit_level"), F.col("metadata.writing_style").alias("writing_style"),
        F.col("job.metadata.is_niche_role").alias("is_niche")]
    return labels.with_failure_totals(labels.label_pairs(pairs(spark, sf_dir), AS_OF, keep=keep))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate_pairs(pairs(spark, sf_dir), AS_OF)


# ---------------------------------------------------------------- scalar functions

SPELLINGS_SQL = f"""
WITH s AS (SELECT {_pick(SKILLS, 'p_partkey')} || ' ' || p_size AS skill, p_brand || '.js' AS lib, p_name AS name FROM part),
u AS (SELECT skill AS raw FROM s UNION ALL SELECT lib FROM s UNION ALL SELECT name FROM s)
SELECT {_normal('raw')} AS skill, count(*) AS n FROM u GROUP BY 1
"""


@query("skill_normalize", SPELLINGS_SQL)
def skill_normalize(spark, sf_dir):
    from assaykit.operators.generation import element

    part = table(spark, sf_dir, "part")
    raw = part.select(F.explode(F.array(
        F.concat(element(SKILLS, F.col("p_partkey")), F.lit(" "), F.col("p_size").cast("string")),
        F.concat("p_brand", F.lit(".js")), "p_name")).alias("raw"))
    return raw.groupBy(text.normalize_skill(F.col("raw")).alias("skill")).agg(F.count("*").alias("n"))


@query("skill_jaccard", PAIRS_SQL + "SELECT pair_id, skills_overlap, n_own::INT AS n_skills FROM lab JOIN overlap USING (k)")
def skill_jaccard(spark, sf_dir):
    career = labels.with_career(pairs(spark, sf_dir), AS_OF)
    return career.select(pid(), labels.skills_overlap().alias("skills_overlap"), F.size(labels.OWNED).alias("n_skills"))


@query("date_parse", PAIRS_SQL + f"""
SELECT pair_id, i::INT AS pos, start_date, strftime(sd, '%Y-%m-%d') AS parsed FROM ex JOIN base USING (k)""")
def date_parse(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(pid(), F.posexplode("resume.experience.start_date").alias("pos", "start_date"))
    return rows.withColumn("parsed", F.date_format(dates.parse_date(F.col("start_date")), "yyyy-MM-dd"))


@query("experience_years", PAIRS_SQL + "SELECT pair_id, y::DOUBLE AS years FROM base JOIN yrs USING (k)")
def experience_years(spark, sf_dir):
    years = dates.experience_years(F.col("resume.experience"), F.lit(AS_OF).cast("date"))
    return pairs(spark, sf_dir).select(pid(), years.alias("years"))


@query("title_rank", PAIRS_SQL + """
SELECT pair_id, latest.title, title_rank, years_rank FROM base JOIN ranks USING (k) LEFT JOIN latest USING (k)""")
def title_rank(spark, sf_dir):
    career = labels.with_career(pairs(spark, sf_dir), AS_OF)
    return career.select(
        pid(), F.col(labels.TITLE).alias("title"), text.title_rank(F.col(labels.TITLE)).alias("title_rank"),
        dates.years_rank(F.col(labels.YEARS)).alias("years_rank"))


@query("buzzword_count", PAIRS_SQL + "SELECT pair_id, n_buzz::INT AS n_buzz FROM base JOIN buzz USING (k)")
def buzzword_count(spark, sf_dir):
    return pairs(spark, sf_dir).select(pid(), labels.buzzword_count().alias("n_buzz"))


DOC_PHRASES = ["the", "with (that|this)", "and.of", "nicht", "un(e)?", "que"]


# Every word stands between the marks 1 and 2, which takes the place of word boundaries beyond ASCII.
MARKED_PHRASES = "the|with\\x02 \\x01(that|this)|and[^\\n]of|and\\x02[^\\n\\x01\\x02]\\x01of|nicht|une?|que"


@query("phrase_density", f"""
SELECT doc_id, len(regexp_extract_all(t, '(?i)\\x01({MARKED_PHRASES})\\x02')) AS n_phrases
FROM (SELECT doc_id, regexp_replace(text, '([\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+)', chr(1) || '\\1' || chr(2), 'g') AS t FROM documents)""")
def phrase_density(spark, sf_dir):
    """Phrases of several languages on the text of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.phrase_count(F.col("text"), DOC_PHRASES).alias("n_phrases"))


# ---------------------------------------------------------------- labels

def _single(name: str, expression) -> None:
    @query(name, PAIRS_SQL + f"SELECT pair_id, {name} FROM lab")
    def plan(spark, sf_dir):
        return labels.with_career(pairs(spark, sf_dir), AS_OF).select(pid(), expression().alias(name))


_single("experience_mismatch", labels.experience_mismatch)
_single("seniority_mismatch", labels.seniority_mismatch)
_single("missing_core_skills", labels.missing_core_skills)
_single("hallucinated_skills", labels.hallucinated_skills)
_single("awkward_language", labels.awkward_language)


@query("all_labels", PAIRS_SQL + f"SELECT pair_id, skills_overlap, {', '.join(PAIR_FAILURES)} FROM lab")
def all_labels(spark, sf_dir):
    return labels.label_pairs(pairs(spark, sf_dir), AS_OF)


@query("failure_histogram", PAIRS_SQL + """
SELECT any_failure, failure_count, count(*) AS n FROM lab GROUP BY ALL""")
def failure_histogram(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("any_failure", "failure_count").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- validation

@query("pair_validation", PAIRS_SQL + """
SELECT pair_id, count(err.k) = 0 AS is_valid, count(err.k)::INT AS error_count,
  coalesce(string_agg(field_path || '=' || category || ':' || coalesce(invalid_value, '') || ':' || message, '; '
    ORDER BY rule, pos), '') AS errors
FROM base LEFT JOIN err ON base.k = err.k GROUP BY pair_id""")
def pair_validation(spark, sf_dir):
    line = lambda e: F.concat(
        e["field_path"], F.lit("="), e["category"], F.lit(":"), F.coalesce(e["invalid_value"], F.lit("")), F.lit(":"),
        e["message"])
    return validated(spark, sf_dir).select(
        pid(), "is_valid", "error_count", F.array_join(F.transform("errors", line), "; ").alias("errors"))


@query("pair_errors_by_category", PAIRS_SQL + """
SELECT pair_id, category, count(*)::INT AS n_errors, string_agg(message, '; ' ORDER BY rule, pos) AS messages
FROM err JOIN base ON err.k = base.k GROUP BY pair_id, category""")
def pair_errors_by_category(spark, sf_dir):
    keyed = validated(spark, sf_dir).select(pid(), "errors")
    grouped = validation.errors_by_category(keyed, "pair_id")
    return grouped.withColumn("messages", F.array_join("messages", "; "))


@query("field_failures", PAIRS_SQL + "SELECT field_path, count(*) AS n_errors FROM err GROUP BY field_path")
def field_failures(spark, sf_dir):
    return validation.field_failures(validated(spark, sf_dir))


@query("top_fields", PAIRS_SQL + """
SELECT field_path, count(*) AS n_errors FROM err GROUP BY field_path ORDER BY n_errors DESC, field_path LIMIT 15""")
def top_fields(spark, sf_dir):
    return validation.field_failures(validated(spark, sf_dir)).limit(15)


_END = "end_date IS NOT NULL AND lower(end_date) <> 'present'"
_FULL = "'\\d{4}-\\d{1,2}-\\d{1,2}'"
_MONTH = "'\\d{4}-\\d{1,2}'"


@query("pair_schema_checks", PAIRS_SQL + f"""
, e AS (
  SELECT k, 'resume.contact.email' AS field_path FROM base WHERE k % 29 = 0
  UNION ALL SELECT k, 'resume.contact.phone' FROM base WHERE len(regexp_replace(phone, '\\D', '', 'g')) < 10
  UNION ALL SELECT k, 'resume.education' FROM base WHERE NOT has_education
  UNION ALL SELECT k, 'resume.education[0].graduation_date' FROM base WHERE has_education AND {_parse('graduation')} IS NULL
  UNION ALL SELECT k, 'resume.education[0].gpa' FROM base WHERE has_education AND k % 3 <> 0 AND (k % 45) / 10.0 > 4.0
  UNION ALL SELECT k, 'resume.experience[' || i || '].responsibilities' FROM ex WHERE k % 71 = 0
  UNION ALL SELECT k, 'resume.experience[' || i || '].end_date' FROM ex WHERE {_END} AND {_parse('end_date')} < sd
    AND ((regexp_full_match(start_date, {_FULL}) AND regexp_full_match(end_date, {_FULL}))
      OR (regexp_full_match(start_date, {_MONTH}) AND regexp_full_match(end_date, {_MONTH})))
  UNION ALL SELECT k, 'resume.skills' FROM base WHERE n_skills = 0
  UNION ALL SELECT k, 'resume.skills[' || j || '].proficiency_level' FROM sk WHERE prof NOT IN ({sql_strings(PROFICIENCY_LEVELS)})
  UNION ALL SELECT k, 'resume.skills[' || j || '].years_used' FROM sk WHERE used < 0
  UNION ALL SELECT k, 'resume.summary' FROM base WHERE len(summary) < 10)
SELECT pair_id, field_path FROM e JOIN base ON e.k = base.k""")
def pair_schema_checks(spark, sf_dir):
    return pairs(spark, sf_dir).select(pid(), F.explode(validation.resume_schema_errors()).alias("e")).select(
        "pair_id", "e.field_path")


@query("job_schema_checks", """
SELECT printf('job_%d', c_custkey) AS job_id, unnest(list_filter([
  CASE WHEN c_custkey % 37 = 0 THEN 'job.description' END,
  CASE WHEN c_custkey % 41 = 0 THEN 'job.requirements.required_skills' END,
  CASE WHEN c_custkey % 43 = 0 THEN 'job.requirements.experience_years' END], lambda x: x IS NOT NULL)) AS field_path
FROM customer""")
def job_schema_checks(spark, sf_dir):
    from assaykit.plans.pair_view import jobs

    return jobs(spark, sf_dir).select(
        F.col("job.metadata.trace_id").alias("job_id"), F.explode(validation.job_schema_errors()).alias("e")).select(
        "job_id", "e.field_path")


# ---------------------------------------------------------------- analytics

def _rates_sql(group: str, name: str, source: str = "lab") -> str:
    return " UNION ALL ".join(
        f"SELECT {group} AS {name}, '{f}' AS mode, sum({f}::INT)::BIGINT AS failures, count(*) AS n, "
        f"sum({f}::INT)::DOUBLE / count(*) AS rate FROM {source} GROUP BY 1" for f in PAIR_FAILURES)


@query("labels_by_level", PAIRS_SQL + _rates_sql("fit_level", "fit_level"))
def labels_by_level(spark, sf_dir):
    return agreement.rates_by_level(labelled(spark, sf_dir))


@query("labels_by_style", PAIRS_SQL + _rates_sql("writing_style", "writing_style"))
def labels_by_style(spark, sf_dir):
    return agreement.rates_by_style(labelled(spark, sf_dir))


ROLE = "CASE WHEN is_niche THEN 'niche' ELSE 'standard' END"


@query("niche_vs_standard", PAIRS_SQL + _rates_sql(ROLE, "role"))
def niche_vs_standard(spark, sf_dir):
    return agreement.niche_vs_standard(labelled(spark, sf_dir))


@query("label_correlation", PAIRS_SQL + " UNION ALL ".join(
    f"SELECT '{a}' AS mode_a, '{b}' AS mode_b, CASE WHEN stddev_pop({a}::INT) > 0 AND stddev_pop({b}::INT) > 0 "
    f"THEN round(corr({a}::INT, {b}::INT), 6) END AS correlation FROM lab"
    for a in PAIR_FAILURES for b in PAIR_FAILURES))
def label_correlation(spark, sf_dir):
    matrix = flag_correlation(labelled(spark, sf_dir), PAIR_FAILURES)
    return matrix.withColumn("correlation", F.round("correlation", 6))


@query("labels_joined", PAIRS_SQL + f"""
SELECT pair_id, fit_level, writing_style, is_niche, skills_overlap, {', '.join(PAIR_FAILURES)}, any_failure, failure_count
FROM lab WHERE NOT EXISTS (SELECT 1 FROM err WHERE err.k = lab.k)""")
def labels_joined(spark, sf_dir):
    """Labels exist for valid pairs only; pairs without one drop out of the flat table."""
    valid, _ = validation.split_valid(validated(spark, sf_dir))
    return agreement.labelled_pairs(pairs(spark, sf_dir), labels.label_pairs(valid, AS_OF))


@query("label_last_wins", """
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def label_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return last_per_key(rows, ["user_id", "event_type"], "event_id")


@query("unmatched_repairs", PAIRS_SQL + """
, inv AS (SELECT DISTINCT k FROM err), val AS (SELECT k, count(*) AS n FROM err WHERE rule <> 6 GROUP BY k)
SELECT pair_id, coalesce(n, 0)::INT AS known_errors, n IS NULL AS given_up
FROM inv JOIN base ON inv.k = base.k LEFT JOIN val ON inv.k = val.k""")
def unmatched_repairs(spark, sf_dir):
    """The stored validations lack those whose only error is the phone; these pairs cannot be repaired."""
    checked = validated(spark, sf_dir).where("NOT is_valid").select(pid(), "errors")
    known = checked.select("pair_id", F.size(F.filter(
        "errors", lambda e: e["field_path"] != "resume.contact.phone")).alias("known_errors")).where("known_errors > 0")
    matched, lost = repair.match_validations(checked.select("pair_id"), known)
    return matched.withColumn("given_up", F.lit(False)).unionByName(
        lost.withColumn("known_errors", F.lit(0)).withColumn("given_up", F.lit(True)))


_TOPICS = [("hallucination", "hallucinated_skills", "hallucination_score"),
           ("awkward_language", "awkward_language", "awkward_language_score")]
PAIR_JUDGE_SQL = """
, judge AS (SELECT k, pair_id, (k % 6)::INT AS hallucination_score, (k // 3 % 6)::INT AS awkward_language_score,
    (k % 11)::INT AS quality_score FROM base)
"""


def pair_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's scores for every pair, from the order key."""
    k = F.substring_index("resume.metadata.trace_id", "_", -1).cast("long")
    return pairs(spark, sf_dir).select(
        pid(), (k % 6).cast("int").alias("hallucination_score"),
        (F.floor(k / 3) % 6).cast("int").alias("awkward_language_score"), (k % 11).cast("int").alias("quality_score"))


@query("pair_gap_analysis", PAIRS_SQL + PAIR_JUDGE_SQL + " UNION ALL ".join(
    f"SELECT '{t}' AS topic, count(*) FILTER ({f}) AS rule_flags, count(*) FILTER ({s} >= 3) AS judge_flags, "
    f"count(*) FILTER ({f} AND {s} >= 3) AS both_flags FROM judge JOIN lab USING (k)"
    for t, f, s in _TOPICS))
def pair_gap_analysis(spark, sf_dir):
    return agreement.gap_analysis(
        pair_judge(spark, sf_dir), labels.label_pairs(pairs(spark, sf_dir), AS_OF),
        {"hallucination": ("hallucinated_skills", "hallucination_score"),
         "awkward_language": ("awkward_language", "awkward_language_score")})


# ---------------------------------------------------------------- repair

REPAIR_SQL = PAIRS_SQL + """
, state AS MATERIALIZED (
  SELECT base.k, pair_id, count(err.k) AS n_errors,
    coalesce(bool_or(rule = 6), FALSE) AS phone, coalesce(bool_or(rule = 3), FALSE) AS blank,
    coalesce(bool_or(rule = 2 OR message = 'start_date is in the future'), FALSE) AS future,
    coalesce(bool_or(rule IN (4, 5) OR message = 'start_date could not be parsed'), FALSE) AS stuck
  FROM base LEFT JOIN err ON base.k = err.k GROUP BY base.k, pair_id),
fixed AS MATERIALIZED (
  SELECT *, CASE WHEN n_errors = 0 THEN 0 WHEN stuck OR blank THEN 3 WHEN future THEN 2 ELSE 1 END AS attempts,
    NOT stuck AS is_valid FROM state)
"""


def fix(df: DataFrame, attempt: int) -> DataFrame:
    return repair.deterministic_fix(df, attempt, AS_OF)


def repaired(spark: SparkSession, sf_dir: str, checked: DataFrame | None = None, only_invalid: bool = False) -> DataFrame:
    return repair.repair_loop(validated(spark, sf_dir) if checked is None else checked, fix,
                              lambda df: validation.validate_pairs(df, AS_OF), only_invalid=only_invalid)


@query("repair_loop", REPAIR_SQL + "SELECT pair_id, attempts, is_valid, attempts AS stamped FROM fixed")
def repair_loop(spark, sf_dir):
    return repaired(spark, sf_dir).select(
        pid(), "attempts", "is_valid", F.col("metadata.correction_attempts").alias("stamped"))


@query("repair_stats", REPAIR_SQL + """
, lost AS (SELECT k FROM err GROUP BY k HAVING count(*) = count(*) FILTER (rule = 6)),
known AS (SELECT * FROM fixed ANTI JOIN lost USING (k)),
t AS (SELECT count(*) FILTER (attempts > 0)::DOUBLE + (SELECT count(*) FROM lost) AS n,
    count(*) FILTER (attempts > 0 AND is_valid)::DOUBLE AS ok FROM known)
SELECT 'total_pairs' AS name, n AS value FROM t UNION ALL SELECT 'corrected', ok FROM t
UNION ALL SELECT 'permanently_failed', n - ok FROM t
UNION ALL SELECT 'correction_rate', CASE WHEN n = 0 THEN 0.0 ELSE ok / n END FROM t
UNION ALL SELECT 'attempts_' || attempts, count(*)::DOUBLE FROM known WHERE attempts > 0 GROUP BY attempts""")
def repair_stats(spark, sf_dir):
    """Pairs whose only error is the phone have no stored validation here, so they are given up without an attempt."""
    invalid = store(validated(spark, sf_dir).where("NOT is_valid"), "invalid-pairs")
    known = F.exists("errors", lambda e: e["field_path"] != "resume.contact.phone")
    return repair.repair_stats(repaired(spark, sf_dir, invalid.where(known), only_invalid=True), invalid.where(~known).select(pid()))


@query("failure_reasons", REPAIR_SQL + """
SELECT pair_id, field_path || ': ' || message AS reason FROM fixed JOIN err USING (k)
WHERE NOT fixed.is_valid AND (rule IN (4, 5) OR message = 'start_date could not be parsed')""")
def failure_reasons(spark, sf_dir):
    return repair.failure_reasons(repaired(spark, sf_dir, only_invalid=True))


# ---------------------------------------------------------------- report

_GROUPS = [("by_fit_level", "fit_level"), ("by_template", "writing_style"), ("niche_vs_standard", ROLE)]


# The labelled population: valid pairs and those that repair made valid, with the labels of their repaired state.
LABELLED_SQL = REPAIR_SQL + f"""
, r_ex AS (SELECT * FROM ex WHERE sd IS NULL OR sd <= DATE '{AS_OF}'), r_sk AS (SELECT * FROM sk WHERE trim(name) <> ''),
{label_ctes_sql('r_')},
pop AS MATERIALIZED (SELECT r_lab.* FROM r_lab JOIN fixed USING (k) WHERE fixed.is_valid)
"""


@query("quality_report", LABELLED_SQL + PAIR_JUDGE_SQL + f"""
, t AS (SELECT count(*) FILTER (attempts > 0)::DOUBLE AS n, count(*) FILTER (attempts > 0 AND is_valid)::DOUBLE AS ok,
    count(*)::DOUBLE AS total FROM fixed),
seen AS (SELECT * FROM pop JOIN judge USING (k))
SELECT section, name, round(value, 9) AS value FROM (
  SELECT 'totals' AS section, 'pairs_generated' AS name, total AS value FROM t
  UNION ALL SELECT 'totals', 'valid_pairs', total - n + ok FROM t UNION ALL SELECT 'totals', 'invalid_pairs', n FROM t
  UNION ALL SELECT 'overall', 'overall_failure_rate', round(avg(any_failure::INT), 3) FROM pop
  UNION ALL SELECT 'overall', 'avg_skills_overlap', round(avg(skills_overlap), 3) FROM pop
  UNION ALL {' UNION ALL '.join(f"SELECT 'failure_rates', '{f}', round(avg({f}::INT), 3) FROM pop" for f in PAIR_FAILURES)}
  UNION ALL {' UNION ALL '.join(f"SELECT '{s}', g || '/' || mode, rate FROM ({_rates_sql(g, 'g', 'pop')})" for s, g in _GROUPS)}
  UNION ALL SELECT 'schema_field_failures', field_path, count(*)::DOUBLE FROM err GROUP BY field_path
  UNION ALL SELECT 'correction', 'total_pairs', n FROM t UNION ALL SELECT 'correction', 'corrected', ok FROM t
  UNION ALL SELECT 'correction', 'permanently_failed', n - ok FROM t UNION ALL SELECT 'correction', 'correction_rate', round(ok / n, 3) FROM t
  UNION ALL SELECT 'correction', 'attempts_' || attempts, count(*)::DOUBLE FROM fixed WHERE attempts > 0 GROUP BY attempts
  UNION ALL SELECT 'llm_judge', 'avg_quality_score', round(avg(quality_score), 2) FROM seen
  UNION ALL SELECT 'llm_judge', 'avg_hallucination_score', round(avg(hallucination_score), 2) FROM seen
  UNION ALL SELECT 'llm_judge', 'avg_awkward_language_score', round(avg(awkward_language_score), 2) FROM seen
  UNION ALL SELECT 'llm_judge', 'total_judged', count(*)::DOUBLE FROM seen
  UNION ALL {' UNION ALL '.join(
      f"SELECT 'gap_{t}', 'rule_based_flags', count(*) FILTER ({f})::DOUBLE FROM seen UNION ALL "
      f"SELECT 'gap_{t}', 'judge_flags', count(*) FILTER ({s} >= 3)::DOUBLE FROM seen UNION ALL "
      f"SELECT 'gap_{t}', 'both_agree', count(*) FILTER ({f} AND {s} >= 3)::DOUBLE FROM seen" for t, f, s in _TOPICS)})""")
def quality_report(spark, sf_dir):
    run = agreement.labelled_run(pairs(spark, sf_dir), AS_OF, fix)
    return agreement.quality_report(run, pair_judge(spark, sf_dir)).withColumn("value", F.round("value", 9))


def _pos(values: list[str], c: str) -> str:
    return f"list_position({sql_list(values)}, {c})::INT"


@query("chart_series", PAIRS_SQL + f"""
, lv AS ({_rates_sql('fit_level', 'g')}), st AS ({_rates_sql('writing_style', 'g')}), ni AS ({_rates_sql(ROLE, 'g')}),
co AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::INT, {b}::INT), 6) AS v FROM lab" for a in PAIR_FAILURES for b in PAIR_FAILURES)})
SELECT 'correlation' AS chart, a AS series, b AS label, {_pos(PAIR_FAILURES, 'b')} AS pos, v AS value FROM co
UNION ALL SELECT 'by_fit_level', mode, g, {_pos(FIT_LEVELS, 'g')}, rate FROM lv
UNION ALL SELECT 'by_style', mode, g, {_pos(WRITING_STYLES, 'g')}, rate FROM st
UNION ALL SELECT 'niche_vs_standard', g, mode, {_pos(PAIR_FAILURES, 'mode')}, rate FROM ni
UNION ALL SELECT 'claims_by_fit_level', mode, g, {_pos(FIT_LEVELS, 'g')}, rate FROM lv
  WHERE mode IN ('hallucinated_skills', 'seniority_mismatch')""")
def chart_series(spark, sf_dir):
    return agreement.chart_series(failures.failure_cube(labelled(spark, sf_dir), agreement.GROUPS, PAIR_FAILURES))


@query("pair_failure_rates", PAIRS_SQL + " UNION ALL ".join(
    f"SELECT '{f}' AS mode, sum({f}::INT)::BIGINT AS failures, count(*) AS n, sum({f}::INT)::DOUBLE / count(*) AS rate FROM lab"
    for f in PAIR_FAILURES))
def pair_failure_rates(spark, sf_dir):
    return failures.mode_rates(labelled(spark, sf_dir), PAIR_FAILURES)
