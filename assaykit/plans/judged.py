"""Failure analytics over documents and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import agreement, failures
from assaykit.operators.hotkeys import hot_join
from assaykit.plans.registry import query, spread_table, sql_strings, table

FLAGS = ["low_quality", "toxic", "is_short", "is_long", "duplicated", "contact"]
EMAIL_SHAPE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LANGS = ["de", "en", "es", "fr"]
RULES = {"toxicity": ("contact", "toxicity_score"), "quality": ("is_short", "defect_score")}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a flat record: six 0/1 flags where it has a label, NULL flags (not judged) elsewhere.

    The text is scanned once and left behind before the joins. Copies are counted by digest with a partial aggregate,
    and only digests that occur more than once are joined back; a very common text is one row there.
    """
    docs = spread_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", "lang", "n_chars",
        F.sha2("text", 256).alias("digest"),
        F.col("text").rlike(EMAIL_SHAPE).cast("int").alias("has_contact"))
    copies = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")).groupBy("digest").agg(
        F.count("*").alias("n_copies")).where("n_copies > 1")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.col("toxic").alias("toxic_label"))
    joined = hot_join(docs.join(labels, "doc_id", "left"), copies, "digest", F.col("doc_id"), "left")
    flag = lambda c: F.when(F.col("quality").isNotNull(), c.cast("int"))
    return joined.select(
        "doc_id",
        F.format_string("qa_%04d", "doc_id").alias("trace_id"),
        F.col("lang").alias("category"),
        (F.col("n_chars") >= 50).alias("passed_validation"),
        flag(1 - F.col("quality")).alias("low_quality"),
        flag(F.col("toxic_label")).alias("toxic"),
        flag(F.col("n_chars") < 300).alias("is_short"),
        flag(F.col("n_chars") > 8000).alias("is_long"),
        flag(F.col("n_copies").isNotNull()).alias("duplicated"),
        flag(F.col("has_contact")).alias("contact"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat judged rows with overall_failure and failure_count."""
    nested = records(spark, sf_dir).select(
        "trace_id", F.struct("category").alias("metadata"),
        F.when(F.col("toxic").isNotNull(), F.struct(*FLAGS)).alias("judge_result"))
    return failures.flatten_judged(nested, FLAGS)


def cleaned() -> Column:
    """The corrected run: copies and texts with contact data are taken out."""
    return (F.col("duplicated") == 0) & (F.col("contact") == 0)


RECORDS_SQL = f"""
WITH copies AS (SELECT text, count(*) AS n_copies FROM documents GROUP BY text HAVING count(*) > 1),
records AS (
  SELECT d.doc_id, printf('qa_%04d', d.doc_id) AS trace_id, d.lang AS category, d.n_chars >= 50 AS passed_validation,
    CASE WHEN l.quality IS NOT NULL THEN 1 - l.quality END AS low_quality,
    l.toxic AS toxic,
    CASE WHEN l.quality IS NOT NULL THEN (d.n_chars < 300)::INT END AS is_short,
    CASE WHEN l.quality IS NOT NULL THEN (d.n_chars > 8000)::INT END AS is_long,
    CASE WHEN l.quality IS NOT NULL THEN (c.text IS NOT NULL)::INT END AS duplicated,
    CASE WHEN l.quality IS NOT NULL THEN regexp_matches(d.text, '{EMAIL_SHAPE}')::INT END AS contact
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN copies c ON d.text = c.text),
judged AS (
  SELECT trace_id, category, {', '.join(FLAGS)},
    ({' + '.join(FLAGS)}) > 0 AS overall_failure, {' + '.join(FLAGS)} AS failure_count
  FROM records WHERE toxic IS NOT NULL),
cleaned AS (SELECT * FROM judged WHERE duplicated = 0 AND contact = 0)
"""


def _per_flag(template: str, flags: list[str] = FLAGS) -> str:
    return " UNION ALL ".join(template.format(f=f) for f in flags)


@query("judged_rows", RECORDS_SQL + "SELECT * FROM judged")
def judged_rows(spark, sf_dir):
    return judged(spark, sf_dir)


@query("mode_rates", RECORDS_SQL + _per_flag(
    "SELECT '{f}' AS mode, sum({f})::BIGINT AS failures, count(*) AS n, sum({f})::DOUBLE / count(*) AS rate FROM judged"))
def mode_rates(spark, sf_dir):
    return failures.mode_rates(judged(spark, sf_dir), FLAGS)


OVERALL_SQL = """
SELECT n, p AS overall_rate, greatest(0.0, p - 1.96 * sqrt(p * (1 - p) / n)) AS ci_low,
  least(1.0, p + 1.96 * sqrt(p * (1 - p) / n)) AS ci_high
FROM (SELECT count(*) AS n, sum(overall_failure::INT)::DOUBLE / count(*) AS p FROM {t})
"""


@query("overall_rate_ci", RECORDS_SQL + f"""
SELECT n, overall_rate, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM ({OVERALL_SQL.format(t='judged')})""")
def overall_rate_ci(spark, sf_dir):
    row = failures.overall_rate(judged(spark, sf_dir))
    return row.withColumn("ci_low", F.round("ci_low", 9)).withColumn("ci_high", F.round("ci_high", 9))


@query("category_rates", RECORDS_SQL + _per_flag(
    "SELECT category, '{f}' AS mode, sum({f})::BIGINT AS failures, count(*) AS n, sum({f})::DOUBLE / count(*) AS rate "
    "FROM judged GROUP BY category"))
def category_rates(spark, sf_dir):
    return failures.rates_by(judged(spark, sf_dir), ["category"], FLAGS)


@query("category_counts", RECORDS_SQL + "SELECT category, count(*) AS n FROM judged GROUP BY category")
def category_counts(spark, sf_dir):
    return failures.category_counts(judged(spark, sf_dir))


ENTROPY_SQL = """
SELECT round(-sum(p * log2(p)), 9) AS entropy
FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM judged) AS p FROM judged GROUP BY category)
"""


@query("category_entropy", RECORDS_SQL + ENTROPY_SQL)
def category_entropy(spark, sf_dir):
    return failures.category_entropy(judged(spark, sf_dir)).select(F.round("entropy", 9).alias("entropy"))


@query("category_coverage", RECORDS_SQL + f"""
SELECT count(*) AS n_categories, count(*) FILTER (category IN ({sql_strings(LANGS)})) AS n_expected,
  count(*) = {len(LANGS)} AND count(*) FILTER (category IN ({sql_strings(LANGS)})) = {len(LANGS)} AS all_represented
FROM (SELECT DISTINCT category FROM judged WHERE category IS NOT NULL)""")
def category_coverage(spark, sf_dir):
    return failures.category_coverage(judged(spark, sf_dir), LANGS)


@query("worst_items", RECORDS_SQL + """
SELECT trace_id, category, failure_count FROM judged WHERE failure_count >= 3
ORDER BY failure_count DESC, trace_id""")
def worst_items(spark, sf_dir):
    return failures.worst_items(judged(spark, sf_dir))


@query("cooccurrence", RECORDS_SQL + " UNION ALL ".join(
    f"SELECT '{a}' AS mode_a, '{b}' AS mode_b, sum({a} * {b})::DOUBLE / count(*) AS share FROM judged"
    for a in FLAGS for b in FLAGS))
def cooccurrence(spark, sf_dir):
    return failures.cooccurrence(judged(spark, sf_dir), FLAGS)


@query("flag_correlation", RECORDS_SQL + " UNION ALL ".join(
    f"SELECT '{a}' AS mode_a, '{b}' AS mode_b, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 "
    f"THEN round(corr({a}, {b}), 6) END AS correlation FROM judged"
    for a in FLAGS for b in FLAGS))
def flag_correlation(spark, sf_dir):
    matrix = failures.flag_correlation(judged(spark, sf_dir), FLAGS)
    return matrix.withColumn("correlation", F.round("correlation", 6))


@query("run_summary", RECORDS_SQL + f""", s AS (SELECT * FROM ({OVERALL_SQL.format(t='judged')}))
SELECT 'baseline' AS tag, section, name, round(value, 9) AS value FROM (
  SELECT 'totals' AS section, 'total_generated' AS name, count(*)::DOUBLE AS value FROM records
  UNION ALL SELECT 'totals', 'passed_validation', count(*) FILTER (passed_validation)::DOUBLE FROM records
  UNION ALL SELECT 'totals', 'judged', count(*)::DOUBLE FROM judged
  UNION ALL SELECT 'overall', 'overall_failure_rate', overall_rate FROM s
  UNION ALL SELECT 'overall', 'ci_low', ci_low FROM s
  UNION ALL SELECT 'overall', 'ci_high', ci_high FROM s
  UNION ALL {_per_flag("SELECT 'per_mode_rates', '{f}', sum({f})::DOUBLE / count(*) FROM judged")}
  UNION ALL SELECT 'category_counts', category, count(*)::DOUBLE FROM judged GROUP BY category
  UNION ALL SELECT 'coverage', 'entropy', entropy FROM ({ENTROPY_SQL})
  UNION ALL SELECT 'worst_items', trace_id, failure_count::DOUBLE FROM judged WHERE failure_count >= 3)""")
def run_summary(spark, sf_dir):
    summary = failures.run_summary(records(spark, sf_dir), FLAGS, "baseline")
    return summary.withColumn("value", F.round("value", 9))


@query("compare_runs", RECORDS_SQL + _per_flag("""
SELECT '{f}' AS mode, b AS before_rate, a AS after_rate, CASE WHEN b > 0 THEN (b - a) / b ELSE 0.0 END AS reduction
FROM (SELECT (SELECT sum({f})::DOUBLE / count(*) FROM judged) AS b, (SELECT sum({f})::DOUBLE / count(*) FROM cleaned) AS a)
"""))
def compare_runs(spark, sf_dir):
    flat = judged(spark, sf_dir)
    return failures.compare_modes_in_one(flat, FLAGS, F.lit(True), cleaned())


_VERDICT_NUMBERS = ["before_overall", "before_low", "before_high", "after_overall", "after_low", "after_high", "improvement"]


@query("compare_verdict", RECORDS_SQL + f"""
, b AS ({OVERALL_SQL.format(t='judged')}), a AS ({OVERALL_SQL.format(t='cleaned')}),
v AS (SELECT b.overall_rate AS before_overall, b.ci_low AS before_low, b.ci_high AS before_high, b.n AS before_n,
    a.overall_rate AS after_overall, a.ci_low AS after_low, a.ci_high AS after_high, a.n AS after_n,
    CASE WHEN b.overall_rate > 0 THEN (b.overall_rate - a.overall_rate) / b.overall_rate ELSE 0.0 END AS improvement
  FROM b, a)
SELECT {', '.join(f'round({c}, 9) AS {c}' for c in _VERDICT_NUMBERS)}, before_n, after_n,
  before_low <= after_high AND after_low <= before_high AS ci_overlap, improvement >= 0.80 AS passed FROM v""")
def compare_verdict(spark, sf_dir):
    verdict = failures.compare_verdict_in_one(judged(spark, sf_dir), F.lit(True), cleaned())
    return verdict.withColumns({c: F.round(c, 9) for c in _VERDICT_NUMBERS})


def judge_scores(spark, sf_dir):
    """Labels read as a judge's scores 0..5."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("toxic") * 4 + 1).alias("toxicity_score"), ((1 - F.col("quality")) * 3 + 1).alias("defect_score"))


def rule_labels(spark, sf_dir):
    """Rule flags of all documents; those without a judge's score stay unmatched."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("text").rlike(EMAIL_SHAPE).cast("int").alias("contact"),
                       (F.col("n_chars") < 300).cast("int").alias("is_short"))


SCORES_SQL = f"""
WITH judge AS (SELECT doc_id, toxic * 4 + 1 AS toxicity_score, (1 - quality) * 3 + 1 AS defect_score FROM labels),
rules AS (SELECT doc_id, regexp_matches(text, '{EMAIL_SHAPE}') AS contact, n_chars < 300 AS is_short
  FROM documents)
"""


@query("judge_averages", SCORES_SQL + """
SELECT round(sum(toxicity_score)::DOUBLE / count(*), 2) AS avg_toxicity_score,
  round(sum(defect_score)::DOUBLE / count(*), 2) AS avg_defect_score, count(*) AS total_judged FROM judge""")
def judge_averages(spark, sf_dir):
    return agreement.judge_averages(judge_scores(spark, sf_dir), ["toxicity_score", "defect_score"])


@query("gap_analysis", SCORES_SQL + " UNION ALL ".join(
    f"SELECT '{t}' AS topic, count(*) FILTER ({rule}) AS rule_flags, count(*) FILTER ({score} >= 3) AS judge_flags, "
    f"count(*) FILTER ({rule} AND {score} >= 3) AS both_flags FROM judge JOIN rules USING (doc_id)"
    for t, (rule, score) in RULES.items()))
def gap_analysis(spark, sf_dir):
    """Every document was labelled twice, the first time with all flags set; only the last label counts."""
    last = rule_labels(spark, sf_dir).withColumn("pass", F.lit(2))
    first = last.select("doc_id", F.lit(1).alias("contact"), F.lit(1).alias("is_short"), F.lit(1).alias("pass"))
    return agreement.gap_analysis(judge_scores(spark, sf_dir), first.unionByName(last), RULES, key="doc_id", order="pass")


CRITERIA = ["relevance", "accuracy", "completeness", "citation_quality"]


@query("answer_scores", RECORDS_SQL + """
, scored AS (SELECT 5 - 3 * low_quality AS relevance, 5 - 3 * toxic - 2 * is_long AS accuracy, 5 - 4 * is_short AS completeness,
    5 - 2 * duplicated - 3 * contact AS citation_quality FROM judged),
a AS (SELECT * FROM scored WHERE relevance BETWEEN 1 AND 5 AND accuracy BETWEEN 1 AND 5 AND completeness BETWEEN 1 AND 5
  AND citation_quality BETWEEN 1 AND 5)
SELECT avg(relevance) AS avg_relevance, avg(accuracy) AS avg_accuracy, avg(completeness) AS avg_completeness,
  avg(citation_quality) AS avg_citation_quality,
  sum(relevance + accuracy + completeness + citation_quality)::DOUBLE / (count(*) * 4) AS avg_overall,
  count(*) AS n_answers, (SELECT count(*) FROM scored) - count(*) AS n_rejected,
  sum(relevance + accuracy + completeness + citation_quality)::DOUBLE / (count(*) * 4) > 4.0 AS meets_target FROM a""")
def answer_scores(spark, sf_dir):
    from assaykit.operators.experiments import answer_scores as averages

    scores = judged(spark, sf_dir).select(
        (5 - 3 * F.col("low_quality")).alias("relevance"),
        (5 - 3 * F.col("toxic") - 2 * F.col("is_long")).alias("accuracy"),
        (5 - 4 * F.col("is_short")).alias("completeness"),
        (5 - 2 * F.col("duplicated") - 3 * F.col("contact")).alias("citation_quality"))
    return averages(scores, CRITERIA)
