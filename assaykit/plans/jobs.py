"""Generation plans, prompts, hooks, files, caches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import generation, hooks, validation
from assaykit.operators.labels import label_pairs
from assaykit.plans.pair_view import (
    AS_OF, CREATED, JOB_TITLES, PAIRS_SQL, jobs, pairs, resumes,
)
from assaykit.plans.pairs import pid
from assaykit.plans.registry import query, spread_table, sql_list, table
from assaykit.plans.search import corpus, hashed
from assaykit.plans.texts import SECTIONS_SQL, hashed_sql, judgements
from assaykit.schemas import FIT_LEVELS, PAIR_FAILURES, WRITING_STYLES
from assaykit.session import fresh_path
from assaykit.sources import records, truth
from assaykit.sources.cache import cached_embeddings
from assaykit.streaming import review

# What jobs are drawn from here: market segments of the customers, and two of them with a speciality.
INDUSTRIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NICHE_INDUSTRIES = ["MACHINERY FOR MINES", "BUILDING IN ICE", "FURNITURE FOR SHIPS"]


# ---------------------------------------------------------------- generation plans and prompts

def _choice_sql(values: list[str], key: str) -> str:
    return f"{sql_list(values)}[(('0x' || substr(md5('7|' || {key}), 1, 8))::BIGINT % {len(values)} + 1)::INT]"


PLAN_SQL = f"""
WITH j AS (SELECT p_partkey, p_partkey % 5 = 4 AS is_niche,
  CASE WHEN p_partkey % 5 = 4 THEN {_choice_sql(NICHE_INDUSTRIES, 'p_partkey')} ELSE {_choice_sql(INDUSTRIES, 'p_partkey')} END AS industry
  FROM part)
"""


@query("generation_plan", PLAN_SQL + f"""
SELECT p_partkey, is_niche, industry, i::INT AS slot, {sql_list(FIT_LEVELS)}[(i % 5 + 1)::INT] AS fit_level,
  {sql_list(WRITING_STYLES)}[(i % 5 + 1)::INT] AS writing_style FROM j, range(0, 7) t(i)""")
def generation_plan(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey")
    planned = generation.plan_jobs(parts, "p_partkey", INDUSTRIES, NICHE_INDUSTRIES)
    return generation.plan_resumes(planned, 7)


@query("seeded_choice", PLAN_SQL + "SELECT industry, count(*) AS n FROM j GROUP BY industry")
def seeded_choice(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey")
    planned = generation.plan_jobs(parts, "p_partkey", INDUSTRIES, NICHE_INDUSTRIES)
    return planned.groupBy("industry").agg(F.count("*").alias("n"))


@query("pair_assembly", PAIRS_SQL + f"""
SELECT pair_id, 'res_' || k AS resume_id, 'job_' || c AS job_id, fit_level, writing_style, '{CREATED}' AS created_at FROM base""")
def pair_assembly(spark, sf_dir):
    built = generation.assemble_pairs(resumes(spark, sf_dir), jobs(spark, sf_dir), "job_key", CREATED)
    return built.select(
        pid(), F.col("resume.metadata.trace_id").alias("resume_id"), F.col("job.metadata.trace_id").alias("job_id"),
        "metadata.fit_level", "metadata.writing_style", "metadata.created_at")


ERROR_LABELS = {"field_path": "where", "category": "kind", "message": "what", "invalid_value": "found", "expected_format": "wanted"}
ERRORS_SQL = """string_agg('where: ' || field_path || chr(10) || 'kind: ' || category || chr(10) || 'what: ' || message
  || coalesce(chr(10) || 'found: ' || nullif(invalid_value, ''), '')
  || CASE WHEN message = 'start_date could not be parsed' THEN chr(10) || 'wanted: YYYY-MM-DD or YYYY-MM'
      WHEN rule = 6 THEN chr(10) || 'wanted: at least 10 digits' ELSE '' END, chr(10) || chr(10) ORDER BY rule, pos)"""


@query("correction_errors", PAIRS_SQL + f"""
SELECT pair_id, {ERRORS_SQL} AS error_text FROM err JOIN base ON err.k = base.k GROUP BY pair_id""")
def correction_errors(spark, sf_dir):
    invalid = validation.validate_pairs(pairs(spark, sf_dir), AS_OF).where("NOT is_valid")
    return invalid.select(pid(), generation.error_text(F.col("errors"), ERROR_LABELS).alias("error_text"))


REPAIR = "Mend only the fields named below.\n{record}\n\n{errors}\n\nAnswer with the whole record."


@query("correction_prompt", PAIRS_SQL + f"""
SELECT pair_id, 'Mend only the fields named below.' || chr(10) || '{{"metadata":{{"fit_level":"' || any_value(fit_level) || '"}}}}'
  || chr(10) || chr(10) || {ERRORS_SQL} || chr(10) || chr(10) || 'Answer with the whole record.' AS prompt
FROM err JOIN base ON err.k = base.k GROUP BY pair_id""")
def correction_prompt(spark, sf_dir):
    """The whole request, with a short form of the record (its metadata) in the record's slot."""
    invalid = validation.validate_pairs(pairs(spark, sf_dir), AS_OF).where("NOT is_valid")
    record = F.struct(F.struct("resume.metadata.fit_level").alias("metadata"))
    return invalid.select(pid(), generation.correction_prompt(REPAIR, record, F.col("errors"), ERROR_LABELS).alias("prompt"))


SUFFIX = " Give at least five numbered steps."


@query("corrected_prompts", f"SELECT p_partkey, 'Write about ' || p_name || ' parts of type ' || p_type || '.{SUFFIX}' AS prompt FROM part")
def corrected_prompts(spark, sf_dir):
    baseline = table(spark, sf_dir, "part").select("p_partkey", F.concat(
        F.lit("Write about "), "p_name", F.lit(" parts of type "), "p_type", F.lit(".")).alias("prompt"))
    return generation.with_suffix(baseline, SUFFIX)


JOB_TEMPLATE, NICHE_NOTE = "Invent a post at a company in {industry}.{note}", " Only specialists fit it."


@query("job_prompt", PLAN_SQL + f"""
SELECT p_partkey, 'Invent a post at a company in ' || industry || '.' || CASE WHEN is_niche THEN '{NICHE_NOTE}' ELSE '' END AS prompt
FROM j""")
def job_prompt(spark, sf_dir):
    """One prompt per planned job; niche jobs get a note of their own."""
    planned = generation.plan_jobs(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", INDUSTRIES, NICHE_INDUSTRIES)
    note = F.when(F.col("is_niche"), F.lit(NICHE_NOTE)).otherwise("")
    return planned.select("p_partkey", generation.render(F.lit(JOB_TEMPLATE), {
        "industry": F.col("industry"), "note": note}).alias("prompt"))


FIT_TEXTS = {level: f"Aim for a {level.lower()} match." for level in FIT_LEVELS}
TEMPLATE = "Job: {title} in {industry}. Skills: {skills}. Level: {level}. {fit}"


@query("resume_prompt", PAIRS_SQL + f"""
SELECT pair_id, 'Job: ' || {sql_list(JOB_TITLES)}[(c % 5 + 1)::INT] || ' in ' || c_mktsegment || '. Skills: ' || array_to_string(required, ', ')
  || '. Level: ' || job_level || '. Aim for a ' || lower(fit_level) || ' match.' AS prompt FROM base""")
def resume_prompt(spark, sf_dir):
    """Templates are a table of one row per fit level, joined by broadcast; the slots are filled from the job."""
    templates = spark.createDataFrame([(k, TEMPLATE, v) for k, v in FIT_TEXTS.items()], "fit_level string, template string, fit string")
    planned = resumes(spark, sf_dir).select("job_key", "resume_id", "fit_level").join(jobs(spark, sf_dir), "job_key")
    joined = planned.join(F.broadcast(templates), "fit_level")  # five rows by construction
    return joined.select(
        generation.pair_id(F.col("job_key"), F.col("resume_id")).alias("pair_id"),
        generation.render(F.col("template"), {
            "title": F.col("job.title"), "industry": F.col("job.company.industry"),
            "skills": F.array_join("job.requirements.required_skills", ", "),
            "level": F.col("job.requirements.experience_level"), "fit": F.col("fit")}).alias("prompt"))


PAIR_TEMPLATE = ("Post {title}, {level}, {years} years or more, asks for {skills_wanted}.\nApplicant of {positions} posts: {summary}\n"
                 "Knows {skills}")


@query("pair_judge_input", PAIRS_SQL + f"""
SELECT pair_id, 'Post ' || {sql_list(JOB_TITLES)}[(c % 5 + 1)::INT] || ', ' || job_level || ', ' || asked || ' years or more, asks for '
  || array_to_string(required, ', ') || '.' || chr(10) || 'Applicant of ' || (base.k % 4) % 4 || ' posts: ' || summary || chr(10)
  || 'Knows ' || coalesce(s.names, '') AS judge_text
FROM base LEFT JOIN (SELECT k, string_agg(name, ', ' ORDER BY j) AS names FROM sk GROUP BY k) s ON base.k = s.k""")
def pair_judge_input(spark, sf_dir):
    return pairs(spark, sf_dir).select(pid(), generation.pair_text(PAIR_TEMPLATE).alias("judge_text"))


# ---------------------------------------------------------------- hooks

@query("embed_documents", f"""
SELECT doc_id, bucket::INT AS bucket, round(v, 5) AS v FROM ({hashed_sql('documents', 'doc_id')})""")
def embed_documents(spark, sf_dir):
    rows = hashed(corpus(spark, sf_dir), "doc_id")
    return rows.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "v")).where("v <> 0").select(
        "doc_id", "bucket", F.round(F.col("v").cast("double"), 5).alias("v"))


def word_score(texts: list[str]) -> list[float]:
    """Stand-in scorer: number of words; refuses empty texts."""
    out = []
    for text in texts:
        n = len(text.split())
        if n % 11 == 0:
            raise ValueError("refused")
        out.append(float(n))
    return out


@query("judge_records", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND len(regexp_extract_all(d.text, '[^\\s\\x{85}\\x{a0}\\x{1c}-\\x{1f}]+')) % 11 <> 0
  THEN len(regexp_extract_all(d.text, '[^\\s\\x{85}\\x{a0}\\x{1c}-\\x{1f}]+'))::DOUBLE END AS score
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def judge_records(spark, sf_dir):
    """Only records with an item go to the scorer; the rest, and refused ones, keep NULL."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("item"))
    docs = corpus(spark, sf_dir).join(labelled, "doc_id", "left")
    return hooks.judge_rows(docs, "item", F.col("text"), word_score).select("doc_id", "score")


def flaky(prompts: list[str], attempt: int) -> list:
    """Stand-in model: some prompts work at the second try, some never."""
    out: list = []
    for p in prompts:
        n = len(p)
        if n % 35 == 0 or (n % 7 == 0 and attempt == 1):
            out.append(ValueError("no answer"))
        else:
            out.append(f"{n} characters")
    return out


@query("generate_with_retry", """
SELECT conv_id, turn, CASE WHEN n % 35 <> 0 THEN n || ' characters' END AS item,
  CASE WHEN n % 35 = 0 THEN 'attempt 1: no answer; attempt 2: no answer; attempt 3: no answer'
    WHEN n % 7 = 0 THEN 'attempt 1: no answer' ELSE '' END AS errors
FROM (SELECT conv_id, turn, len(text) AS n FROM conversations)""")
def generate_with_retry(spark, sf_dir):
    turns = spread_table(spark, sf_dir, "conversations", "conv_id")
    answered = turns.select("conv_id", "turn", hooks.complete(F.col("text"), flaky).alias("r"))
    return answered.select("conv_id", "turn", "r.item", F.array_join("r.errors", "; ").alias("errors"))


@query("cache_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def cache_missing(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return truth.missing_from_cache(table(spark, sf_dir, "documents").select("doc_id"), stored, "doc_id")


@query("embedding_cache", f"""
SELECT doc_id, bucket::INT AS bucket, round(v, 5) AS v FROM ({hashed_sql('documents', 'doc_id', 16)})""")
def embedding_cache(spark, sf_dir):
    """Fill the store in two runs (labelled documents first, then all) and read it: every document has its vector once, value by value."""
    path = fresh_path(spark, "embedding-cache")
    docs = corpus(spark, sf_dir)
    first = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    embedder = lambda text: hooks.embed(text, hooks.hashed_terms(16))
    for chunk in (first, docs):
        stored = cached_embeddings(spark, chunk, path, "whole", "hash-16", embedder, key="doc_id")
    values = stored.select("doc_id", F.posexplode("embedding").alias("bucket", "v")).where("v <> 0")
    return values.select("doc_id", "bucket", F.round(F.col("v").cast("double"), 5).alias("v"))


# ---------------------------------------------------------------- files

NESTED = "c_custkey bigint, account struct<name: string, balance: double>, tags array<string>, note string"


@query("records_roundtrip", """
SELECT c_custkey, c_name AS name, c_acctbal AS balance, c_mktsegment || ',nation ' || c_nationkey AS tags, TRUE AS note_kept FROM customer""")
def records_roundtrip(spark, sf_dir):
    """Nested records to JSON lines and back under the declared schema; NULL fields are written."""
    path = fresh_path(spark, "records")
    source = table(spark, sf_dir, "customer").select(
        "c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("account"),
        F.array("c_mktsegment", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))).alias("tags"),
        F.lit(None).cast("string").alias("note"))
    records.write_records(source, path)
    back = records.read_records(spark, path, NESTED, required=["c_custkey"])
    return back.select("c_custkey", "account.name", "account.balance", F.array_join("tags", ",").alias("tags"),
                       F.col("note").isNull().alias("note_kept"))


@query("stage_roundtrip", PAIRS_SQL + f"""
SELECT pair_id, skills_overlap, {', '.join(PAIR_FAILURES)}, is_valid FROM lab JOIN (
  SELECT base.k, count(err.k) = 0 AS is_valid FROM base LEFT JOIN err ON base.k = err.k GROUP BY base.k) USING (k)""")
def stage_roundtrip(spark, sf_dir):
    """Every stage starts from what the one before it stored."""
    stages = records.Stages(spark, fresh_path(spark, "stages"))
    stored = stages.save("pairs", pairs(spark, sf_dir))
    checked = validation.validate_pairs(stored, AS_OF)
    valid, invalid = validation.split_valid(checked)
    both = stages.save("valid", valid).unionByName(stages.save("invalid", invalid))
    return stages.save("labels", label_pairs(both, AS_OF, keep=["is_valid"]))


@query("summary_document", """
SELECT lang, count(*)::DOUBLE AS n_documents, avg(n_chars) AS mean_chars FROM documents GROUP BY lang""")
def summary_document(spark, sf_dir):
    """Metrics per language written as one JSON document and read from it again."""
    path = fresh_path(spark, "summary")
    means = table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").cast("double").alias("n_documents"), F.avg("n_chars").alias("mean_chars"))
    rows = means.select(F.col("lang").alias("section"), F.inline(F.array(
        F.struct(F.lit("n_documents").alias("name"), F.col("n_documents").alias("value")),
        F.struct(F.lit("mean_chars").alias("name"), F.col("mean_chars").alias("value")))))
    records.write_summary(rows, path)
    text = spark.read.text(f"{path}/document").select(F.from_json("value", "map<string, string>").alias("m"))
    each = text.select(F.explode("m").alias("lang", "v")).select("lang", F.from_json("v", "map<string, double>").alias("v"))
    return each.select("lang", F.col("v")["n_documents"].alias("n_documents"), F.col("v")["mean_chars"].alias("mean_chars"))


@query("results_append", "SELECT event_type, run, count(*) AS n FROM events, (VALUES ('first'), ('second')) t(run) GROUP BY ALL")
def results_append(spark, sf_dir):
    path = fresh_path(spark, "results")
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    for run in ("first", "second"):
        records.append_results(counts.withColumn("run", F.lit(run)), path)
    return records.load_results(spark, path)


@query("qrels_load", SECTIONS_SQL + "SELECT item_id::VARCHAR AS query_id, doc_id::VARCHAR AS document_id, section_index FROM qrels")
def qrels_load(spark, sf_dir):
    """Judgements packed into nested JSON, written, read and exploded again."""
    path = fresh_path(spark, "qrels")
    rows = judgements(spark, sf_dir).select(
        F.col("query_id").cast("string"), F.col("doc_id").cast("string").alias("document_id"), "section_index")
    truth.pack_qrels(rows).write.text(path)
    return truth.load_qrels(spark, path)


@query("queries_load", """
SELECT item_id::VARCHAR AS query_id, text, CASE WHEN item_id % 3 > 0 THEN 'kind ' || item_id % 2 END AS type, CASE WHEN item_id % 3 > 1 THEN 'benchmark' END AS source
FROM benchmark""")
def queries_load(spark, sf_dir):
    """Queries as nested JSON of three shapes, a text alone or an object with more or fewer fields, read back as rows."""
    path, i = fresh_path(spark, "queries"), F.col("item_id")
    kind = F.concat(F.lit("kind "), (i % 2).cast("string"))
    value = lambda *fields: F.to_json(F.create_map(i.cast("string"), F.struct(*fields)))
    lines = F.when(i % 3 == 0, F.to_json(F.create_map(i.cast("string"), "text"))).when(
        i % 3 == 1, value(F.col("text").alias("query"), kind.alias("type"), F.array(F.lit(1)).alias("other"))).otherwise(
        value(F.col("text").alias("question"), kind.alias("type"), F.lit("benchmark").alias("source")))
    table(spark, sf_dir, "benchmark").select(lines.alias("value")).write.text(path)
    return truth.load_queries(spark, path)


@query("answers_load", """
SELECT conv_id || ':' || turn AS query_id, unnest(CASE WHEN turn % 3 = 2 THEN [text, upper(role)] ELSE [text] END) AS answer
FROM conversations WHERE role = 'assistant'""")
def answers_load(spark, sf_dir):
    """Answers as texts, objects and lists in nested JSON, read back as rows."""
    path, t = fresh_path(spark, "answers"), F.col("turn")
    key = F.concat_ws(":", "conv_id", "turn")
    lines = F.when(t % 3 == 0, F.to_json(F.create_map(key, "text"))).when(
        t % 3 == 1, F.to_json(F.create_map(key, F.struct(F.col("text").alias("answer"), "role")))).otherwise(
        F.to_json(F.create_map(key, F.array("text", F.upper("role")))))
    table(spark, sf_dir, "conversations").where("role = 'assistant'").select(lines.alias("value")).write.text(path)
    return truth.load_answers(spark, path)


@query("sections_load", """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id::VARCHAR AS document_id, i::INT AS section_index, CASE WHEN doc_id % 2 = 0 THEN 'line' END AS title, md5(text) AS digest,
  start_char, start_char + length(text) AS end_char
FROM (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char FROM s)""")
def sections_load(spark, sf_dir):
    """Documents as JSON with a list of sections, here their lines, as texts or as objects; read back with their places."""
    path = fresh_path(spark, "sections")
    lines = F.split("text", "\n", -1)
    rich = F.struct(F.col("doc_id").alias("id"), F.transform(lines, lambda x: F.struct(x.alias("text"), F.lit("line").alias("title"))).alias("sections"))
    plain = F.struct(F.col("doc_id").cast("string").alias("paper_id"), lines.alias("sections"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    docs.select(F.when(F.col("doc_id") % 2 == 0, F.to_json(rich)).otherwise(F.to_json(plain)).alias("value")).write.text(path)
    return truth.load_sections(spark, path).select("document_id", "section_index", "title", F.md5("text").alias("digest"), "start_char", "end_char")


@query("subset", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def subset(spark, sf_dir):
    return truth.first_documents(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


# ---------------------------------------------------------------- streams

@query("stream_review", PAIRS_SQL + f"""
SELECT pair_id, skills_overlap, {', '.join(PAIR_FAILURES)}, n = 0 AS validation_passed, n::INT AS validation_error_count
FROM lab JOIN (SELECT base.k, count(err.k) AS n FROM base LEFT JOIN err ON base.k = err.k GROUP BY base.k) USING (k)""")
def stream_review(spark, sf_dir):
    """Pairs arrive as JSON files; the stream labels and checks them and writes Parquet."""
    arrived = fresh_path(spark, "arriving-pairs")
    records.write_records(pairs(spark, sf_dir), arrived, compression="gzip")  # field names are most of a record
    stream = review.review(review.read_pair_stream(spark, arrived), AS_OF)
    return review.run_to_files(stream, fresh_path(spark, "reviews"), fresh_path(spark, "review-state"))


ROLLING_SQL = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, sum((event_type = 'error')::INT)::DOUBLE / count(*) AS rate_error,
  sum((value > 50)::INT)::DOUBLE / count(*) AS rate_large
FROM events GROUP BY date_trunc('day', ts)
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream in one-day windows with their rates."""
    schema = table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    flagged = arriving.select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("error"), (F.col("value") > 50).alias("large"))
    return review.window_rates(flagged, "ts", ["error", "large"], window="1 day")


def by_day(rates: DataFrame) -> DataFrame:
    return rates.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "rate_error", "rate_large")


@query("rolling_rates", ROLLING_SQL)
def rolling_rates(spark, sf_dir):
    """Closed one-day windows of the event stream; windows the watermark has not passed are still open."""
    return by_day(review.run_to_files(event_windows(spark, sf_dir), fresh_path(spark, "rates"), fresh_path(spark, "rates-state")))


@query("live_rates", ROLLING_SQL)
def live_rates(spark, sf_dir):
    """The same windows merged batch by batch into the table of the latest rates, which is then read."""
    latest = review.LatestRates(spark, fresh_path(spark, "latest-rates"))
    latest.run(event_windows(spark, sf_dir), fresh_path(spark, "latest-state")).awaitTermination()
    return by_day(latest.read())
