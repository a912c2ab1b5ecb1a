"""Row constraints and cross-field rules, collected as arrays of structured errors instead of exceptions.

Every rule is a column: a struct or NULL for a single value, an array of structs for a list. A validator joins them
in rule order, so checking a record is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.dates import experience_years, is_open_end, parse_date, parse_full, parse_month
from assaykit.functions.stats import rate
from assaykit.functions.text import is_blank
from assaykit.schemas import ERROR, EXPERIENCE_LEVELS, ITEM_FAILURES, PROFICIENCY_LEVELS

EMAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+\z"
DATE_FORMAT = "YYYY-MM-DD or YYYY-MM"


def error(path: Column | str, category: str, message: Column | str, value: Column | None = None,
          expected: str | None = None) -> Column:
    """One structured error."""
    text = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
    return F.struct(
        text(path).cast("string").alias("field_path"),
        F.lit(category).alias("category"),
        (F.lit(None) if value is None else value).cast("string").alias("invalid_value"),
        F.lit(expected).cast("string").alias("expected_format"),
        text(message).cast("string").alias("message"),
    )


def singles(*checks: Column) -> Column:
    """Array of the checks that produced an error, in order."""
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def each(items: Column, check) -> Column:
    """Apply ``check(element, index)`` to a list and keep the errors; a NULL list has none."""
    found = F.filter(F.transform(items, check), lambda e: e.isNotNull())
    return F.coalesce(found, F.array().cast(f"array<{ERROR}>"))


def at(base: str, index: Column, field: str) -> Column:
    """Path such as ``resume.skills[3].name``."""
    return F.concat(F.lit(f"{base}["), index.cast("string"), F.lit(f"].{field}"))


def too_short(c: Column, n: int) -> Column:
    return c.isNull() | (F.length(c) < n)


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\D", ""))


# ---------------------------------------------------------------- question/answer items

def item_errors(item: str = "item") -> Column:
    """Messages "field: text" of one question/answer item (array of strings)."""
    checks = []
    for f in ["question", "answer", "equipment_problem", "tools_required", "steps", "safety_info", "tips"]:
        c = F.col(f"{item}.{f}")
        if f in ("tools_required", "steps", "tips"):
            least = 3 if f == "steps" else 1
            name = {"tools_required": "tool", "steps": "step", "tips": "tip"}[f]
            few = F.concat(
                F.lit(f"{f}: List should have at least {least} item{'s' if least > 1 else ''} after validation, not "),
                F.size(c).cast("string"),
            )
            checks.append(
                F.when(c.isNull(), F.lit(f"{f}: Field required"))
                .when(F.size(c) < least, few)
                .when(F.exists(c, is_blank), F.lit(f"{f}: Value error, Each {name} must be a non-empty string"))
            )
        else:
            checks.append(
                F.when(c.isNull(), F.lit(f"{f}: Field required"))
                .when(F.length(c) < 1, F.lit(f"{f}: String should have at least 1 character"))
            )
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def validate_items(results: DataFrame, prompt_version: str = "baseline", model_name: str = "") -> DataFrame:
    """Re-check generation results (trace_id, item, category, generation_errors) into records.

    A missing item adds its own error; an invalid item is set to NULL; earlier errors are kept in front.
    """
    missing = F.col("item").isNull()
    found = F.when(missing, F.array(F.lit("Generation produced no item"))).otherwise(item_errors("item"))
    checked = results.withColumn("_found", found)
    passed = F.size("_found") == 0
    return checked.select(
        "trace_id",
        F.when(passed, F.col("item")).alias("item"),
        F.struct(
            F.col("trace_id").alias("trace_id"),
            F.col("category").alias("category"),
            F.lit(prompt_version).alias("prompt_version"),
            passed.alias("passed_validation"),
            F.concat(F.col("generation_errors"), F.col("_found")).alias("validation_errors"),
            F.lit(model_name).alias("model_name"),
        ).alias("metadata"),
    )


def pass_rate(records: DataFrame) -> DataFrame:
    """One row: total, passed, pass_rate (0 when empty)."""
    return records.agg(
        F.count("*").alias("total"), F.count(F.when(F.col("metadata.passed_validation"), 1)).alias("passed")
    ).withColumn("pass_rate", rate(F.col("passed"), F.col("total")))


def judgement_errors(judge: str = "judge_result", flags: list[str] = ITEM_FAILURES, low: int = 0,
                     high: int = 1) -> Column:
    """Scores outside their range (array of errors); NULL counts as missing."""
    checks = []
    for f in flags:
        c = F.col(f"{judge}.{f}") if judge else F.col(f)
        checks.append(
            F.when(c.isNull(), error(f, "missing_field", "Field required")).when(
                ~c.between(low, high), error(f, "format_violation", "score out of range", c, f"{low}..{high}")
            )
        )
    return singles(*checks)


def pair_judgement_errors() -> Column:
    """Range rules of the pair judge: two scores 0..5, one score 0..10."""
    return F.concat(
        judgement_errors("", ["hallucination_score", "awkward_language_score"], 0, 5),
        judgement_errors("", ["quality_score"], 0, 10),
    )


# ---------------------------------------------------------------- declared field constraints

def contact_errors() -> Column:
    c = "resume.contact"
    return singles(
        *[
            F.when(too_short(F.col(f"{c}.{f}"), 1), error(f"{c}.{f}", "missing_field", "at least 1 character"))
            for f in ("name", "location")
        ],
        F.when(
            ~F.coalesce(F.col(f"{c}.email").rlike(EMAIL), F.lit(False)),
            error(f"{c}.email", "format_violation", "not an e-mail address", F.col(f"{c}.email")),
        ),
        F.when(
            too_short(F.col(f"{c}.phone"), 1), error(f"{c}.phone", "missing_field", "at least 1 character")
        ).when(
            digits(F.col(f"{c}.phone")) < 10,
            error(f"{c}.phone", "format_violation", "Phone must contain at least 10 digits", F.col(f"{c}.phone")),
        ),
    )


def education_errors() -> Column:
    base = "resume.education"
    none = F.when(F.col(base).isNull() | (F.size(base) < 1), error(base, "missing_field", "at least 1 entry"))

    def text(field):
        return each(F.col(base), lambda e, i: F.when(
            too_short(e[field], 1), error(at(base, i, field), "missing_field", "at least 1 character")))

    dates = each(F.col(base), lambda e, i: F.when(
        parse_date(e["graduation_date"]).isNull(),
        error(at(base, i, "graduation_date"), "format_violation", f"graduation_date must be {DATE_FORMAT}",
              e["graduation_date"], DATE_FORMAT)))
    gpa = each(F.col(base), lambda e, i: F.when(
        ~e["gpa"].between(0.0, 4.0), error(at(base, i, "gpa"), "format_violation", "gpa out of range", None, "0..4")))
    return F.concat(singles(none), text("degree"), text("institution"), dates, gpa)


def _ends_before_start(e: Column) -> Column:
    """Only dates written in the same format are compared; an open end is never before the start."""
    full_s, full_e = parse_full(e["start_date"]), parse_full(e["end_date"])
    month_s, month_e = parse_month(e["start_date"]), parse_month(e["end_date"])
    return ~is_open_end(e["end_date"]) & (
        F.coalesce(full_e < full_s, F.lit(False)) | F.coalesce(month_e < month_s, F.lit(False))
    )


def experience_errors() -> Column:
    base = "resume.experience"

    def text(field):
        return each(F.col(base), lambda e, i: F.when(
            too_short(e[field], 1), error(at(base, i, field), "missing_field", "at least 1 character")))

    duties = each(F.col(base), lambda e, i: F.when(
        e["responsibilities"].isNull() | (F.size(e["responsibilities"]) < 1),
        error(at(base, i, "responsibilities"), "missing_field", "at least 1 entry")))
    order = each(F.col(base), lambda e, i: F.when(
        _ends_before_start(e),
        error(at(base, i, "end_date"), "logical_inconsistency", "end_date must be after start_date", e["end_date"])))
    return F.concat(text("company"), text("title"), duties, order)


def skill_errors() -> Column:
    base = "resume.skills"
    none = F.when(F.col(base).isNull() | (F.size(base) < 1), error(base, "missing_field", "at least 1 entry"))
    names = each(F.col(base), lambda s, i: F.when(
        too_short(s["name"], 1), error(at(base, i, "name"), "missing_field", "at least 1 character")))
    levels = each(F.col(base), lambda s, i: F.when(
        ~F.coalesce(s["proficiency_level"].isin(*PROFICIENCY_LEVELS), F.lit(False)),
        error(at(base, i, "proficiency_level"), "format_violation", "unknown level", s["proficiency_level"])))
    used = each(F.col(base), lambda s, i: F.when(
        s["years_used"] < 0, error(at(base, i, "years_used"), "format_violation", "must not be negative")))
    return F.concat(singles(none), names, levels, used)


def resume_schema_errors() -> Column:
    """All declared constraints of a resume."""
    summary = F.when(too_short(F.col("resume.summary"), 10),
                     error("resume.summary", "format_violation", "at least 10 characters", F.col("resume.summary")))
    return F.concat(contact_errors(), education_errors(), experience_errors(), skill_errors(), singles(summary))


def job_schema_errors() -> Column:
    """All declared constraints of a job."""
    required = F.col("job.requirements.required_skills")
    years = F.col("job.requirements.experience_years")
    level = F.col("job.requirements.experience_level")
    texts = ["company.name", "company.industry", "company.location", "title"]
    return singles(
        *[F.when(too_short(F.col(f"job.{f}"), 1), error(f"job.{f}", "missing_field", "at least 1 character"))
          for f in texts],
        F.when(too_short(F.col("job.description"), 20),
               error("job.description", "format_violation", "at least 20 characters", F.col("job.description"))),
        F.when(required.isNull() | (F.size(required) < 1),
               error("job.requirements.required_skills", "missing_field", "at least 1 entry")),
        F.when(years.isNull() | ~years.between(0, 30),
               error("job.requirements.experience_years", "format_violation", "out of range", years, "0..30")),
        F.when(~F.coalesce(level.isin(*EXPERIENCE_LEVELS), F.lit(False)),
               error("job.requirements.experience_level", "format_violation", "unknown level", level)),
    )


def example_errors(ids: str = "relevant_chunk_ids") -> Column:
    """A retrieval example names at least one relevant chunk."""
    return singles(F.when(F.col(ids).isNull() | (F.size(ids) < 1), error(ids, "missing_field", "at least 1 entry")))


# ---------------------------------------------------------------- cross-field rules of a pair

def timeline_errors(as_of: Column) -> Column:
    base = "resume.experience"

    def check(e: Column, i: Column) -> Column:
        start = parse_date(e["start_date"])
        return F.when(
            start.isNull(),
            error(at(base, i, "start_date"), "format_violation", "start_date could not be parsed", e["start_date"],
                  DATE_FORMAT),
        ).when(
            start > as_of,
            error(at(base, i, "start_date"), "logical_inconsistency", "start_date is in the future", e["start_date"]),
        )

    return each(F.col(base), check)


def graduation_errors(as_of: Column) -> Column:
    base = "resume.education"
    return each(F.col(base), lambda e, i: F.when(
        parse_date(e["graduation_date"]) > as_of,
        error(at(base, i, "graduation_date"), "logical_inconsistency", "graduation_date is in the future",
              e["graduation_date"])))


def blank_skill_errors() -> Column:
    base = "resume.skills"
    return each(F.col(base), lambda s, i: F.when(
        is_blank(s["name"]), error(at(base, i, "name"), "missing_field", "Skill name is empty")))


def long_career_error(years: Column) -> Column:
    shown = F.round(years, 1).cast("string")
    return F.when(years > 50, error(
        "resume.experience", "logical_inconsistency",
        F.concat(F.lit("Total experience ("), shown, F.lit(" years) exceeds plausible maximum")), shown))


def required_skills_error() -> Column:
    path = "job.requirements.required_skills"
    return F.when(F.coalesce(F.size(path), F.lit(0)) == 0,
                  error(path, "missing_field", "required_skills list is empty"))


def phone_error() -> Column:
    path = "resume.contact.phone"
    return F.when(digits(F.col(path)) < 10, error(
        path, "format_violation", "Phone number has fewer than 10 digits", F.col(path), "at least 10 digits"))


def validate_pairs(pairs: DataFrame, as_of: str) -> DataFrame:
    """Add ``errors``, ``error_count`` and ``is_valid`` to (resume, job, metadata) rows. No shuffle."""
    today = F.lit(as_of).cast("date")
    return (
        pairs.withColumn("_years", experience_years(F.col("resume.experience"), today))
        .withColumn(
            "errors",
            F.concat(
                timeline_errors(today),
                graduation_errors(today),
                blank_skill_errors(),
                singles(long_career_error(F.col("_years")), required_skills_error(), phone_error()),
            ),
        )
        .drop("_years")
        .withColumn("error_count", F.size("errors"))
        .withColumn("is_valid", F.size("errors") == 0)
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows of a validated table."""
    return validated.where("is_valid"), validated.where("NOT is_valid")


def errors_by_category(validated: DataFrame, key: str) -> DataFrame:
    """Rows (key, category, n_errors, messages): errors of each record grouped by category, in rule order.

    Done inside the row with array functions: records need no shuffle to be grouped by their own errors.
    """
    categories = F.array_distinct(F.transform("errors", lambda e: e["category"]))
    grouped = validated.select(key, "errors", F.explode(categories).alias("category"))
    mine = F.filter("errors", lambda e: e["category"] == F.col("category"))
    return grouped.select(
        key, "category", F.size(mine).alias("n_errors"), F.transform(mine, lambda e: e["message"]).alias("messages"))


def field_failures(validated: DataFrame) -> DataFrame:
    """How often each field path (index kept) occurs in errors, most frequent first."""
    return (
        validated.select(F.explode("errors.field_path").alias("field_path"))
        .groupBy("field_path")
        .agg(F.count("*").alias("n_errors"))
        .orderBy(F.desc("n_errors"), "field_path")
    )
