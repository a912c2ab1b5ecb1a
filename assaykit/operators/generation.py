"""Generation plan, record ids, pair assembly and the texts sent to a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.operators.hotkeys import hot_join, sequential_ids
from assaykit.schemas import FIT_LEVELS, WRITING_STYLES


def element(values: list[str], index: Column) -> Column:
    """values[index mod n] of a literal list."""
    picked = F.pmod(index, F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), picked)


def seeded_choice(values: list[str], key: Column, seed: int) -> Column:
    """Repeatable pseudo-random choice by a digest of key and seed."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return element(values, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))


def number_records(df: DataFrame, order: str, prefix: str = "qa_", width: int = 4) -> DataFrame:
    """Add ``trace_id`` such as qa_0001 in the order of a unique numeric column."""
    numbered = sequential_ids(df, order)
    digits = F.col("seq").cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return numbered.withColumn("trace_id", F.concat(F.lit(prefix), padded))


def plan_jobs(df: DataFrame, position: str, industries: list[str], niche_industries: list[str],
              seed: int = 7) -> DataFrame:
    """Every fifth job (position mod 5 = 4) is niche; its industry is drawn from the niche list."""
    p = F.col(position)
    niche = F.pmod(p, F.lit(5)) == 4
    return df.withColumn("is_niche", niche).withColumn(
        "industry", F.when(niche, seeded_choice(niche_industries, p, seed)).otherwise(seeded_choice(industries, p, seed))
    )


def plan_resumes(jobs: DataFrame, per_job: int) -> DataFrame:
    """``per_job`` resume slots per job; the i-th slot gets fit level and style number i mod 5."""
    slots = jobs.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(per_job - 1)))) if per_job > 0 else (
        jobs.withColumn("slot", F.lit(0)).where(F.lit(False)))
    return slots.withColumn("fit_level", element(FIT_LEVELS, F.col("slot"))).withColumn(
        "writing_style", element(WRITING_STYLES, F.col("slot")))


def pair_id(*parts: Column) -> Column:
    """Stable id instead of a random one, so that a re-run task writes the same id."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256).substr(1, 32)


def assemble_pairs(resumes: DataFrame, jobs: DataFrame, key: str, created_at: str,
                   build: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Join resumes (key, resume, resume_id, fit_level, writing_style) to their job (key, job) as pair records.

    One job may have a third of all resumes: its rows are dealt to many tasks. Where the records are made from flat rows, both
    sides may be these rows (key and resume_id at least) and ``build`` adds the other columns to the joined ones: the shuffle
    then moves what the records are made of and not the records.
    """
    joined = hot_join(resumes, jobs, key, F.col("resume_id"))
    joined = joined if build is None else build(joined)
    meta = F.struct(
        pair_id(F.col(key), F.col("resume_id")).alias("pair_id"),
        F.lit(created_at).alias("created_at"),
        F.col("fit_level").alias("fit_level"),
        F.col("writing_style").alias("writing_style"),
        F.lit(0).alias("correction_attempts"),
        F.lit(True).alias("passed_validation"),
        F.lit(0).alias("validation_error_count"),
    )
    return joined.select("resume", "job", meta.alias("metadata"))


# ---------------------------------------------------------------- texts

def numbered_lines(items: Column) -> Column:
    """Lines such as "  1. text"."""
    return F.array_join(
        F.transform(items, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s)), "\n")


def item_text(template: str, item: str = "item") -> Column:
    """What the judge reads about one question/answer item: the caller's template, with slots named after the item's fields.

    Lists are comma-joined, the steps are numbered lines.
    """
    c = lambda f: F.col(f"{item}.{f}")
    plain = {f: c(f) for f in ("question", "answer", "equipment_problem", "safety_info")}
    joined = {f: F.array_join(c(f), ", ") for f in ("tools_required", "tips")}
    return render(F.lit(template), {**plain, **joined, "steps": numbered_lines(c("steps"))})


def pair_text(template: str) -> Column:
    """What the judge reads about one resume/job pair: the caller's template with the slots title, skills_wanted, years, level,
    summary, skills and positions."""
    req = "job.requirements"
    return render(F.lit(template), {
        "title": F.col("job.title"), "skills_wanted": F.array_join(f"{req}.required_skills", ", "),
        "years": F.col(f"{req}.experience_years").cast("string"), "level": F.col(f"{req}.experience_level"),
        "summary": F.col("resume.summary"), "skills": F.array_join("resume.skills.name", ", "),
        "positions": F.size("resume.experience").cast("string"),
    })


def error_block(e: Column, labels: dict[str, str]) -> Column:
    """Lines about one error, one for each field named in ``labels`` that has a value."""
    lines = [F.when(e[f] != "", F.concat(F.lit(f"{label}: "), e[f])) for f, label in labels.items()]
    return F.array_join(F.array(*lines), "\n")


def error_text(errors: Column, labels: dict[str, str]) -> Column:
    return F.array_join(F.transform(errors, lambda e: error_block(e, labels)), "\n\n")


def correction_prompt(template: str, resume: Column, errors: Column, labels: dict[str, str]) -> Column:
    """Repair request: the caller's template with the slots record (as JSON) and errors."""
    return render(F.lit(template), {
        "record": F.to_json(resume, {"ignoreNullFields": "false"}), "errors": error_text(errors, labels)})


def with_suffix(prompts: DataFrame, suffix: str, prompt: str = "prompt") -> DataFrame:
    """Corrected prompt table: each baseline prompt plus one shared suffix."""
    return prompts.withColumn(prompt, F.concat(F.col(prompt), F.lit(suffix)))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots of a template column."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def answer_prompt(retrieved: DataFrame, question: str, group: str = "query_id", rank: str = "rank",
                  text: str = "text") -> DataFrame:
    """Question plus numbered context chunks. A group holds the k retrieved rows of one query, no more."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    context = F.array_join(F.transform(
        F.col("_ctx"), lambda x: F.concat(F.lit("["), x["r"].cast("string"), F.lit("] "), x["t"])), "\n")
    return (
        retrieved.groupBy(group).agg(ordered.alias("_ctx"), F.min(question).alias(question))
        .select(group, F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), F.col(question)).alias("prompt"))
    )
