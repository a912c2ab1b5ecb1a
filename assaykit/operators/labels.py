"""Six rule labels of a resume/job pair, as one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.dates import career_spans, title_of, years_of, years_rank
from assaykit.functions.text import jaccard, normalize_skill, phrase_count, skill_set, title_rank
from assaykit.schemas import EXPERIENCE_LEVELS, PAIR_FAILURES

YEARS = "_years"
OWNED = "_owned_skills"
TITLE = "_latest_title"
SPANS = "_spans"
REQUIRED = "_required"


def with_career(pairs: DataFrame, as_of: str) -> DataFrame:
    """Add the values several labels share, so each is worked out once per row."""
    required = F.transform("job.requirements.required_skills", normalize_skill)
    return (
        pairs.withColumns({
            SPANS: career_spans(F.col("resume.experience"), F.lit(as_of).cast("date")),
            OWNED: skill_set(F.col("resume.skills.name")),
            REQUIRED: required,
        })
        .withColumns({YEARS: years_of(F.col(SPANS)), TITLE: F.lower(title_of(F.col(SPANS)))})
    )


def level_rank(level: Column) -> Column:
    """Position of an experience level in its scale; the scale is a literal of five values."""
    return F.array_position(F.array(*[F.lit(x) for x in EXPERIENCE_LEVELS]), level) - 1


def skills_overlap() -> Column:
    return jaccard(F.col(OWNED), F.array_distinct(REQUIRED))


def experience_mismatch() -> Column:
    """Fewer years than half of what the job asks; a job that asks none never mismatches."""
    asked = F.col("job.requirements.experience_years")
    return (asked != 0) & (F.col(YEARS) < asked * F.lit(0.5))


def resume_rank() -> Column:
    """Rank by years, capped by the latest title when that names a rank (``least`` skips a NULL title rank)."""
    return F.least(title_rank(F.col(TITLE)), years_rank(F.col(YEARS)))


def seniority_mismatch() -> Column:
    return F.abs(resume_rank() - level_rank(F.col("job.requirements.experience_level"))) > 1


def missing_core_skills(top: int = 3) -> Column:
    """Any of the first required skills is absent from the resume."""
    return F.size(F.array_except(F.slice(REQUIRED, 1, top), F.col(OWNED))) > 0


def hallucinated_skills() -> Column:
    """Implausible claims: expert density, summed years of use, many experts early on, very long lists, one long use."""
    skills, years = F.col("resume.skills"), F.col(YEARS)
    experts = F.size(F.filter(skills, lambda s: s["proficiency_level"] == "Expert"))
    claimed = F.aggregate(skills, F.lit(0.0), lambda acc, s: acc + F.coalesce(s["years_used"], F.lit(0.0)))
    career = F.greatest(years, F.lit(0.5))
    one_long = F.exists(
        skills,
        lambda s: F.coalesce(
            (s["years_used"] != 0) & (s["years_used"] > F.greatest(years, F.lit(1.0)) + 1), F.lit(False)
        ),
    )
    return (
        (experts / career > 3.0)
        | ((claimed / career > 6.0) & (claimed > 5))
        | ((years < 2) & (experts >= 5))
        | (F.size(skills) >= 20)
        | one_long
    )


def buzzword_count(phrases: list[str] | None = None) -> Column:
    """Phrase matches over the summary and all achievements."""
    achievements = F.flatten(F.col("resume.experience.achievements"))
    return phrase_count(F.concat_ws(" ", F.array(F.col("resume.summary")), achievements), phrases)


def awkward_language(threshold: int = 3) -> Column:
    return buzzword_count() >= threshold


def label_pairs(pairs: DataFrame, as_of: str, keep: list[str] | None = None) -> DataFrame:
    """pair_id, skills_overlap and the five failure flags (plus any ``keep`` columns)."""
    return with_career(pairs, as_of).select(
        F.col("metadata.pair_id").alias("pair_id"),
        *(keep or []),
        skills_overlap().alias("skills_overlap"),
        experience_mismatch().alias("experience_mismatch"),
        seniority_mismatch().alias("seniority_mismatch"),
        missing_core_skills().alias("missing_core_skills"),
        hallucinated_skills().alias("hallucinated_skills"),
        awkward_language().alias("awkward_language"),
    )


def with_failure_totals(labels: DataFrame) -> DataFrame:
    """Add any_failure and failure_count over the five flags (the overlap is not a failure)."""
    from assaykit.operators.failures import with_totals

    return with_totals(labels, PAIR_FAILURES, "any_failure")
