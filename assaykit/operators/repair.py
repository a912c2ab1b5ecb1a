"""Bounded repair: fix invalid rows, check them again, keep the last state."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.dates import parse_date
from assaykit.functions.stats import rate
from assaykit.operators.validation import digits
from assaykit.session import store

MAX_ATTEMPTS = 3


def match_validations(pairs: DataFrame, validations: DataFrame, key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """(pairs with their first validation, pairs that have none and are given up)."""
    return pairs.join(validations, key), pairs.join(validations, key, "left_anti")


def restamp_resume(old: str, new: Column) -> Column:
    """A repaired resume keeps template, fit level and style of the first one; the trace id is new but repeatable."""
    meta = F.struct(
        F.sha2(F.concat_ws("|", F.col("metadata.pair_id"), F.to_json(new)), 256).substr(1, 32).alias("trace_id"),
        F.col(f"{old}.metadata.generated_at").alias("generated_at"),
        F.col(f"{old}.metadata.prompt_template").alias("prompt_template"),
        F.col(f"{old}.metadata.fit_level").alias("fit_level"),
        F.col(f"{old}.metadata.writing_style").alias("writing_style"),
    )
    return new.withField("metadata", meta)


def repair_loop(
    validated: DataFrame,
    repair: Callable[[DataFrame, int], DataFrame],
    validate: Callable[[DataFrame], DataFrame],
    max_attempts: int = MAX_ATTEMPTS,
    cut_lineage: bool = True,
    only_invalid: bool = False,
) -> DataFrame:
    """Repair the invalid rows of ``validated`` at most ``max_attempts`` times.

    ``repair(df, attempt)`` gets the rows still invalid (record columns plus ``errors``) and returns them, further columns
    included, with the resume replaced where the attempt worked; a row whose repair failed is returned unchanged and
    still uses up the attempt. ``validate`` re-checks. Whatever the repair returns, the loop keeps the job as it was,
    stamps the attempt and gives a changed resume its first template, fit level and style and a new trace id. Rows valid
    from the start pass through with 0 attempts. Result columns: those of ``validated`` plus ``attempts`` (the attempt that
    succeeded, or the maximum).

    The invalid rows are stored once, and each round works on those that remain. With ``cut_lineage`` its state is written to
    the shared folder, so a lost executor never re-runs earlier rounds and an outside repair model is asked once per row and
    attempt; the rounds end when no invalid row is left. With ``only_invalid`` the rows valid from the start are left out.
    """
    keep = (lambda df: store(df, "repair-round")) if cut_lineage else (lambda df: df)
    columns = validated.columns
    checks = ("errors", "error_count", "is_valid")
    records = [c for c in columns if c not in checks]
    pending = keep(validated.where("NOT is_valid"))
    done = [pending.where("FALSE") if only_invalid else validated.where("is_valid")]
    done = [done[0].withColumn("attempts", F.lit(0))]
    for attempt in range(1, max_attempts + 1):
        if cut_lineage and pending.isEmpty():
            break
        held = pending.withColumns({"_job": F.col("job"), "_resume": F.col("resume")})
        state = keep(validate(stamped(repair(held, attempt), attempt).select(*records)).select(*columns))
        last = attempt == max_attempts
        done.append((state if last else state.where("is_valid")).withColumn("attempts", F.lit(attempt)))
        pending = state.where("NOT is_valid")
    return reduce(DataFrame.unionByName, done)


def stamped(df: DataFrame, attempt: int) -> DataFrame:
    """Rows after a repair, with the job of before (``_job``), the attempt in the metadata and a changed resume restamped."""
    changed = ~F.col("resume").eqNullSafe(F.col("_resume"))
    return df.withColumns({
        "job": F.col("_job"), "metadata": F.col("metadata").withField("correction_attempts", F.lit(attempt)),
        "resume": F.when(changed, restamp_resume("_resume", F.col("resume"))).otherwise(F.col("resume")),
    })


def deterministic_fix(df: DataFrame, attempt: int, as_of: str) -> DataFrame:
    """A repair without a model: attempt 1 pads the phone, attempt 2 drops future entries, attempt 3 drops blank skills."""
    today = F.lit(as_of).cast("date")
    resume = F.col("resume")
    if attempt == 1:
        contact = resume["contact"]
        phone = F.when(digits(contact["phone"]) < 10, F.rpad(F.regexp_replace(contact["phone"], r"\D", ""), 10, "0"))
        fixed = resume.withField("contact.phone", F.coalesce(phone, contact["phone"]))
    elif attempt == 2:
        keep = F.filter(resume["experience"], lambda e: F.coalesce(parse_date(e["start_date"]) <= today, F.lit(True)))
        study = F.filter(resume["education"],
                         lambda e: F.coalesce(parse_date(e["graduation_date"]) <= today, F.lit(True)))
        fixed = resume.withField("experience", keep).withField("education", study)
    else:
        fixed = resume.withField("skills", F.filter(resume["skills"], lambda s: F.trim(s["name"]) != ""))
    return df.withColumn("resume", fixed)


def corrected_and_failed(result: DataFrame, given_up: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that needed repair, split by the outcome; pairs without a first validation (``given_up``) have failed."""
    tried = result.where("attempts > 0")
    failed = tried.where("NOT is_valid")
    return tried.where("is_valid"), failed if given_up is None else failed.unionByName(given_up, allowMissingColumns=True)


def repair_stats(result: DataFrame, given_up: DataFrame | None = None) -> DataFrame:
    """Rows (name, value): total, corrected, permanently_failed, correction_rate and the attempts histogram.

    ``given_up`` are invalid pairs without a first validation: they count as permanently failed, with no attempt.
    """
    per_attempt = result.where("attempts > 0").groupBy("attempts").agg(
        F.count("*").alias("n"), F.count_if("is_valid").alias("ok"))
    counted = per_attempt.select("n", "ok")
    if given_up is not None:
        counted = counted.unionByName(given_up.agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("ok")))
    totals = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"))
    rows = [("total_pairs", F.col("n")), ("corrected", F.col("ok")), ("permanently_failed", F.col("n") - F.col("ok")),
            ("correction_rate", rate(F.col("ok"), F.col("n")))]
    head = totals.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in rows])))
    histogram = per_attempt.select(
        F.concat(F.lit("attempts_"), F.col("attempts").cast("string")).alias("name"), F.col("n").cast("double").alias("value"))
    return head.unionByName(histogram)


def failure_reasons(result: DataFrame) -> DataFrame:
    """"path: message" of every error left after the last attempt, one row per error."""
    left = result.where("attempts > 0 AND NOT is_valid").select("metadata.pair_id", F.explode("errors").alias("e"))
    return left.select("pair_id", F.concat_ws(": ", "e.field_path", "e.message").alias("reason"))


def with_corrected(valid: DataFrame, corrected: DataFrame, include: bool = True) -> DataFrame:
    """Valid rows, with the corrected ones added when asked."""
    return valid.unionByName(corrected) if include else valid
