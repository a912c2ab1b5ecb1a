"""Failure analytics over 0/1 flags: rates, intervals, coverage, co-occurrence, correlation, run comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.stats import proportion_interval, rate, relative_drop
from assaykit.schemas import ITEM_FAILURES, REPAIR_CATEGORIES
from assaykit.session import store


def failure_cube(df: DataFrame, groups: list[str], flags: list[str], **sums: Column) -> DataFrame:
    """How many rows (``n``) have each combination of groups and flags, with further sums: stored, a few rows.

    Every rate, interval, co-occurrence and correlation of the table follows from it, so a report scans the table once. The
    functions below take such a cube with ``weight="n"``.
    """
    more = [F.sum(c).alias(name) for name, c in sums.items()]
    return store(df.groupBy(*groups, *flags).agg(F.count("*").alias("n"), *more), "failure-cube")


def _rows(weight: str | None) -> Column:
    return F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))


def _sum(value: Column, weight: str | None) -> Column:
    return F.sum(value.cast("long") if weight is None else value.cast("long") * F.col(weight))


def any_flag(flags: list[str]) -> Column:
    return F.greatest(*[F.col(f).cast("int") for f in flags]) == 1


def flag_sum(flags: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).cast("int") for f in flags])


def with_totals(df: DataFrame, flags: list[str], any_name: str = "overall_failure") -> DataFrame:
    """Add "any flag set" and the number of flags set."""
    return df.withColumn(any_name, any_flag(flags)).withColumn("failure_count", flag_sum(flags))


def flatten_judged(records: DataFrame, flags: list[str] = ITEM_FAILURES) -> DataFrame:
    """One flat row per judged record; records without a judgement are left out."""
    flat = records.where(F.col("judge_result").isNotNull()).select(
        "trace_id", F.col("metadata.category").alias("category"), *[F.col(f"judge_result.{f}") for f in flags]
    )
    return with_totals(flat, flags)


def _long(df: DataFrame, keys: list[str], pairs: list[tuple[str, Column]], names: list[str]) -> DataFrame:
    """Turn (label, struct) pairs of one aggregate row into rows."""
    entries = F.array(*[F.struct(F.lit(label).alias("_k"), value.alias("_v")) for label, value in pairs])
    return df.select(*keys, F.inline(entries)).select(*keys, F.col("_k").alias(names[0]), F.col("_v").alias(names[1]))


def rates_by(df: DataFrame, keys: list[str], flags: list[str], mode: str = "mode", weight: str | None = None) -> DataFrame:
    """Rows (keys, mode, failures, n, rate): one pass, one small shuffle."""
    counted = df.groupBy(*keys).agg(_rows(weight).alias("n"), *[_sum(F.col(f), weight).alias(f) for f in flags])
    long = _long(counted, [*keys, "n"], [(f, F.col(f)) for f in flags], [mode, "failures"])
    return long.where(F.col("n") > 0).select(
        *keys, mode, "failures", "n", rate(F.col("failures"), F.col("n")).alias("rate")
    )


def mode_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    return rates_by(df, [], flags)


def overall_rate(df: DataFrame, flag: str = "overall_failure", z: float = 1.96) -> DataFrame:
    """One row: n, overall rate and its normal-approximation interval."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("_hits")).select(
        "n", rate(F.col("_hits"), F.col("n")).alias("overall_rate")
    )
    return _with_interval(row, z)


def _with_interval(row: DataFrame, z: float = 1.96) -> DataFrame:
    low, high = proportion_interval(F.col("overall_rate"), F.col("n"), z)
    return row.withColumn("ci_low", low).withColumn("ci_high", high)


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), category)


def category_entropy(df: DataFrame, category: str = "category", weight: str | None = None) -> DataFrame:
    """Shannon entropy (base 2) of the category distribution, 0 for no rows.

    Written as log2(N) - sum(n * log2(n)) / N, so both levels are plain aggregates.
    """
    counts = df.groupBy(category).agg(_rows(weight).alias("n"))
    sums = counts.agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    entropy = F.log2(F.col("N").cast("double")) - F.col("s") / F.col("N")
    return sums.select(F.coalesce(entropy, F.lit(0.0)).alias("entropy"))


def category_coverage(
    df: DataFrame, expected: list[str] = REPAIR_CATEGORIES, category: str = "category"
) -> DataFrame:
    """One row: does the set of categories equal the expected one, and how many are there?"""
    seen = df.groupBy(category).agg(F.lit(1).alias("_one"))
    known = F.col(category).isin(*expected)
    return seen.agg(
        F.count(category).alias("n_categories"), F.count(F.when(known, 1)).alias("n_expected")
    ).select(
        "n_categories",
        "n_expected",
        ((F.col("n_categories") == len(expected)) & (F.col("n_expected") == len(expected))).alias("all_represented"),
    )


def worst_items(df: DataFrame, min_failures: int = 3) -> DataFrame:
    """Rows with many flags at once, most flags first, ties by id."""
    return (
        df.where(F.col("failure_count") >= min_failures)
        .select("trace_id", "category", "failure_count")
        .orderBy(F.desc("failure_count"), "trace_id")
    )


def _pair_sums(df: DataFrame, flags: list[str], weight: str | None) -> DataFrame:
    """One row with n, the sum of each flag and of each product of two flags."""
    ints = {f: F.col(f).cast("long") for f in flags}
    sums = [_sum(ints[a], weight).alias(f"s_{a}") for a in flags]
    products = [
        _sum(ints[a] * ints[b], weight).alias(f"p_{i}_{j}")
        for i, a in enumerate(flags)
        for j, b in enumerate(flags)
        if i <= j
    ]
    return df.agg(_rows(weight).alias("n"), *sums, *products)


def _matrix(df: DataFrame, flags: list[str], cell, name: str, weight: str | None) -> DataFrame:
    entries = [
        F.struct(
            F.lit(a).alias("mode_a"),
            F.lit(b).alias("mode_b"),
            cell(a, b, F.col(f"p_{min(i, j)}_{max(i, j)}")).alias(name),
        )
        for i, a in enumerate(flags)
        for j, b in enumerate(flags)
    ]
    return _pair_sums(df, flags, weight).select("n", F.inline(F.array(*entries))).where(F.col("n") > 0).drop("n")


def cooccurrence(df: DataFrame, flags: list[str], weight: str | None = None) -> DataFrame:
    """Share of rows where both flags are set; the diagonal is the flag's own rate. One pass over the table."""
    return _matrix(df, flags, lambda a, b, p: rate(p, F.col("n")), "share", weight)


def flag_correlation(df: DataFrame, flags: list[str], weight: str | None = None) -> DataFrame:
    """Pearson correlation from exact integer sums; NULL where a flag is constant."""

    def cell(a: str, b: str, p: Column) -> Column:
        n, sa, sb = F.col("n").cast("double"), F.col(f"s_{a}").cast("double"), F.col(f"s_{b}").cast("double")
        spread = (n * sa - sa * sa) * (n * sb - sb * sb)  # a 0/1 flag equals its own square
        return F.try_divide(n * p - sa * sb, F.sqrt(spread))

    return _matrix(df, flags, cell, "correlation", weight)


def run_summary(records: DataFrame, flags: list[str], tag: str, min_failures: int = 3) -> DataFrame:
    """Long table (tag, section, name, value) of one run; without judged rows only the record counts and an error row.

    ``records`` has the flat judged columns, NULL flags where a record was not judged, and ``passed_validation``. They are
    scanned twice: once for a cube of all counts, from which everything but the worst items follows, and once for these, which
    are rows themselves.
    """
    judged = F.col(flags[0]).isNotNull()
    cube = failure_cube(records, ["category", "passed_validation"], flags)
    n = F.col("n")
    totals = cube.agg(
        _rows("n").alias("total_generated"),
        F.coalesce(F.sum(F.when(F.col("passed_validation"), n)), F.lit(0)).alias("passed_validation"),
        F.coalesce(F.sum(F.when(judged, n)), F.lit(0)).alias("judged"),
        F.coalesce(F.sum(F.when(any_flag(flags), n)), F.lit(0)).alias("_failed"),
        *[_sum(F.col(f), "n").alias(f) for f in flags],
    )
    overall = rate(F.col("_failed"), F.col("judged"))
    low, high = proportion_interval(overall, F.col("judged"))
    have = F.col("judged") > 0
    entries = [
        ("totals", "total_generated", F.col("total_generated").cast("double"), F.lit(True)),
        ("totals", "passed_validation", F.col("passed_validation").cast("double"), F.lit(True)),
        ("totals", "judged", F.col("judged").cast("double"), F.lit(True)),
        ("error", "No judged records", F.lit(0.0), ~have),
        ("overall", "overall_failure_rate", overall, have),
        ("overall", "ci_low", low, have),
        ("overall", "ci_high", high, have),
        *[("per_mode_rates", f, rate(F.col(f), F.col("judged")), have) for f in flags],
    ]
    head = totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("section"), F.lit(n).alias("name"), v.alias("value"), w.alias("_keep")
                    )
                    for s, n, v, w in entries
                ]
            )
        )
    ).where("_keep").drop("_keep")
    counts = cube.where(judged).groupBy("category").agg(F.sum("n").alias("n"))
    coverage = counts.select(F.lit("category_counts").alias("section"), F.col("category").alias("name"),
                             F.col("n").cast("double").alias("value"))
    # counts of categories: one row each
    entropy = category_entropy(counts, weight="n").join(F.broadcast(totals.select("judged"))).where("judged > 0").select(
        F.lit("coverage").alias("section"), F.lit("entropy").alias("name"), F.round("entropy", 9).alias("value"))
    worst = with_totals(records.where(judged), flags).where(F.col("failure_count") >= min_failures).select(
        F.lit("worst_items").alias("section"), F.col("trace_id").alias("name"),
        F.col("failure_count").cast("double").alias("value"))
    parts = reduce(DataFrame.unionByName, [head, coverage, entropy, worst])
    return parts.select(F.lit(tag).alias("tag"), "section", "name", "value")


def compare_modes(before: DataFrame, after: DataFrame, flags: list[str]) -> DataFrame:
    """Rate per mode before and after, and the relative reduction."""
    b = mode_rates(before, flags).select("mode", F.col("rate").alias("before_rate"))
    a = mode_rates(after, flags).select("mode", F.col("rate").alias("after_rate"))
    # a full join of two tables with one row per mode
    return b.join(a, "mode", "full").select(
        "mode", "before_rate", "after_rate",
        relative_drop(F.col("before_rate"), F.col("after_rate")).alias("reduction"),
    )


def compare_verdict(before: DataFrame, after: DataFrame, target: float = 0.80) -> DataFrame:
    """Overall rates, intervals, their overlap, the improvement and whether it reaches the target."""
    return _verdict(overall_rate(before), overall_rate(after), target)


def _verdict(before: DataFrame, after: DataFrame, target: float) -> DataFrame:
    def named(df: DataFrame, run: str) -> DataFrame:
        return df.select(F.col("overall_rate").alias(f"{run}_overall"), F.col("ci_low").alias(f"{run}_low"),
                         F.col("ci_high").alias(f"{run}_high"), F.col("n").alias(f"{run}_n"))

    # both sides are one aggregate row; a run without judged rows gives no verdict
    both = named(before, "before").join(F.broadcast(named(after, "after"))).where("before_n > 0 AND after_n > 0")
    apart = (F.col("before_low") <= F.col("after_high")) & (F.col("after_low") <= F.col("before_high"))
    gain = relative_drop(F.col("before_overall"), F.col("after_overall"))
    return both.withColumn("improvement", gain).withColumn("ci_overlap", apart).withColumn("passed", F.col("improvement") >= target)


def compare_modes_in_one(df: DataFrame, flags: list[str], before: Column, after: Column, weight: str | None = None) -> DataFrame:
    """:func:`compare_modes` for two runs that are parts of one table, told apart by conditions: one pass over it."""
    some = lambda run, value: F.coalesce(F.sum(F.when(run, value * (1 if weight is None else F.col(weight)))), F.lit(0))
    row = df.agg(*[some(run, F.lit(1)).alias(f"n{i}") for i, run in enumerate((before, after))],
                 *[some(run, F.col(f).cast("long")).alias(f"{f}{i}") for f in flags for i, run in enumerate((before, after))])
    share = lambda f, i: F.when(F.col(f"n{i}") > 0, rate(F.col(f"{f}{i}"), F.col(f"n{i}")))
    long = _long(row, [], [(f, F.struct(share(f, 0).alias("b"), share(f, 1).alias("a"))) for f in flags], ["mode", "v"])
    both = long.select("mode", F.col("v.b").alias("before_rate"), F.col("v.a").alias("after_rate"))
    return both.where("before_rate IS NOT NULL OR after_rate IS NOT NULL").select(
        "*", relative_drop(F.col("before_rate"), F.col("after_rate")).alias("reduction"))


def compare_verdict_in_one(df: DataFrame, before: Column, after: Column, flag: str = "overall_failure", target: float = 0.80) -> DataFrame:
    """:func:`compare_verdict` for two runs that are parts of one table: one pass over it, then one row."""
    flagged = F.col(flag).cast("long")
    counts = df.agg(*[f(F.when(run, x)).alias(f"{name}{i}") for i, run in enumerate((before, after))
                      for name, f, x in (("n", F.count, F.lit(1)), ("hits", F.sum, flagged))])
    side = lambda i: counts.select(F.col(f"n{i}").alias("n"), rate(F.col(f"hits{i}"), F.col(f"n{i}")).alias("overall_rate"))
    return _verdict(*(_with_interval(side(i)) for i in (0, 1)), target)
