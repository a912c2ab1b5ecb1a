"""Pair analytics: labels joined to pairs, rates per group, rule/judge agreement, the run's metric table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from assaykit.functions.stats import rate
from assaykit.operators.failures import any_flag, failure_cube, flag_correlation, rates_by
from assaykit.operators.hotkeys import last_per_key
from assaykit.operators.labels import label_pairs, with_failure_totals
from assaykit.operators.repair import repair_loop, repair_stats
from assaykit.operators.validation import validate_pairs
from assaykit.schemas import FIT_LEVELS, PAIR_FAILURES, WRITING_STYLES
from assaykit.session import store


def position(levels: list[str], c: str) -> Column:
    """Place of a value in its defined order, for sorting."""
    return F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(c))


def labelled_pairs(pairs: DataFrame, labels: DataFrame, order: str | None = None) -> DataFrame:
    """Flat table of pairs that have a label. With ``order`` the last label of a repeated pair id wins.

    ``pairs`` may hold the nested record; only four small fields take part in the join.
    """
    lookup = last_per_key(labels, ["pair_id"], order) if order else labels
    facts = pairs.select(
        F.col("metadata.pair_id").alias("pair_id"),
        F.col("metadata.fit_level").alias("fit_level"),
        F.col("metadata.writing_style").alias("writing_style"),
        F.col("job.metadata.is_niche_role").alias("is_niche"),
    )
    return with_failure_totals(facts.join(lookup.drop(*([order] if order else [])), "pair_id"))


def rates_by_level(flat: DataFrame, flags: list[str] = PAIR_FAILURES) -> DataFrame:
    """Rates per fit level in level order; levels that do not occur are left out."""
    known = flat.where(F.col("fit_level").isin(*FIT_LEVELS))
    return rates_by(known, ["fit_level"], flags).orderBy(position(FIT_LEVELS, "fit_level"), "mode")


def rates_by_style(flat: DataFrame, flags: list[str] = PAIR_FAILURES) -> DataFrame:
    known = flat.where(F.col("writing_style").isin(*WRITING_STYLES))
    return rates_by(known, ["writing_style"], flags).orderBy(position(WRITING_STYLES, "writing_style"), "mode")


def niche_vs_standard(flat: DataFrame, flags: list[str] = PAIR_FAILURES, weight: str | None = None) -> DataFrame:
    role = F.when(F.col("is_niche"), "niche").otherwise("standard")
    return rates_by(flat.where(F.col("is_niche").isNotNull()).withColumn("role", role), ["role"], flags, weight=weight)


def judge_averages(judged: DataFrame, scores: list[str]) -> DataFrame:
    """Mean per score over all judged rows (rounded to 2) and the number judged."""
    means = [rate(F.sum(F.col(s).cast("long")), F.count("*")) for s in scores]
    return judged.agg(
        *[F.round(m, 2).alias(f"avg_{s}") for m, s in zip(means, scores)], F.count("*").alias("total_judged")
    )


def gap_analysis(judged: DataFrame, labels: DataFrame, topics: dict[str, tuple[str, str]], key: str = "pair_id",
                 threshold: int = 3, order: str | None = None) -> DataFrame:
    """Rows (topic, rule_flags, judge_flags, both_flags) over judged rows that have a label.

    With ``order`` the last label of a repeated key counts, as in :func:`labelled_pairs`. ``topics`` maps a topic to (rule flag column, judge score column). No judged rows give no result rows.
    """
    joined = judged.join(last_per_key(labels, [key], order) if order else labels, key)
    counts = []
    for topic, (flag, score) in topics.items():
        rule, judge = F.col(flag).cast("boolean"), F.col(score) >= threshold
        counts += [F.count_if(rule).alias(f"r_{topic}"), F.count_if(judge).alias(f"j_{topic}"),
                   F.count_if(rule & judge).alias(f"b_{topic}")]
    row = joined.agg(*counts).join(F.broadcast(judged.agg(F.count("*").alias("_n"))))  # one row each
    entries = [
        F.struct(F.lit(t).alias("topic"), F.col(f"r_{t}").alias("rule_flags"), F.col(f"j_{t}").alias("judge_flags"),
                 F.col(f"b_{t}").alias("both_flags"))
        for t in topics
    ]
    return row.where(F.col("_n") > 0).select(F.inline(F.array(*entries)))


def metric_rows(df: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"))


GROUPS = ["fit_level", "writing_style", "is_niche"]


class LabelledRun(NamedTuple):
    """One run over pairs: what was checked, what was repaired, and the cube of the labelled population."""

    checked: DataFrame
    repaired: DataFrame
    flat: DataFrame
    cube: DataFrame
    totals: dict[str, int]


def labelled_run(pairs: DataFrame, as_of: str, repair: Callable[[DataFrame, int], DataFrame]) -> LabelledRun:
    """Validate, label and repair ``pairs`` in one scan of them.

    The scan writes one row a pair: the errors, the labels, and the record itself where it is invalid; totals are observed on
    the way. Repair rounds read these invalid records only. The labelled population is that of the published report: pairs valid
    from the start and pairs that a repair made valid, these with the labels of their repaired state.
    """
    groups = [F.col("metadata.fit_level").alias("fit_level"), F.col("metadata.writing_style").alias("writing_style"),
              F.col("job.metadata.is_niche_role").alias("is_niche")]
    record = F.when(~F.col("is_valid"), F.struct(*pairs.columns)).alias("record")
    seen = Observation("labelled-run")
    once = label_pairs(validate_pairs(pairs, as_of), as_of, keep=[*groups, F.col("is_valid"), F.col("errors"), record])
    checked = store(once.observe(seen, F.count("*").alias("n"), F.count_if("is_valid").alias("ok")), "checked-pairs")
    invalid = checked.where("NOT is_valid").select("record.*", "errors", F.size("errors").alias("error_count"), "is_valid")
    repaired = repair_loop(invalid, repair, lambda df: validate_pairs(df, as_of), only_invalid=True)
    names = ["pair_id", *GROUPS, "skills_overlap", *PAIR_FAILURES]
    corrected = label_pairs(repaired.where("is_valid"), as_of, keep=groups).select(*names)
    flat = store(checked.where("is_valid").select(*names).unionByName(corrected), "labelled-pairs")
    cube = failure_cube(flat, GROUPS, PAIR_FAILURES, overlap=F.col("skills_overlap"))
    return LabelledRun(checked, repaired, flat, cube, seen.get)


def breakdown(cube: DataFrame) -> DataFrame:
    """Rates of the whole population and of every group as rows (section, name, value), rolled up from the cube at once."""
    role = F.when(F.col("is_niche").isNull(), None).when(F.col("is_niche"), "niche").otherwise("standard")
    keyed = cube.withColumn("role", role)
    keys = ["fit_level", "writing_style", "role"]
    sets = [[F.col(k)] for k in keys] + [[]]
    rolled = keyed.groupingSets(sets, *keys).agg(
        F.grouping_id(*keys).alias("_g"), F.sum("n").alias("n"), F.sum("overlap").alias("overlap"),
        F.sum(F.when(any_flag(PAIR_FAILURES), F.col("n")).otherwise(0)).alias("bad"),
        *[F.sum(F.col(f).cast("long") * F.col("n")).alias(f) for f in PAIR_FAILURES])
    row = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.alias("name"), value.alias("value"))
    share = lambda c: rate(F.col(c), F.col("n"))
    whole = F.array(row("overall", F.lit("overall_failure_rate"), F.round(share("bad"), 3)),
                    row("overall", F.lit("avg_skills_overlap"), F.round(F.coalesce(rate(F.col("overlap"), F.col("n")), F.lit(0.0)), 3)),
                    *[row("failure_rates", F.lit(f), F.round(share(f), 3)) for f in PAIR_FAILURES])
    parts = F.when(F.col("_g") == 7, whole)
    # grouping_id has a bit for every key that is rolled away
    for bits, key, section in [(3, "fit_level", "by_fit_level"), (5, "writing_style", "by_template"), (6, "role", "niche_vs_standard")]:
        known = (F.col("_g") == bits) & F.col(key).isNotNull()
        parts = parts.when(known, F.array(*[row(section, F.concat_ws("/", key, F.lit(f)), share(f)) for f in PAIR_FAILURES]))
    return rolled.select(F.inline(parts))


def quality_report(run: LabelledRun, judge: DataFrame | None = None, given_up: DataFrame | None = None) -> DataFrame:
    """Long table (section, name, value) of a whole run: totals, correction, rates, breakdowns, field failures, the judge.

    Valid pairs are those valid from the start or after repair, as are the labelled ones; ``judge`` (pair_id and the three scores)
    counts for labelled pairs, as only these are shown to a judge. Everything comes from what the run has stored.
    """
    spark = run.cube.sparkSession
    fixed = repair_stats(run.repaired, given_up)
    n, ok = run.totals["n"], run.totals["ok"]
    totals = fixed.where("name = 'corrected'").select(F.inline(F.array(*[
        F.struct(F.lit("totals").alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value")) for name, value in (
            ("pairs_generated", F.lit(n)), ("valid_pairs", F.lit(ok) + F.col("value")), ("invalid_pairs", F.lit(n - ok)))])))
    fields = run.checked.where("NOT is_valid").select(F.explode("errors.field_path").alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    value = F.when(F.col("name") == "correction_rate", F.round("value", 3)).otherwise(F.col("value"))
    parts = [totals, breakdown(run.cube), metric_rows(fields, "schema_field_failures", F.col("p"), F.col("n")),
             metric_rows(fixed, "correction", F.col("name"), value)]
    if judge is not None:
        scores = ["quality_score", "hallucination_score", "awkward_language_score"]
        both = run.flat.select("pair_id", "hallucinated_skills", "awkward_language").join(judge, "pair_id")
        parts.append(judge_summary(both, scores, {
            "hallucination": ("hallucinated_skills", "hallucination_score"), "awkward_language": ("awkward_language", "awkward_language_score")}))
    return reduce(DataFrame.unionByName, parts) if n else spark.createDataFrame([], parts[0].schema)


def judge_summary(both: DataFrame, scores: list[str], topics: dict[str, tuple[str, str]], threshold: int = 3) -> DataFrame:
    """Mean scores (rounded to 2), number judged, and per topic how often the rule, the judge and both raise a flag: one pass."""
    rows = [("llm_judge", f"avg_{s}", F.round(rate(F.sum(F.col(s).cast("long")), F.count("*")), 2)) for s in scores]
    rows.append(("llm_judge", "total_judged", F.count("*")))
    for topic, (flag, score) in topics.items():
        rule, high = F.col(flag), F.col(score) >= threshold
        rows += [(f"gap_{topic}", "rule_based_flags", F.count_if(rule)), (f"gap_{topic}", "judge_flags", F.count_if(high)),
                 (f"gap_{topic}", "both_agree", F.count_if(rule & high))]
    row = both.agg(F.count("*").alias("_n"), *[v.cast("double").alias(f"v{i}") for i, (_, _, v) in enumerate(rows)])
    return row.where("_n > 0").select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(name).alias("name"), F.col(f"v{i}").alias("value")) for i, (s, name, _) in enumerate(rows)])))


def chart_series(cube: DataFrame) -> DataFrame:
    """Data behind the report's charts as one long table (chart, series, label, pos, value), all from the failure cube."""

    def rows(df: DataFrame, chart: str, series: Column, label: Column, pos: Column, value: Column) -> DataFrame:
        return df.select(F.lit(chart).alias("chart"), series.alias("series"), label.alias("label"),
                         pos.cast("int").alias("pos"), value.cast("double").alias("value"))

    by_level = rates_by(cube, ["fit_level"], PAIR_FAILURES, weight="n")
    level = position(FIT_LEVELS, "fit_level")
    stacked = by_level.where(F.col("mode").isin("hallucinated_skills", "seniority_mismatch"))
    by_style = rates_by(cube, ["writing_style"], PAIR_FAILURES, weight="n")
    mode_pos = position(PAIR_FAILURES, "mode")
    correlation = flag_correlation(cube, PAIR_FAILURES, weight="n")
    return reduce(DataFrame.unionByName, [
        rows(correlation, "correlation", F.col("mode_a"), F.col("mode_b"), position(PAIR_FAILURES, "mode_b"),
             F.round("correlation", 6)),
        rows(by_level, "by_fit_level", F.col("mode"), F.col("fit_level"), level, F.col("rate")),
        rows(by_style, "by_style", F.col("mode"), F.col("writing_style"), position(WRITING_STYLES, "writing_style"),
             F.col("rate")),
        rows(niche_vs_standard(cube, weight="n"), "niche_vs_standard", F.col("role"), F.col("mode"), mode_pos, F.col("rate")),
        rows(stacked, "claims_by_fit_level", F.col("mode"), F.col("fit_level"), level, F.col("rate")),
    ])
