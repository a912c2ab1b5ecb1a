import random
import pytest
from pyspark.sql import functions as F

from assaykit.functions.stats import proportion_interval
from assaykit.operators import agreement, failures
from assaykit.schemas import ITEM_FAILURES, LABELS, PAIR_FAILURES, PAIR_JUDGEMENT


def flags_table(spark, rows):
    cols = ", ".join(f"{f} int" for f in ITEM_FAILURES)
    return failures.with_totals(spark.createDataFrame(rows, f"trace_id string, category string, {cols}"), ITEM_FAILURES)


def published_like(spark):
    """50 rows with the published category counts and failure rates 0.06 / 0.16 / 0.18 and overall 0.30."""
    cats = ["hvac"] * 16 + ["plumbing"] * 10 + ["general"] * 9 + ["electrical"] * 8 + ["appliance"] * 7
    rows = []
    for i, c in enumerate(cats):
        incomplete, complicated, tips = int(i < 3), int(i < 1 or 3 <= i < 10), int(i < 2 or 8 <= i < 15)
        rows.append((f"qa_{i + 1:04d}", c, incomplete, 0, 0, complicated, 0, tips))
    return flags_table(spark, rows)


def test_rates_interval_entropy(spark):
    df = published_like(spark)
    rates = {r["mode"]: r["rate"] for r in failures.mode_rates(df, ITEM_FAILURES).collect()}
    assert rates == pytest.approx({
        "incomplete_answer": 0.06, "safety_violations": 0, "unrealistic_tools": 0, "overcomplicated_solution": 0.16,
        "missing_context": 0, "poor_quality_tips": 0.18})
    row = failures.overall_rate(df).first()
    assert (row.overall_rate, row.ci_low, row.ci_high) == pytest.approx((0.3, 0.17297748231120594, 0.42702251768879407))
    assert failures.category_entropy(df).first().entropy == pytest.approx(2.2558543814495713)
    assert failures.category_coverage(df).first().all_represented
    assert [tuple(r) for r in failures.worst_items(df).collect()] == [("qa_0001", "hvac", 3)]


def test_empty_input(spark):
    df = published_like(spark).where("false")
    row = failures.overall_rate(df).first()
    assert (row.n, row.overall_rate, row.ci_low, row.ci_high) == (0, 0.0, 0.0, 0.0)
    assert failures.category_entropy(df).first().entropy == 0.0
    assert failures.mode_rates(df, ITEM_FAILURES).count() == 0
    summary = failures.run_summary(df.withColumn("passed_validation", F.lit(True)), ITEM_FAILURES, "t")
    assert ("error", "No judged records") in {(r["section"], r["name"]) for r in summary.collect()}


def test_interval_of_small_rate(spark):
    low, high = proportion_interval(F.lit(0.02), F.lit(50))
    row = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (row.a, row.b) == pytest.approx((0.0, 0.05880602015151773))


def test_compare(spark):
    before = published_like(spark)
    after = before.withColumn("overall_failure", F.col("trace_id") == "qa_0001")
    row = failures.compare_verdict(before, after).first()
    assert row.improvement == pytest.approx(0.9333333333) and row.passed and not row.ci_overlap
    modes = {r["mode"]: r["reduction"] for r in failures.compare_modes(before, before, ITEM_FAILURES).collect()}
    assert set(modes.values()) == {0.0}


def test_constant_flag_has_no_correlation(spark):
    df = published_like(spark)
    cells = {(r.mode_a, r.mode_b): r.correlation for r in failures.flag_correlation(df, ITEM_FAILURES).collect()}
    assert cells["missing_context", "poor_quality_tips"] is None
    assert cells["poor_quality_tips", "poor_quality_tips"] == pytest.approx(1.0)


def small_run(spark):
    """Four pairs, three of them labelled."""
    labels = spark.createDataFrame([
        ("a", 1.0, False, True, False, True, False),
        ("b", 0.5, False, False, False, True, True),
        ("c", 0.0, False, False, False, False, False)], LABELS)
    meta = [("a", "Mismatch", True), ("b", "Mismatch", False), ("c", "Good", False), ("d", "Poor", False)]
    pairs = spark.createDataFrame(meta, "pair_id string, fit_level string, niche boolean").select(
        F.struct("pair_id", "fit_level", F.lit("formal").alias("writing_style")).alias("metadata"),
        F.struct(F.struct(F.col("niche").alias("is_niche_role")).alias("metadata")).alias("job"))
    return pairs, labels


def test_levels_roles_and_unlabelled_pairs(spark):
    flat = agreement.labelled_pairs(*small_run(spark))
    assert {(r.pair_id, r.any_failure, r.failure_count) for r in flat.collect()} == {("a", True, 2), ("b", True, 2), ("c", False, 0)}
    rows = agreement.rates_by_level(flat).collect()
    assert list(dict.fromkeys(r.fit_level for r in rows)) == ["Good", "Mismatch"]  # level order, absent levels left out
    rate = {(r.fit_level, r["mode"]): r.rate for r in rows}
    assert rate["Mismatch", "hallucinated_skills"] == 1.0 and rate["Mismatch", "awkward_language"] == 0.5
    roles = {(r.role, r["mode"]): r.rate for r in agreement.niche_vs_standard(flat).collect()}
    assert roles["niche", "seniority_mismatch"] == 1.0 and roles["standard", "hallucinated_skills"] == 0.5


def test_judge_averages_and_gaps(spark):
    _, labels = small_run(spark)
    judge = spark.createDataFrame(
        [("a", 4, 1, 5, "", []), ("b", 2, 3, 6, "", []), ("c", 3, 0, 9, "", []), ("z", 5, 5, 0, "", [])], PAIR_JUDGEMENT)
    row = agreement.judge_averages(judge, ["quality_score", "hallucination_score"]).first()
    assert (row.avg_quality_score, row.avg_hallucination_score, row.total_judged) == (5.0, 3.5, 4)  # all rows count here
    topics = {"hallucination": ("hallucinated_skills", "hallucination_score"),
              "awkward_language": ("awkward_language", "awkward_language_score")}
    got = {r.topic: (r.rule_flags, r.judge_flags, r.both_flags) for r in agreement.gap_analysis(judge, labels, topics).collect()}
    assert got == {"hallucination": (2, 2, 1), "awkward_language": (1, 1, 1)}  # rows without a label do not count
    assert agreement.gap_analysis(judge.where("false"), labels, topics).count() == 0


def test_last_label_wins_and_unlabelled_pairs_drop(spark):
    from assaykit.operators.hotkeys import last_per_key

    rows = [("a", 1, 0.1), ("a", 3, 0.3), ("a", 2, 0.2), ("b", 1, 0.5)]
    got = last_per_key(spark.createDataFrame(rows, "pair_id string, pos int, v double"), ["pair_id"], "pos")
    assert {(r.pair_id, r.v) for r in got.collect()} == {("a", 0.3), ("b", 0.5)}


def test_cube_gives_what_the_rows_give(spark):
    draw = random.Random(3)
    flags = ["f", "g", "h"]
    rows = [(draw.choice(["a", "b", None]), *[int(draw.random() < 0.3) for _ in flags]) for _ in range(500)]
    df = failures.with_totals(spark.createDataFrame(rows, "category string, f int, g int, h int"), flags)
    cube = failures.failure_cube(df, ["category"], flags, calls=F.lit(2))
    assert cube.count() <= 3 * 8 and cube.agg(F.sum("n"), F.sum("calls")).first()[:] == (500, 1000)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(failures.rates_by(df, ["category"], flags), failures.rates_by(cube, ["category"], flags, weight="n"))
    assert same(failures.cooccurrence(df, flags), failures.cooccurrence(cube, flags, weight="n"))
    assert same(failures.flag_correlation(df, flags), failures.flag_correlation(cube, flags, weight="n"))
    assert failures.category_entropy(df).first()[0] == pytest.approx(failures.category_entropy(cube, weight="n").first()[0])
    after = (F.col("g") == 0) & (F.col("category") == "a")
    part = df.where(after)
    assert same(failures.compare_modes(df, part, flags), failures.compare_modes_in_one(df, flags, F.lit(True), after))
    assert same(failures.compare_modes(df, part, flags), failures.compare_modes_in_one(cube, flags, F.lit(True), after, weight="n"))
    one = failures.compare_verdict_in_one(df, F.lit(True), after)
    assert same(failures.compare_verdict(df, part).select(one.columns), one)
    none = failures.compare_verdict_in_one(df, F.lit(True), F.lit(False))
    assert none.count() == 0 and failures.failure_cube(df.where("false"), ["category"], flags).count() == 0


def test_run_summary_scans_twice(spark):
    rows = [(f"t{i}", "c", True, 1, int(i % 2)) for i in range(4)] + [("u", "d", False, None, None)]
    df = spark.createDataFrame(rows, "trace_id string, category string, passed_validation boolean, f int, g int")
    got = {(r.section, r.name): r.value for r in failures.run_summary(df, ["f", "g"], "t", 2).collect()}
    assert got["totals", "total_generated"] == 5 and got["totals", "judged"] == got["totals", "passed_validation"] == 4
    assert got["per_mode_rates", "g"] == 0.5 and got["category_counts", "c"] == 4 and ("category_counts", "d") not in got
    assert got["worst_items", "t1"] == got["worst_items", "t3"] == 2 and got["overall", "overall_failure_rate"] == 1
    empty = {(r.section, r.name): r.value for r in failures.run_summary(df.where("f IS NULL"), ["f", "g"], "t").collect()}
    assert empty == {("totals", "total_generated"): 1, ("totals", "passed_validation"): 0, ("totals", "judged"): 0, ("error", "No judged records"): 0}
