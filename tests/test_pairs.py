import copy

import pytest
from conftest import AS_OF, base_pair
from pyspark.sql import functions as F

from assaykit.operators import agreement, labels, repair, validation
from assaykit.schemas import PAIR

def table(spark, pairs):
    return spark.createDataFrame(pairs, PAIR)


def job(start, end="Present", title="Software Engineer"):
    return {"company": "C", "title": title, "start_date": start, "end_date": end, "responsibilities": ["x"], "achievements": []}


def skills(names, level="Advanced", years=None):
    return [{"name": n, "proficiency_level": level, "years_used": years} for n in names]


CHANGES = {
    "none": (lambda p: None, set()),
    "few_months": (lambda p: p["resume"].update(experience=[job("2023-01", "2023-06")]), {"experience_mismatch"}),
    "junior_titles": (lambda p: [e.update(title="Junior Developer") for e in p["resume"]["experience"]], {"seniority_mismatch"}),
    "inflated_title": (lambda p: p["resume"].update(experience=[job("2025-07", title="Senior Engineer")]), {"seniority_mismatch"}),
    "haskell": (lambda p: p["resume"].update(skills=skills(["Haskell"])), {"missing_core_skills"}),
    "many_skills": (lambda p: p["resume"].update(skills=skills([f"s{i}" for i in range(21)])), {"hallucinated_skills"}),
    "expert_density": (lambda p: p["resume"].update(
        experience=[job("2023-01")], skills=skills([f"s{i}" for i in range(13)], "Expert")), {"hallucinated_skills"}),
    "claimed_years": (lambda p: p["resume"].update(
        experience=[job("2024-01")], skills=skills(["a", "b", "c"], years=5.0)), {"hallucinated_skills"}),
    "one_long_skill": (lambda p: p["resume"].update(
        experience=[job("2023-01")], skills=skills(["a"], years=5.0)), {"hallucinated_skills"}),
    "early_experts": (lambda p: p["resume"].update(
        experience=[job("2023-09", "2024-01")], skills=skills([f"s{i}" for i in range(12)], "Expert")), {"hallucinated_skills"}),
    "buzzwords": (lambda p: p["resume"].update(
        summary="Results-driven thought leader with a proven track record, cutting-edge self-starter"), {"awkward_language"}),
}


@pytest.fixture(scope="module")
def labelled(spark):
    base = base_pair()
    rows = []
    for name, (change, _) in CHANGES.items():
        p = copy.deepcopy(base)
        change(p)
        p["metadata"]["pair_id"] = name
        rows.append(p)
    return {r.pair_id: r for r in labels.label_pairs(table(spark, rows), AS_OF).collect()}


@pytest.mark.parametrize("name", list(CHANGES))
def test_labels(labelled, name):
    want = CHANGES[name][1]
    row = labelled[name].asDict()
    if name == "none":
        assert row["skills_overlap"] == 1.0
        assert not any(v for k, v in row.items() if k not in ("pair_id", "skills_overlap"))
    for flag in want:
        assert row[flag] is True


def test_no_required_years_never_mismatches(spark, pair):
    pair["resume"]["experience"] = []
    pair["job"]["requirements"]["experience_years"] = 0
    row = labels.label_pairs(table(spark, [pair]), AS_OF).first()
    assert row.experience_mismatch is False


def test_valid_pair(spark, pair):
    row = validation.validate_pairs(table(spark, [pair]), AS_OF).first()
    assert row.is_valid and row.error_count == 0


def test_pair_errors_in_order(spark, pair):
    r = pair["resume"]
    r["experience"] = [job("2099-01"), job("soon"), job("1960-01")]
    r["education"][0]["graduation_date"] = "2099-05"
    r["skills"].append({"name": " \t", "proficiency_level": "Expert", "years_used": None})
    r["contact"]["phone"] = "123"
    pair["job"]["requirements"]["required_skills"] = []
    errors = validation.validate_pairs(table(spark, [pair]), AS_OF).first().errors
    assert [(e.field_path, e.category) for e in errors] == [
        ("resume.experience[0].start_date", "logical_inconsistency"),
        ("resume.experience[1].start_date", "format_violation"),
        ("resume.education[0].graduation_date", "logical_inconsistency"),
        ("resume.skills[5].name", "missing_field"),
        ("resume.experience", "logical_inconsistency"),
        ("job.requirements.required_skills", "missing_field"),
        ("resume.contact.phone", "format_violation"),
    ]
    assert errors[4].invalid_value == "66.2" and errors[6].expected_format == "at least 10 digits"


SCHEMA_CASES = {
    "resume.contact.phone": lambda r: r["contact"].update(phone="123"),
    "resume.contact.email": lambda r: r["contact"].update(email="nobody"),
    "resume.education[0].graduation_date": lambda r: r["education"][0].update(graduation_date="01/2020"),
    "resume.education[0].gpa": lambda r: r["education"][0].update(gpa=5.0),
    "resume.experience[0].end_date": lambda r: r["experience"][0].update(start_date="2022-06", end_date="2021-01"),
    "resume.education": lambda r: r.update(education=[]),
    "resume.summary": lambda r: r.update(summary="Short"),
    "resume.skills": lambda r: r.update(skills=[]),
    "resume.skills[0].proficiency_level": lambda r: r["skills"][0].update(proficiency_level="Guru"),
    "resume.experience[1].responsibilities": lambda r: r["experience"][1].update(responsibilities=[]),
}


def test_schema_rejections(spark, pair):
    rows = []
    for name, change in SCHEMA_CASES.items():
        p = copy.deepcopy(pair)
        change(p["resume"])
        p["metadata"]["pair_id"] = name
        rows.append(p)
    got = table(spark, rows).select("metadata.pair_id", validation.resume_schema_errors().alias("e")).collect()
    assert {r.pair_id: [e.field_path for e in r.e] for r in got} == {n: [n] for n in SCHEMA_CASES}


def test_schema_accepts(spark, pair):
    ok = []
    for change in (
        lambda r: r["contact"].update(phone="(415) 555-1234"),
        lambda r: r["education"][0].update(graduation_date="2020-05", gpa=None),
        lambda r: r["experience"][0].update(end_date="PRESENT"),
        lambda r: r["experience"][0].update(start_date="2022-06", end_date="2021-01-05"),  # mixed formats are not compared
        lambda r: r["experience"][0].update(start_date="2021-06", end_date="2021-06"),
    ):
        p = copy.deepcopy(pair)
        change(p["resume"])
        ok.append(p)
    df = table(spark, ok).select(F.size(validation.resume_schema_errors()).alias("n"), F.size(validation.job_schema_errors()).alias("j"))
    assert [(r.n, r.j) for r in df.collect()] == [(0, 0)] * len(ok)


def test_repair_loop_states(spark, pair):
    rows = []
    for name, change in {
        "ok": lambda r: None,
        "phone": lambda r: r["contact"].update(phone="123"),
        "future": lambda r: r["experience"].append(job("2099-01")),
        "blank": lambda r: r["skills"].append({"name": " ", "proficiency_level": "Expert", "years_used": None}),
        "stuck": lambda r: r["experience"].append(job("soon")),
    }.items():
        p = copy.deepcopy(pair)
        change(p["resume"])
        p["metadata"]["pair_id"] = name
        rows.append(p)
    check = lambda df: validation.validate_pairs(df, AS_OF)
    out = repair.repair_loop(check(table(spark, rows)), lambda df, n: repair.deterministic_fix(df, n, AS_OF), check)
    got = {r.metadata.pair_id: (r.attempts, r.is_valid) for r in out.collect()}
    assert got == {"ok": (0, True), "phone": (1, True), "future": (2, True), "blank": (3, True), "stuck": (3, False)}
    stats = {r.name: r.value for r in repair.repair_stats(out).collect()}
    assert stats == {"total_pairs": 4, "corrected": 3, "permanently_failed": 1, "correction_rate": 0.75, "attempts_1": 1,
                     "attempts_2": 1, "attempts_3": 2}
    assert [r.reason for r in repair.failure_reasons(out).collect()] == [
        "resume.experience[2].start_date: start_date could not be parsed"]


def test_failing_repair_keeps_state_and_uses_attempts(spark, pair):
    pair["resume"]["contact"]["phone"] = "123"
    check = lambda df: validation.validate_pairs(df, AS_OF)
    calls = []

    def broken(df, attempt):
        calls.append(attempt)
        return df

    row = repair.repair_loop(check(table(spark, [pair])), broken, check).first()
    assert (row.attempts, row.is_valid, row.resume.contact.phone) == (3, False, "123") and calls == [1, 2, 3]


def test_empty_repair_rate_is_zero(spark, pair):
    check = lambda df: validation.validate_pairs(df, AS_OF)
    out = repair.repair_loop(check(table(spark, [pair])), lambda df, n: df, check)
    stats = {r.name: r.value for r in repair.repair_stats(out).collect()}
    assert stats["correction_rate"] == 0.0 and stats["total_pairs"] == 0


def test_loop_protects_the_job_and_stamps(spark, pair):
    pair["resume"]["contact"]["phone"] = "123"
    check = lambda df: validation.validate_pairs(df, AS_OF)

    def careless(df, attempt):
        resume = F.col("resume").withField("contact.phone", F.lit("4155551234"))
        job = F.col("job").withField("title", F.lit("another post"))
        return df.withColumn("resume", resume.withField("metadata.fit_level", F.lit("Poor"))).withColumn("job", job)

    row = repair.repair_loop(check(table(spark, [pair])), careless, check).first()
    assert row.is_valid and row.attempts == 1 and row.metadata.correction_attempts == 1
    assert row.job.title == pair["job"]["title"] and row.resume.metadata.fit_level == "Excellent"
    assert row.resume.metadata.trace_id != pair["resume"]["metadata"]["trace_id"]


def test_given_up_pairs_count_as_failed(spark, pair):
    other = copy.deepcopy(pair)
    other["resume"]["contact"]["phone"] = "123"
    other["metadata"]["pair_id"] = "lost"
    check = lambda df: validation.validate_pairs(df, AS_OF)
    out = repair.repair_loop(check(table(spark, [pair])), lambda df, n: df, check)
    lost = table(spark, [other])
    stats = {r.name: r.value for r in repair.repair_stats(out, lost).collect()}
    assert stats == {"total_pairs": 1, "corrected": 0, "permanently_failed": 1, "correction_rate": 0}
    corrected, failed = repair.corrected_and_failed(out, lost)
    assert corrected.count() == 0 and [r.metadata.pair_id for r in failed.collect()] == ["lost"]


def test_report_population_and_gap(spark, pair):
    """Valid and corrected pairs are labelled, corrected ones as repaired; others only count as invalid."""
    future, phone, stuck = copy.deepcopy(pair), copy.deepcopy(pair), copy.deepcopy(pair)
    for name, p in (("pair-2", future), ("pair-3", phone), ("pair-4", stuck)):
        p["metadata"]["pair_id"] = name
    buzz = ["Leverage synergy, a paradigm shift and a deep dive"]
    future["resume"]["experience"].append({"company": "X", "title": "Chief", "start_date": "2099-01", "end_date": "Present",
                                           "responsibilities": ["r"], "achievements": buzz})
    phone["resume"]["contact"]["phone"] = "123"
    phone["resume"]["experience"][0]["achievements"] = buzz
    stuck["resume"]["experience"][0]["start_date"] = "some day"
    run = agreement.labelled_run(table(spark, [pair, future, phone, stuck]), AS_OF, lambda df, n: repair.deterministic_fix(df, n, AS_OF))
    flat = {r.pair_id: r for r in run.flat.collect()}
    assert set(flat) == {"pair-001", "pair-2", "pair-3"}
    assert not flat["pair-2"].awkward_language and flat["pair-3"].awkward_language  # the future entry is gone
    judge = spark.createDataFrame([("pair-001", 4, 5, 1), ("pair-3", 8, 0, 4), ("pair-4", 10, 5, 5)],
                                  "pair_id string, quality_score int, hallucination_score int, awkward_language_score int")
    report = agreement.quality_report(run, judge)
    got = {(r.section, r.name): r.value for r in report.collect()}
    assert [got["totals", x] for x in ("pairs_generated", "valid_pairs", "invalid_pairs")] == [4, 3, 3]
    assert got["correction", "corrected"] == 2 and got["correction", "correction_rate"] == 0.667
    assert got["llm_judge", "total_judged"] == 2 and got["llm_judge", "avg_quality_score"] == 6
    assert [got["gap_awkward_language", x] for x in ("rule_based_flags", "judge_flags", "both_agree")] == [1, 1, 1]
    assert got["gap_hallucination", "judge_flags"] == 1 and got["failure_rates", "awkward_language"] == 0.333
    assert got["niche_vs_standard", "standard/awkward_language"] == pytest.approx(1 / 3)
    # the report reads what the run has stored, never the pairs again
    plan = agreement.quality_report(run)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan and "Relation" in plan
    none = agreement.labelled_run(table(spark, [pair]).where("false"), AS_OF, lambda df, n: df)
    assert agreement.quality_report(none).collect() == []
    assert [r.value for r in agreement.quality_report(run).where("section = 'llm_judge'").collect()] == []


def test_pairs_join_flat_rows_and_nest_them_afterwards(spark, tmp_path):
    from assaykit.operators.generation import assemble_pairs
    from assaykit.plans.pair_view import CREATED, jobs, pairs, resumes

    spark.createDataFrame(
        [(i, i % 5 or None, "OFP"[i % 3], "1996-01-02", "3-MEDIUM") for i in range(1, 40)] + [(7, 2, "O", None, "2-HIGH")],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        [(1, "a", "BUILDING", 3), (2, "b", "MACHINERY", 0), (2, "c", None, 1), (None, "d", "BUILDING", 1), (41, "e", "BUILDING", 2)],
        "c_custkey bigint, c_name string, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = pairs(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "struct(contact" in above and "struct(" not in below
    whole = assemble_pairs(resumes(spark, str(tmp_path)), jobs(spark, str(tmp_path)), "job_key", CREATED)
    assert got.schema == whole.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() > 8
