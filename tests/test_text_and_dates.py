from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaykit.functions import dates, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def apply(spark, values, fn, kind="string"):
    return [r.o for r in column(spark, values, kind).select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_skill(spark):
    cases = {
        "Python 3": "python", "React.js": "react", "Node.js v18": "node", "  AWS S3  ": "aws s3", "PostgreSQL": "postgresql",
        "TypeScript": "typescript", "Go": "go", "x 3.js": "x 3", "Python 3 2": "python 3", " Vue.js\t": "vue",
        "foo .js": "foo", "C++ 17": "c++", "": "",
    }
    assert apply(spark, list(cases), text.normalize_skill) == list(cases.values())


def test_jaccard(spark):
    rows = [(["a", "b"], ["a", "b"], 1.0), (["a"], ["b"], 0.0), (["a", "b", "c"], ["a", "d", "c"], 0.5), ([], [], 0.0)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want double")
    for r in df.select(text.jaccard(F.col("a"), F.col("b")).alias("got"), "want").collect():
        assert r.got == r.want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcdef")), st.lists(st.sampled_from("abcdef"))), min_size=1, max_size=20))
def test_jaccard_is_symmetric_and_bounded(spark, rows):
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select(text.jaccard(F.col("a"), F.col("b")).alias("x"), text.jaccard(F.col("b"), F.col("a")).alias("y"),
                       "a", "b").collect():
        union = set(r.a) | set(r.b)
        assert r.x == r.y == (len(set(r.a) & set(r.b)) / len(union) if union else 0.0)


def test_skill_set(spark):
    assert apply(spark, [["Python 3", "python", "Python"]], text.skill_set, "array<string>") == [["python"]]


def test_phrase_count(spark):
    cases = {
        "Leveraged synergies; a proven track record": 3, "leverage leverage": 2, "paradigm shifts approaches": 0,
        "best-in-class, cutting edge, results–driven": 3, "synergyé": 0, "best\nin class": 0, "disrupt": 1,
    }
    assert apply(spark, list(cases), text.phrase_count) == list(cases.values())


@pytest.mark.parametrize("title,rank", [
    ("Junior Developer", 0), ("International Lead", 0), ("Associate Director", 1), ("Senior Engineer", 2), ("Lead Engineer", 3),
    ("Doctor", 4), ("Contractor", 4), ("VP of Data", 4), ("VP", None), ("Software Engineer", None)])
def test_title_rank(spark, title, rank):
    assert apply(spark, [title], text.title_rank) == [rank]


def test_parse_date(spark):
    cases = {
        "2021-06-30": date(2021, 6, 30), "2021-06": date(2021, 6, 1), "2021-6": date(2021, 6, 1), "2021-6-3": date(2021, 6, 3),
        "2021": None, "20211-01": None, "2021-13": None, "2021-02-30": None, "01/2020": None, "2021-06\n": None,
        "2021-06 ": None, "0000-01": None, "": None, "2021-06-30T00:00": None,
    }
    assert apply(spark, [*cases, None], dates.parse_date) == [*cases.values(), None]


def entry(start, end, title="x"):
    return (start, end, title)


def test_experience_years(spark):
    lists = [
        [entry("2018-06", "2021-06"), entry("2021-07", "Present")],
        [], [entry("2020-01-31", "2020-02-01")], [entry("bad", "2020-01")], [entry("2020-01", "bad")],
        [entry("2020-05", "2019-05")], [entry("2020-01", None), entry("2020-01", "")], [entry("2020-01", "2021-01")] * 2,
    ]
    got = apply(spark, lists, lambda c: dates.experience_years(c, F.lit("2026-03-11").cast("date")),
                "array<struct<start_date: string, end_date: string, title: string>>")
    assert got == pytest.approx([92 / 12, 0, 1 / 12, 0, 0, 0, 2 * 74 / 12, 2.0])


def test_latest_title_keeps_first_on_ties(spark):
    lists = [[entry("2020-01", None, "a"), entry("2020-01-01", None, "b")], [entry("x", None, "a")],
             [entry("2019-01", None, "old"), entry("2020-01", None, "new")]]
    fn = lambda c: dates.title_of(dates.career_spans(c, F.lit("2026-03-11").cast("date")))
    assert apply(spark, lists, fn, "array<struct<start_date: string, end_date: string, title: string>>") == ["a", None, "new"]


def test_years_rank(spark):
    assert apply(spark, [0.0, 1.99, 2.0, 5.0, 10.0, 15.0], dates.years_rank, "double") == [0, 0, 1, 2, 3, 4]
