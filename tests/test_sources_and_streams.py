import copy
import json
from datetime import datetime

import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

from assaykit import session
from assaykit.operators import validation
from assaykit.operators.hooks import embed, hashed_terms
from assaykit.schemas import PAIR, QA_RECORD
from assaykit.sources import cache, pages, records, truth
from assaykit.streaming import review


def test_read_records(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"a": 1, "s": "x"}\n\n{"a": 2}\n')
    rows = records.read_records(spark, str(path), "a int, s string").collect()
    assert [(r.a, r.s) for r in rows] == [(1, "x"), (2, None)]
    with pytest.raises(Exception):
        records.read_records(spark, str(path), "a int, s string", required=["s"]).collect()
    path.write_text('{"a": "no number"}\n{"a": 3}\n')
    with pytest.raises(Exception):
        records.read_records(spark, str(path), "a int").collect()
    good, bad = records.read_with_quarantine(spark, str(path), "a int")
    assert [r.a for r in good.collect()] == [3] and bad.count() == 1
    assert records.read_records(spark, str(tmp_path / "none"), "a int", missing_ok=True).count() == 0
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "none"), "a int")


def test_write_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    records.write_records(spark.createDataFrame([(1, None)], "a int, s string"), path)
    assert json.loads(spark.read.text(path).first().value) == {"a": 1, "s": None}


def test_stages(spark, tmp_path):
    stages = records.Stages(spark, str(tmp_path))
    stages.save("valid", spark.range(3))
    assert stages.load("valid").count() == 3 and stages.load("judge", "id long").count() == 0
    with pytest.raises(ValueError):
        stages.path("other")


def test_items(spark):
    good = ("q", "a", "e", ["t"], ["1", "2", "3"], "s", ["x"])
    cases = {
        "good": (good, []), "steps": (("q", "a", "e", ["t"], ["1", "2"], "s", ["x"]), ["steps"]),
        "blank": (("q", "a", "e", [" "], ["1", "2", "\t"], "s", ["x", ""]), ["tools_required", "steps", "tips"]),
        "empty": (("", "a", "e", [], ["1", "2", "3"], "", []), ["question", "tools_required", "safety_info", "tips"]),
        "none": (None, ["Generation produced no item"]),
    }
    item = QA_RECORD[QA_RECORD.index("item ") + 5 : QA_RECORD.index(", metadata ")]
    df = spark.createDataFrame([(k, v[0], "hvac", []) for k, v in cases.items()],
                               f"trace_id string, item {item}, category string, generation_errors array<string>")
    checked = validation.validate_items(df)
    rows = {r.trace_id: r for r in checked.collect()}
    for name, (_, fields) in cases.items():
        assert [e.split(":")[0] for e in rows[name].metadata.validation_errors] == fields
        assert rows[name].metadata.passed_validation == (not fields) and (rows[name].item is None) == bool(fields)
    assert validation.pass_rate(checked).first().pass_rate == pytest.approx(0.2)
    assert validation.pass_rate(checked.where("false")).first().pass_rate == 0.0


def test_page_offsets_and_text(spark):
    rows = [(d, p, "x" * (d + p)) for d in (1, 2) for p in range(9)]
    df = spark.createDataFrame(rows, "document_id int, page_number int, text string")
    whole = {d: "\n".join(t for i, _, t in rows if i == d) for d in (1, 2)}
    for r in pages.page_offsets(df).join(df, ["document_id", "page_number"]).collect():
        assert whole[r.document_id][r.start_char : r.end_char] == r.text
    one = {r.document_id: r.text for r in pages.full_text(df).collect()}
    assert one == whole


def test_full_text_of_a_large_document(spark, monkeypatch):
    df = spark.createDataFrame([(1, p, str(p % 10) * 1_000_000) for p in range(24)], "document_id int, page_number int, text string")
    assert pages.full_text(df).first().text == "\n".join(str(p % 10) * 1_000_000 for p in range(24))
    monkeypatch.setattr(pages, "MAX_CHARS", 1000)
    with pytest.raises(Exception, match="more than 1000 characters"):
        pages.full_text(df).collect()


def test_qrels(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "d1", 3), ("q1", "d2", 0), ("q2", "d1", 1)], "query_id string, document_id string, section_index int")
    path = str(tmp_path / "qrels")
    truth.pack_qrels(rows).write.text(path)
    assert {tuple(r) for r in truth.load_qrels(spark, path).collect()} == {tuple(r) for r in rows.collect()}


@pytest.mark.parametrize("pieces", [1, 16])
def test_qrels_of_a_query_are_many_objects(spark, tmp_path, pieces):
    rows = spark.createDataFrame([("q1", f"d{i}", i) for i in range(200)], "query_id string, document_id string, section_index int")
    packed = truth.pack_qrels(rows, pieces)
    assert packed.count() == pieces
    packed.write.text(str(tmp_path / "q"))
    assert truth.load_qrels(spark, str(tmp_path / "q")).count() == 200


def test_ground_truth_loaders(spark, tmp_path):
    """One large object over several lines, objects by line, irregular values."""
    queries = {"q1": "plain text", "q2": {"query": "asked", "type": "t", "more": [1]}, "q3": {"question": "and", "source": "s"}, "q4": None, "q5": {}}
    (tmp_path / "one.json").write_text(json.dumps(queries, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({k: v}) for k, v in queries.items()) + "\n\n")
    want = [("q1", "plain text", None, None), ("q2", "asked", "t", None), ("q3", "and", None, "s"), ("q4", None, None, None), ("q5", None, None, None)]
    for name in ("one.json", "lines.json"):
        assert sorted(map(tuple, truth.load_queries(spark, str(tmp_path / name)).collect())) == want
    (tmp_path / "answers.json").write_text(json.dumps({"q1": "a", "q2": ["b", None, "c"], "q3": {"answer": "d"}, "q4": None, "q5": []}))
    got = truth.load_answers(spark, str(tmp_path / "answers.json")).collect()
    assert sorted(map(str, got)) == sorted(f"Row(query_id={q!r}, answer={a!r})" for q, a in [
        ("q1", "a"), ("q2", "b"), ("q2", None), ("q2", "c"), ("q3", "d"), ("q4", None)])
    papers = [{"id": "p1", "sections": [{"text": "one", "title": "T"}, {"content": "three"}, {}]}, {"paper_id": "p2", "sections": ["x", "yy"]}, {"id": "p3"}]
    (tmp_path / "corpus").mkdir()
    for p in papers:
        (tmp_path / "corpus" / f"{p.get('id', 'p2')}.json").write_text(json.dumps(p))
    got = sorted(map(tuple, truth.load_sections(spark, str(tmp_path / "corpus")).collect()))
    assert got == [("p1", 0, "T", "one", 0, 3), ("p1", 1, None, "three", 5, 10), ("p1", 2, None, "", 12, 12), ("p2", 0, None, "x", 0, 1), ("p2", 1, None, "yy", 3, 5)]
    (tmp_path / "bad.json").write_text('{"q": 1}\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED|parse"):
        truth.load_queries(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "none.json").write_text("")
    assert truth.load_queries(spark, str(tmp_path / "none.json")).count() == 0


def counting_embedder(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(texts):
        seen.add(len(texts))
        return hashed_terms(8)(texts)

    return seen, lambda c: embed(c, counting)


def test_embedding_cache_embeds_once(spark, tmp_path):
    seen, embedder = counting_embedder(spark)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "id int, text string")
    run = lambda part: cache.cached_embeddings(spark, part, str(tmp_path / "c"), "k", "m", embedder, buckets=4).count()
    assert run(df.where("id < 4")) == 4 and run(df) == 6 and run(df) == 6
    assert seen.value == 6
    other = cache.EmbeddingCache(spark, str(tmp_path / "c"), "k", "other model", "id", "int", 4)
    assert other.lookup(df).count() == 0 and other.missing(df).count() == 6


def keys_stored(held):
    return sorted(r[0] for part in held.stored() for r in part.select("id").collect())


def test_embedding_cache_holds_each_key_once(spark, tmp_path):
    """Keys that repeat, runs that overlap, two runs at once, and the merge of many folders."""
    seen, embedder = counting_embedder(spark)
    held = lambda: cache.EmbeddingCache(spark, str(tmp_path), "k", "m", "id", "string", 4)
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "id string, text string")
    held().add(rows("a", "a", "b", None), embedder)
    assert keys_stored(held()) == ["a", "b"] and held().lookup(rows("a", "a", "b", "z")).count() == 3
    slow = held()
    commit, raced = slow.manifest.commit, []

    def late(version, folders):
        if not raced:  # another run stores c and d between this run's look and its commit
            raced.append(1)
            held().add(rows("c", "d"), embedder)
        return commit(version, folders)

    slow.manifest.commit = late
    slow.add(rows("b", "c", "e"), embedder)
    assert keys_stored(held()) == ["a", "b", "c", "d", "e"] and len(held().manifest.latest()[1]) == 3
    slow.add(rows("a", "b", "c"), embedder)
    assert keys_stored(held()) == ["a", "b", "c", "d", "e"]
    for i in range(8):
        held().add(rows(f"n{i}"), embedder)
    assert len(keys_stored(held())) == 13 and len(held().manifest.latest()[1]) < cache.COMPACT_AT
    # a version whose writer died before its end is passed over
    version, folders = held().manifest.latest()
    (next(p for p in tmp_path.iterdir()) / "manifest" / f"{version + 1:010d}").write_text("half a na")
    assert held().manifest.latest() == (version, folders)


def test_embedding_cache_is_joined_without_a_shuffle_of_it(spark, tmp_path):
    seen, embedder = counting_embedder(spark)
    held = cache.EmbeddingCache(spark, str(tmp_path), "k", "m", "id", "string", 4)
    df = spark.createDataFrame([(f"{i}", f"text {i}") for i in range(50)], "id string, text string")
    held.add(df.limit(30), embedder)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        missing = held.missing(df)
        assert missing.count() == 20
        plan = missing._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_stream_equals_batch(spark, pair, tmp_path):
    lines = []
    for i in range(6):
        pair["metadata"]["pair_id"] = f"p{i}"
        pair["resume"]["contact"]["phone"] = "123" if i % 2 else "415-555-1234"
        lines.append(json.dumps(pair))
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines[n * 2 : n * 2 + 2]))
    stream = review.review(review.read_pair_stream(spark, str(tmp_path / "in"), files_per_trigger=1), AS_OF)
    got = review.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    want = review.review(spark.read.schema(PAIR).json(str(tmp_path / "in")), AS_OF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.pair_id: r.validation_error_count for r in got.collect()} == {f"p{i}": i % 2 for i in range(6)}


def test_late_rows_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "ts timestamp, bad int"
    batches = [["2024-01-01T00:10:00", "2024-01-01T02:30:00"], ["2024-01-01T02:40:00"],
               ["2024-01-01T00:20:00", "2024-01-01T05:00:00"]]
    for n, times in enumerate(batches):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"ts": t, "bad": 1}) for t in times))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rates = review.window_rates(stream, "ts", ["bad"], window="1 hour", delay="10 minutes")
    got = review.run_to_files(rates, str(tmp_path / "out"), str(tmp_path / "state")).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n) for r in got] == [(0, 1), (2, 2)]  # 00:20 came after its hour had closed


def test_default_metadata(spark, pair):
    row = review.with_default_metadata(spark.createDataFrame([pair], PAIR).drop("metadata"), "2026-01-01").first()
    assert (row.metadata.fit_level, row.metadata.writing_style) == ("Partial", "formal")


def test_latest_report(spark, tmp_path):
    with pytest.raises(LookupError):
        review.latest_rates(None)
    with pytest.raises(LookupError):
        review.latest_rates(str(tmp_path / "none"), spark)
    rows = [("totals", "n", 3.0), ("overall", "overall_failure_rate", 0.5), ("failure_rates", "x", 0.25)]
    spark.createDataFrame(rows, "section string, name string, value double").write.parquet(str(tmp_path / "report"))
    assert sorted(r.value for r in review.latest_rates(str(tmp_path / "report"), spark).collect()) == [0.25, 0.5]


def test_latest_rates_merge_each_batch_once(spark, tmp_path):
    latest = review.LatestRates(spark, str(tmp_path / "latest"), keep=3)
    with pytest.raises(LookupError):
        latest.read()
    row = lambda hour, n: (datetime(2024, 1, 1, hour), datetime(2024, 1, 1, hour + 1), n, 0.5)
    batch = lambda *rows: spark.createDataFrame(rows, "window_start timestamp, window_end timestamp, n long, rate_bad double")
    seen = lambda: sorted((r.window_start.hour, r.n) for r in latest.read().collect())
    latest.merge(batch(row(1, 10), row(2, 20)), 0)
    assert seen() == [(1, 10), (2, 20)]
    latest.merge(batch(row(2, 25), row(3, 30)), 1)
    assert seen() == [(1, 10), (2, 25), (3, 30)]
    latest.merge(batch(row(9, 99)), 1)  # a repeated batch changes nothing
    latest.merge(batch(row(9, 99)), 0)
    assert seen() == [(1, 10), (2, 25), (3, 30)]
    (tmp_path / "latest" / "batch-2").mkdir()  # a batch that was broken off is no version, and is written again
    assert seen() == [(1, 10), (2, 25), (3, 30)]
    latest.merge(batch(row(4, 40)), 2)
    assert seen() == [(2, 25), (3, 30), (4, 40)]
    latest.merge(batch(), 3)
    assert seen() == [(2, 25), (3, 30), (4, 40)] and len(list((tmp_path / "latest").glob("batch-*"))) == 2


def test_live_rates_from_a_stream(spark, tmp_path):
    """Closed windows reach the table, late rows are counted, and a stream that goes on adds to it."""
    (tmp_path / "in").mkdir()
    batches = [["2024-01-01T00:10:00", "2024-01-01T02:30:00"], ["2024-01-01T02:40:00"], ["2024-01-01T00:20:00", "2024-01-01T05:00:00"]]
    write = lambda n, times: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"ts": t, "bad": 1}) for t in times))
    for n, times in enumerate(batches):
        write(n, times)
    stream = spark.readStream.schema("ts timestamp, bad int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rates = review.window_rates(stream, "ts", ["bad"], window="1 hour", delay="10 minutes")
    latest = review.LatestRates(spark, str(tmp_path / "latest"))
    query = latest.run(rates, str(tmp_path / "state"))
    query.awaitTermination()
    assert sorted((r.window_start.hour, r.n) for r in latest.read().collect()) == [(0, 1), (2, 2)] and review.late_rows(query) == 1
    write(3, ["2024-01-01T09:00:00"])
    latest.run(rates, str(tmp_path / "state")).awaitTermination()
    assert sorted((r.window_start.hour, r.n) for r in latest.read().collect()) == [(0, 1), (2, 2), (5, 1)]


def test_review_with_a_judge(spark, pair):
    def judge(prompts, attempt):
        scores = {"hallucination_score": 1, "awkward_language_score": 2, "quality_score": 7, "fit_assessment": prompts[0][:20], "recommendations": []}
        bad = {**scores, "quality_score": 11}
        return [json.dumps(scores) if "Senior Python" in p else json.dumps(bad) if "Chef" in p else "no json" for p in prompts]

    other, odd = copy.deepcopy(pair), copy.deepcopy(pair)
    other["job"]["title"], odd["job"]["title"] = "Chef de cuisine", "Clerk"
    df = spark.createDataFrame([pair, other, odd], PAIR)
    rows = review.review(df, AS_OF, judge, "Job: {title} of {years} years").collect()
    assert [r.judge and r.judge.quality_score for r in rows] == [7, None, None] and rows[0].judge.fit_assessment.startswith("Job: Senior")
    assert "judge" not in review.review(df, AS_OF).columns


def test_summary_document(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "z", 3.0)], "section string, name string, value double")
    doc = json.loads(records.summary_document(rows).select(F.col("document")).first().document)
    assert {k: json.loads(v) for k, v in doc.items()} == {"a": {"x": 1.0, "y": 2.0}, "b": {"z": 3.0}}


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_arriving_pairs_are_compressed_records(spark, tmp_path):
    from assaykit.sources import records

    df = spark.createDataFrame([(i, None, "text") for i in range(10)], "a int, b string, c string")
    records.write_records(df, f"{tmp_path}/r", compression="gzip")
    assert list((tmp_path / "r").glob("*.json.gz"))
    assert sorted(records.read_records(spark, f"{tmp_path}/r", "a int, b string, c string").collect()) == sorted(df.collect())
