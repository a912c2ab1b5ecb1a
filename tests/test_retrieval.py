import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaykit.operators import experiments, hooks, irmetrics, lexical, questions, retrieval, sections
from assaykit.operators.chunking import DEFAULT_CONFIGS
from assaykit.operators.hotkeys import heavy_keys, hot_join, running_total, sequential_ids, spread_join

RNG = random.Random(3)
VOCAB = ["the"] * 12 + [f"w{i}" for i in range(30)]
DOCS = [(i, " ".join(RNG.choices(VOCAB, k=RNG.randint(0, 40)))) for i in range(60)] + [(60, "the the"), (61, "the the")]
QUERIES = [(i, " ".join(RNG.choices(VOCAB, k=4))) for i in range(8)] + [(8, "nothing")]


def tables(spark):
    return (spark.createDataFrame(QUERIES, "query_id long, text string"), spark.createDataFrame(DOCS, "doc_id long, text string"))


def brute_bm25():
    toks = {i: re.findall(r"\w+", t.lower()) for i, t in DOCS}
    n, avg = len(DOCS), sum(map(len, toks.values())) / len(DOCS)
    out = {}
    for q, text in QUERIES:
        for d, words in toks.items():
            score = 0.0
            hit = False
            for term in set(re.findall(r"\w+", text.lower())):
                tf = words.count(term)
                if tf:
                    hit = True
                    df = sum(term in w for w in toks.values())
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
            if hit:
                out[q, d] = round(score, 6)
    return out


@pytest.mark.parametrize("fits", [True, False])
def test_bm25_equals_brute_force(spark, monkeypatch, fits):
    monkeypatch.setattr(retrieval, "fits_broadcast", lambda df, **k: fits)
    q, d = tables(spark)
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_scores(q, d).collect()}
    assert got == pytest.approx(brute_bm25(), abs=1e-6)
    assert got.keys() == brute_bm25().keys()


def test_topk_ties_by_id(spark):
    q, d = tables(spark)
    rows = retrieval.retrieve_bm25(q, d, 5).collect()
    for query in {r.query_id for r in rows}:
        mine = sorted((r for r in rows if r.query_id == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda r: (-r.score, r.doc_id))


def exchanges(df):
    """Shuffles of the plan (broadcasts of one aggregate row are none)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip(" :+-") for line in plan.splitlines() if re.search(r"\bExchange (hash|range|round|single)", line, re.I)]


def test_bm25_by_blocks_equals_all_scores(spark, monkeypatch):
    """Several segments, blocks and blocks of queries; null and empty texts, ties, text ids, a repeated query term."""
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 70)
    draw = random.Random(11)
    vocab = [f"w{min(draw.randrange(60), draw.randrange(60))}" for _ in range(400)]
    docs = [(f"d{i:03d}", " ".join(draw.choices(vocab, k=draw.randint(1, 50)))) for i in range(400)]
    docs += [(f"e{i}", "w1 w1 w2") for i in range(90)] + [("n", None), ("o", ""), (None, "w3 w3 w3 w3 w3")]
    queries = [(i, " ".join(draw.choices(vocab, k=draw.randint(1, 30)))) for i in range(25)] + [(99, "w1 w1"), (100, None), (101, "absent"), (102, "")]
    d = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, text string")
    index = lexical.build_index(d)
    assert index.count() >= 6 and index.agg(F.sum("n_docs")).first()[0] == len(docs)
    for k in (1, 7, 600):
        every = retrieval.ranked(retrieval.bm25_scores(q, d), k).collect()
        for words_of_queries in (10**6, 40):
            found = lexical.search_index(q, index, k, query_words=words_of_queries)
            got = retrieval.ranked(found, k)
            assert sorted(map(str, got.collect())) == sorted(map(str, every))
            assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= k * index.count()


def test_bm25_skips_blocks(spark):
    """Most blocks of a large segment are never scored, and the plan has no shuffle but that of the candidates."""
    draw = random.Random(5)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(3000)]
    rows = [[*draw.choices(common, k=30), *draw.choices(rare, k=6)] for _ in range(20_000)]
    found = lexical.segment_columns(pa.array(rows))
    numbers = {c: found[c].tobytes() for c in lexical.NUMBERS}
    segment = lexical.Segment(pa.array(range(len(rows))), found["terms"], numbers, 36.0, 1.5, 0.75)
    place = {t: i for i, t in enumerate(found["terms"].to_pylist())}
    n = len(rows)
    for _ in range(30):
        terms = np.array([place[t] for t in {*draw.choices(common, k=3), *draw.choices(rows[draw.randrange(n)][30:], k=2)}])
        weights = np.log(1 + (n - segment.dfs[terms] + 0.5) / (segment.dfs[terms] + 0.5))
        docs, scores = segment.best(terms, weights, 10, 6)
        every = np.zeros(n)
        for t, w in zip(terms, weights, strict=True):
            span = slice(segment.starts[segment.term_starts[t]], segment.starts[segment.term_starts[t + 1]])
            tf = segment.tf[span]
            every[segment.doc[span]] += w * tf * 2.5 / (tf + segment.rest[segment.doc[span]])
        want = sorted(range(n), key=lambda i: (-round(every[i], 6), i))[:10]
        assert docs.tolist() == want and scores == pytest.approx(every[want], abs=1e-6)
    skipped = 1 - segment.scored / segment.blocks
    print(f"skipped {skipped:.2f} of {segment.blocks} blocks")
    assert skipped > 0.6
    q, d = tables(spark)
    plan = exchanges(retrieval.retrieve_bm25(q, d, 5))
    assert len(plan) == 1 and "hashpartitioning(query_id" in plan[0]


def test_vector_search_of_many_queries(spark):
    """10,000 queries in blocks against brute force; the corpus is scanned in place and the kernel keeps to its memory."""
    rng = np.random.default_rng(9)
    c, q = rng.normal(size=(3000, 16)) * rng.exponential(size=(3000, 1)), rng.normal(size=(10_000, 16))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "doc_id long, embedding array<double>").repartition(4)
    odd = [(90_000, None), (90_001, [1.0]), (90_002, [None] * 16), (None, [1.0] * 16)]
    corpus = corpus.union(spark.createDataFrame(odd, "doc_id long, embedding array<double>"))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    found = retrieval.vector_scores(queries, corpus, 5, metric="ip", block_bytes=1 << 20)
    assert all("Round" in x for x in exchanges(found)) and "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = retrieval.ranked(found, 5).toPandas().sort_values(["query_id", "rank"])
    scores = np.round(q @ c.T, 6)
    want = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert (got.doc_id.to_numpy().reshape(-1, 5) == want).all()
    assert np.abs(got.score.to_numpy().reshape(-1, 5) - np.take_along_axis(scores, want, 1)).max() < 2e-6


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_vector_kernel_memory_and_skips(metric):
    rng = np.random.default_rng(2)
    queries = rng.normal(size=(10_000, 64))
    batches = [rng.normal(size=(8192, 64)) * rng.exponential(size=(8192, 1)) ** 2 for _ in range(3)]
    tracemalloc.start()
    best = retrieval.RunningBest(queries, 10, metric, 6, np.dtype(np.int64))
    for i, matrix in enumerate(batches):
        best.add(np.arange(len(matrix)) + i * 8192, matrix)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20, peak
    if metric == "ip":  # short vectors cannot reach the lists of long ones
        assert best.skipped > best.tiles / 3


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
@pytest.mark.parametrize("block", [1 << 20, 300])
def test_vector_search_equals_brute_force(spark, metric, block):
    rng = np.random.default_rng(5)
    c, q = rng.integers(-2, 3, (50, 6)).astype(float), rng.integers(-2, 3, (7, 6)).astype(float)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    scores = retrieval.vector_scores(queries, corpus, 5, metric=metric, block_bytes=block)
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in retrieval.ranked(scores, 5).collect())
    want = []
    for i in range(7):
        s = c @ q[i]
        if metric == "cosine":
            length = np.linalg.norm(c, axis=1) * np.linalg.norm(q[i])
            s = np.divide(s, length, out=np.zeros_like(s), where=length > 0)
        if metric == "l2":
            s = -np.linalg.norm(c - q[i], axis=1)
        best = sorted(range(50), key=lambda j: (-round(s[j], 6), j))[:5]
        want += [(i, n + 1, j, pytest.approx(s[j], abs=1e-6)) for n, j in enumerate(best)]
    assert got == want


def test_fuse(spark):
    schema = "query_id long, doc_id long, score double"
    lex = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 3.0)], schema)
    vec = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.1)], schema)
    got = {(r.query_id, r.doc_id): (r["rank"], r.score) for r in retrieval.fuse(lex, vec, 10, 0.3).collect()}
    assert got == {(1, 1): (1, 0.7), (1, 2): (2, 0.3), (1, 3): (3, 0.0), (2, 1): (1, 0.7)}


@pytest.mark.parametrize("item_words", [1000, 4])
def test_contains_text(spark, item_words):
    docs = [(1, "A long road, that winds on and on past Hills."), (2, "long road"), (3, "x"), (4, None), (5, "along road that")]
    items = [(1, "long ROAD that winds on, and on past"), (2, "long road"), (3, "x"), (4, "hills"), (5, ""), (6, "road that winds on and ON to")]
    got = retrieval.contains_text(
        spark.createDataFrame(items, "query_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"), anchor=4, item_words=item_words)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (2, 2), (3, 3), (4, 1)}


def test_contains_text_equals_brute_force(spark):
    draw = random.Random(6)
    docs = [(i, " ".join(draw.choices(["a", "b", "c", "Dd"], k=draw.randint(0, 40)))) for i in range(120)] + [(500, None)]
    items = [(i, " ".join(draw.choices(["a", "b", "c", "dd", "zz"], k=draw.randint(0, 9)))) for i in range(150)] + [(900, None)]
    got = retrieval.contains_text(spark.createDataFrame(items, "query_id int, text string"),
                                  spark.createDataFrame(docs, "doc_id int, text string").repartition(3), anchor=3)
    line = lambda t: f" {(t or '').lower()} "
    want = {(i, d) for i, a in items for d, b in docs if (a or "").strip() and line(a) in line(b)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 300
    # one scan of the documents and no shuffle: what is found is verified where it is read
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert exchanges(got) == [r for r in exchanges(got) if "round" in r.lower()] and "Join" not in plan


def test_known_metrics(spark):
    found = spark.createDataFrame([(1, i, f"d{i}") for i in range(1, 6)], "query_id int, rank int, doc_id string")
    truth = spark.createDataFrame([(1, "d2"), (1, "d5"), (1, "d9")], "query_id int, doc_id string")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = {r.query_id: r for r in irmetrics.query_metrics(found, truth, q).collect()}
    one = rows[1]
    assert (one.recall_at_3, one.precision_at_3, one.recall_at_5, one.precision_at_5, one.rr) == pytest.approx((1 / 3, 1 / 3, 2 / 3, 2 / 5, 1 / 2))
    assert one.ap == pytest.approx(0.3) and one.ndcg_at_5 == pytest.approx(0.477624, abs=1e-6)
    assert all(v == 0 for k, v in rows[2].asDict().items() if k != "query_id")
    means = irmetrics.mean_metrics(irmetrics.query_metrics(found, truth, q))
    row = means.select(irmetrics.as_record(means).alias("m")).first().m
    assert row.recall_at_k["5"] == pytest.approx(1 / 3) and row.total_queries == 2


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(8)
    span = lambda: (lambda a: (a, a + rng.randint(0, 40)))(rng.randint(0, 300))
    left = [(rng.randint(0, 2), i, *span()) for i in range(40)]
    right = [(rng.randint(0, 2), i, *span()) for i in range(40)]
    got = sections.section_overlap(
        spark.createDataFrame(left, "document_id int, chunk_index int, start_char long, end_char long"),
        spark.createDataFrame(right, "document_id int, section_index int, start_char long, end_char long"), width=16)
    want = sorted((a[0], a[1], b[1]) for a in left for b in right
                  if a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_running_total_and_ids(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"d{i}", i, rng.randint(1, 9)) for i in range(300)]
    got = running_total(spark.createDataFrame(rows, "g string, p int, v int"), "g", "p", F.col("v"), "before", block=7)
    seen: dict = {}
    want = {}
    for g, p, v in rows:
        want[g, p] = seen.get(g, 0)
        seen[g] = want[g, p] + v
    assert {(r.g, r.p): r.before for r in got.collect()} == want
    keys = rng.sample(range(10**6), 500)
    for range_rows in (10**6, 23):  # a few ranges and many
        df = sequential_ids(spark.createDataFrame([(k, "x") for k in keys], "k long, seq0 string"), "k", range_rows=range_rows)
        assert {r.k: r.seq for r in df.collect()} == {k: i + 1 for i, k in enumerate(sorted(keys))} and df.columns == ["k", "seq0", "seq"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "row_number" not in plan
    assert sequential_ids(df.where("false").select("k"), "k").count() == 0


def test_ranges_grow_with_the_rows(spark):
    ranges = lambda n: sequential_ids(spark.range(n), "id", range_rows=100).groupBy(F.spark_partition_id()).count()
    files = [sequential_ids(spark.range(n), "id", range_rows=100).inputFiles() for n in (400, 4000)]
    assert len(files[1]) > 5 * len(files[0]) and ranges(400).count() >= 1


def test_hot_join_deals_out_heavy_keys(spark):
    """A third of the rows on one key: the largest task of the join gets less than three times the median."""
    rows = [(7, i) for i in range(4000)] + [(i % 1000 + 10, 10**6 + i) for i in range(8000)] + [(None, 1)]
    big = spark.createDataFrame(rows, "k int, v int").repartition(4)
    small = spark.createDataFrame([(k, f"s{k}") for k in range(1015)] + [(7, "again")], "k int, s string")
    assert set(heavy_keys(big, "k", 0.05)) == {7}
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = hot_join(big, small, "k", F.col("v"))
        sizes = sorted(r["count"] for r in joined.where("s <> 'again'").groupBy(F.spark_partition_id()).count().collect())
        plain = sorted(r["count"] for r in big.join(small, "k").groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sizes[-1] < 3 * sizes[len(sizes) // 2] < plain[-1]
    for how in ("inner", "left", "left_semi"):
        got, want = hot_join(big, small, "k", F.col("v"), how), big.join(small, "k", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    none = hot_join(big.where("false"), small, "k", F.col("v"))
    assert none.count() == 0


def test_salted_join_is_whole(spark):
    big = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 100)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, s string")
    for fits in (True, False):
        assert spread_join(big, small, ["k"], small_fits=fits, spread_by=F.col("v")).count() == 200
        assert spread_join(big, small.select("k").distinct(), ["k"], small_fits=fits, spread_by=F.col("v"), how="left_semi").count() == 100


def test_grid_has_24_rows(spark):
    rows = experiments.experiment_grid(spark).collect()
    assert len(rows) == 24 and len({r.experiment_id for r in rows}) == 24
    assert {r.chunking for r in rows} == {c.label for c in DEFAULT_CONFIGS}


def test_hooks(spark):
    def scorer(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [float(len(t)) for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None)], "i int, t string").coalesce(1)
    got = {r.i: r.score for r in hooks.judge_rows(df, "t", F.col("t"), scorer).collect()}
    assert got == {1: 2.0, 2: None, 3: None}
    off = hooks.judge_rows(df, "t", F.col("t"), scorer, enabled=False)
    assert {r.score for r in off.collect()} == {None}

    def completer(prompts, attempt):
        return [ValueError("no") if p == "never" or (p == "late" and attempt < 3) else p.upper() for p in prompts]

    texts = spark.createDataFrame([("now",), ("late",), ("never",)], "p string")
    rows = {r.p: r.r for r in texts.select("p", hooks.complete(F.col("p"), completer).alias("r")).collect()}
    assert rows["now"].item == "NOW" and rows["now"].errors == []
    assert rows["late"].item == "LATE" and rows["late"].errors == ["attempt 1: no", "attempt 2: no"]
    assert rows["never"].item is None and len(rows["never"].errors) == 3


def test_citations(spark):
    answers = spark.createDataFrame([(1, 1, "see [1] and [3], [1], [01], [x], [99], [1234567890123]")], "q int, a int, answer string")
    ctx = spark.createDataFrame([(1, 1, "c1"), (1, 2, "c2"), (1, 3, "c3")], "q int, rank int, chunk_id string")
    got = {(r.citation, r.cited, r.chunk_id, r.in_range) for r in experiments.citations(answers, ctx, "q", "a").collect()}
    assert got == {(1, "1", "c1", True), (3, "3", "c3", True), (99, "99", None, False), (None, "1234567890123", None, False)}


def test_answer_scores_reports_rejected(spark):
    rows = spark.createDataFrame([(5, 4), (1, 6), (None, 3), (3, 4)], "a int, b int")
    got = experiments.answer_scores(rows, ["a", "b"], target=3.9).first()
    assert (got.avg_a, got.avg_b, got.avg_overall, got.n_answers, got.n_rejected, got.meets_target) == (4.0, 4.0, 4.0, 2, 2, True)
    none = experiments.answer_scores(rows.where("b = 6"), ["a", "b"]).first()
    assert (none.avg_overall, none.n_answers, none.n_rejected) == (None, 0, 1)


def test_farthest_first():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(30, 5)), np.zeros((1, 5))])
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    chosen = questions.farthest_first(v, 8)
    want = [0]
    while len(want) < 8:
        gaps = {i: min(round(1 - float(unit[i] @ unit[j]), 9) for j in want) for i in range(len(v)) if i not in want}
        want.append(max(gaps, key=lambda i: (gaps[i], -i)))
    assert chosen == want and sorted(questions.farthest_first(v, 99)) == list(range(31)) and questions.farthest_first(v[:0], 3) == []


def test_question_sets(spark):
    """Spread over pages, repeatable, with more variety by vectors, and tied to chunks; failures are kept."""
    rows = [(f"c{i}", i % 3, i % 7 if i % 11 else None, f"text {i % 5} word{i} about topic{i % 4}") for i in range(200)]
    chunks = spark.createDataFrame(rows, "id string, document_id int, page_number int, text string").repartition(4)

    def model(prompts, attempt):
        return [ValueError("no") if "word7 " in p else p.split("\n")[0] + "?" for p in prompts]

    plain = {r.id: r for r in questions.question_set(chunks, model, 12).collect()}
    again = questions.question_set(chunks.repartition(2), model, 12).collect()
    assert sorted(r.query_id for r in plain.values()) == list(range(1, 13)) and {(r.id, r.query_id) for r in again} == {(i, r.query_id) for i, r in plain.items()}
    pages = {i: (d, p) for i, d, p, _ in rows}
    assert len({pages[i] for i in plain}) == 12
    assert {r.query_id: r.kind for r in plain.values()}[3] == "analytical" and all(r.text == f"kind: {r.kind}?" or r.errors for r in plain.values())
    embedder = hooks.hashed_terms(16)
    varied = [r.id for r in questions.question_set(chunks, model, 6, embedder).collect()]
    texts = {i: t for i, _, _, t in rows}

    def spread_of(ids):
        v = np.array(embedder([texts[i] for i in ids]))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        return min((1 - v @ v.T)[np.triu_indices(len(v), 1)])

    first = [i for i, r in plain.items() if r.query_id <= 6]
    assert len(set(varied)) == 6 and spread_of(varied) >= spread_of(first)
    grouped = questions.question_pool(chunks.withColumn("config", F.col("document_id") % 2), 5, group=("config",)).groupBy("config").count().collect()
    assert {r["config"]: r["count"] for r in grouped} == {0: 5, 1: 5}
    assert questions.question_set(chunks.where("false"), model, 3).count() == 0 and questions.question_set(chunks.where("false"), model, 3, embedder).count() == 0
    assert questions.question_set(chunks.where("id IN ('c1', 'c2')"), model, 9).count() == 2


def test_grid_with_own_questions_and_times(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(60))) for i in range(12)], "document_id int, text string")

    def own(chunks):
        rows = questions.question_set(chunks, lambda prompts, n: [p.split("\n")[1][:40] for p in prompts], 4, strata=("document_id",))
        return rows.select("query_id", "text"), rows.select("query_id", "id")

    configs = [DEFAULT_CONFIGS[0], DEFAULT_CONFIGS[2]]
    rows = experiments.run_grid(docs, None, None, configs, {"m": hooks.hashed_terms(16)}, 5, questions=own).collect()
    assert len(rows) == 2 * 3 and all(r.total_queries == 4 and r.avg_retrieval_time > 0 for r in rows)
    by = {(r.chunking, r.retrieval_method): r for r in rows}
    for c in configs:  # the blend takes as long as both of its parts
        parts = by[c.label, "bm25"].avg_retrieval_time + by[c.label, "vector"].avg_retrieval_time
        assert by[c.label, "hybrid"].avg_retrieval_time == pytest.approx(parts)
        assert by[c.label, "bm25"].recall_at_5 > 0.7


def test_index_files_hold_few_segments(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 5)
    docs = spark.createDataFrame([(i, f"w{i} common") for i in range(100)], "doc_id int, text string").coalesce(1)
    index = lexical.build_index(docs)
    per_file = index.groupBy("_metadata.file_path").count().collect()
    assert sum(r["count"] for r in per_file) == 20 and max(r["count"] for r in per_file) <= lexical.SEGMENTS_PER_FILE


def test_minmax_scores_scale_every_document_of_a_query(spark, tmp_path):
    from assaykit.plans.search import minmax_scores

    spark.createDataFrame([(1, "apple")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "apple " + "pear " * i) for i in range(150)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["norm"] for r in minmax_scores(spark, str(tmp_path)).collect()}
    assert len(got) == 150 and got[0] == 1.0 and got[149] == 0.0


def test_words_are_cut_alike_in_spark_and_in_the_kernels(spark):
    from assaykit.functions.text import words

    odd = ["A b_c  d1", "", None, "İstanbul ΑΣ ΑΣ. ß", "x\0y Z", "é—ü’s   ٣٤ 一二 ½ é", "\n\t", "¿Qué?\x85no\x1cyes"]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string").repartition(3)
    rows = df.select("i", words(F.col("t")).alias("a"), hooks.words_of(F.col("t")).alias("b")).collect()
    assert len(rows) == len(odd) and all((r.a or []) == r.b for r in rows)
    plain = [t or "" for t in odd]
    for texts in (plain, [t for t in plain if "\0" not in t], []):
        assert hooks.word_lists(texts) == [hooks._WORD.findall(t.lower()) for t in texts]


def test_a_vector_is_made_once(spark):
    """Each chunk goes to each embedder once, however its vectors are filtered and searched."""
    seen = {m: spark.sparkContext.accumulator(0) for m in ("a", "b")}

    def counting(name, dim):
        inner = hooks.hashed_terms(dim)

        def embed(texts):
            seen[name].add(len(texts))
            return inner(texts)

        return embed

    docs = spark.createDataFrame([(i, f"w{i} v{i % 3} common") for i in range(40)], "id int, text string")
    queries = spark.createDataFrame([(1, "w7 common")], "query_id int, text string")
    q = queries.select("query_id", hooks.embed(F.col("text"), hooks.hashed_terms(8)).alias("embedding"))
    d = docs.select("id", hooks.embed(F.col("text"), counting("a", 8)).alias("embedding"))
    retrieval.vector_scores(q, d, 5, doc="id").collect()
    assert seen["a"].value == 40
    texts = docs.withColumnRenamed("id", "document_id")
    config = DEFAULT_CONFIGS[0]  # one chunk a document
    before = seen["a"].value
    truth = lambda chunks: retrieval.contains_text(queries, chunks, doc="id")
    got = experiments.run_grid(texts, queries, truth, [config], {m: counting(m, 8) for m in seen}, 5).collect()
    assert len(got) == 6 and all(seen[m].value - (before if m == "a" else 0) < 40 + 10 for m in seen)


def test_vectors_with_gaps_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (None, [1.0, 0.0]), (4, []), (5, [1.0, 0.0, 0.0]), (6, [0.0, 1.0])]
    for kind in ("float", "double"):
        docs = spark.createDataFrame(rows, f"doc_id int, embedding array<{kind}>").coalesce(1)
        queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
        got = {(r.doc_id, r.score) for r in retrieval.vector_scores(queries, docs, 5).collect()}
        assert got == {(1, 1.0), (6, 0.0)}


def test_own_questions_embed_each_chunk_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def embedder(texts):
        seen.add(len(texts))
        return hooks.hashed_terms(8)(texts)

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(60))) for i in range(50)], "document_id int, text string")

    def own(chunks):
        rows = questions.question_set(chunks, lambda prompts, n: [p.split("\n")[1][:40] for p in prompts], 2, strata=("document_id",))
        return rows.select("query_id", "text"), rows.select("query_id", "id")

    rows = experiments.run_grid(docs, None, None, [DEFAULT_CONFIGS[0]], {"m": embedder}, 5, questions=own).collect()
    assert len(rows) == 3 and 50 <= seen.value < 75  # a chunk a document, and two questions
