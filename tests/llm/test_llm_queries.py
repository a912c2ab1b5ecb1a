"""Queries and pipeline of the training-data operators over the smallest tables."""

import itertools
import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from assaykit.llm import decontam, simhash
from assaykit.llm.common import PLANS, stored
from tests.test_queries import SF, TABLES, comparable

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    if name in oracle_sql():
        result = duck.execute(oracle_sql()[name])
        columns = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert comparable(df.columns, rows) == comparable(columns, result.fetchall())
    other = {"op1": ("pages", "page_id"), "op12": ("embeddings", "vec_id")}
    other |= dict.fromkeys(["op4", "op5", "op11", "op13"], (None, None))
    table, key = other.get(name.split("_")[0], ("documents", "doc_id"))
    if table:
        ids = Counter(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
        assert Counter(r[key] for r in rows) == ids


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in PLANS) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and after.items() <= before.items()
        if name == "language":
            assert all(not any(c.isalpha() for c in before[i]) for i in before.keys() - after.keys())
        elif name == "near_copies":
            sets = {i: np.unique(simhash.shingle_hashes(t.encode(), 5)) for i, t in before.items()}
            sizes = {i: len(s) for i, s in sets.items()}

            def close(i, j):
                if 5 * min(sizes[i], sizes[j]) < 4 * max(sizes[i], sizes[j]):
                    return False
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return 5 * shared >= 4 * (sizes[i] + sizes[j] - shared)

            # complete and right: what went is near a smaller id, and no two that stayed are near each other
            for i in before.keys() - after.keys():
                assert any(close(i, j) for j in before if j != i)
            assert not any(close(i, j) for i, j in itertools.combinations(sorted(after), 2))
            assert len(set(after.values())) == len(after)
        elif name == "benchmark":
            leaks = {r.doc_id for r in decontam.contained_items(spark.createDataFrame(list(before.items()), "doc_id long, text string"), items).collect()}
            assert before.keys() - after.keys() == leaks
        else:
            assert before.keys() == after.keys()
    order = [r.doc_id for r in docs.collect()]
    tokens = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in tokens) == Counter(order)
    assert [r.start for r in tokens] == np.concatenate([[0], np.cumsum([r.n_tokens for r in tokens])[:-1]]).tolist()
