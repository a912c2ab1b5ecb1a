"""Lexical, vector and hybrid retrieval as joins and aggregates."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.text import words
from assaykit.operators.containment import contains_text  # noqa: F401  relevance of what was retrieved
from assaykit.operators.hotkeys import driver_blocks, fits_broadcast, spread_join, top_k
from assaykit.operators.lexical import DIGITS, K1, B, build_index, search_index
from assaykit.session import ship_package

TILE = 1024
BLOCK_BYTES = 32 << 20


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """Distinct terms per query: rows (query, term)."""
    return term_rows(queries, F.array_distinct(words(F.col(text))), query)


def term_rows(df: DataFrame, terms: Column, *keep: str | Column, name: str = "term") -> DataFrame:
    """One row per array element. The outer form keeps Catalyst from inferring a "not empty" filter that would cut the
    text into words a second time below."""
    return df.select(*keep, F.explode_outer(terms).alias(name)).where(F.col(name).isNotNull())


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents and their mean length in words."""
    sizes = docs.select(F.size(words(F.col(text))).alias("n"))
    return sizes.agg(F.count("*").alias("n_docs"), F.try_divide(F.sum("n").cast("double"), F.count("*")).alias("avg_len"))


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: DataFrame | None = None,
             vocabulary_fits: bool = False) -> DataFrame:
    """Inverted index rows (doc, doc_len, term, tf).

    With a ``vocabulary`` (column ``term``) only its terms are kept, and they are filtered before counting. All words
    of a document sit in one task, so the partial aggregate sends one row per document and term to the shuffle.
    """
    # the length is worked out before the explode, or every term row would carry its document's whole word array
    tokens = docs.select(doc, words(F.col(text)).alias("_t")).withColumn("doc_len", F.size("_t"))
    terms = term_rows(tokens, F.col("_t"), doc, "doc_len")
    if vocabulary is not None:
        terms = spread_join(terms, vocabulary.select("term").distinct(), ["term"], small_fits=vocabulary_fits,
                            spread_by=F.col(doc), how="left_semi")
    return terms.groupBy(doc, "doc_len", "term").agg(F.count("*").alias("tf"))


def idf_weights(terms: DataFrame, index: DataFrame, stats: DataFrame, query: str = "query_id") -> DataFrame:
    """Rows (query, term, idf, avg_len), idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    ``cf >= df`` always holds; asking for it keeps tf in the aggregate, so Spark reads the index shuffle it has
    already made for scoring instead of making a second one without tf.
    """
    df = index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("cf >= df")
    weighted = df.join(F.broadcast(stats)).select(  # stats is one aggregate row
        "term", "avg_len", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return terms.join(weighted, "term").select(query, "term", "idf", "avg_len")


def bm25_scores(queries: DataFrame, docs: DataFrame, query: str = "query_id", doc: str = "doc_id",
                text: str = "text", k1: float = K1, b: float = B, digits: int = DIGITS) -> DataFrame:
    """Rows (query, doc, score) for every document that shares a term with the query.

    The query terms are measured; when they fit they are broadcast (and so are the weights, one row per query term),
    and the index, with its very frequent terms, is scored where it lies. Otherwise frequent terms are salted.
    Scores are rounded, so that equal documents tie whatever order their terms were added in.
    """
    terms = query_terms(queries, query, text)
    fits = fits_broadcast(terms)
    index = postings(docs, doc, text, terms, fits)
    weights = idf_weights(terms, index, corpus_stats(docs, text), query)
    hits = spread_join(index, weights, ["term"], small_fits=fits, spread_by=F.col(doc))
    tf = F.col("tf")
    norm = tf + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len"))
    part = F.col("idf") * tf * (k1 + 1) / norm
    return hits.groupBy(query, doc).agg(F.round(F.sum(part), digits).alias("score"))


def ranked(scores: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """First k per query by score, ties by id."""
    return top_k(scores, [query], [F.desc("score"), F.col(doc)], k)


def retrieve_bm25(queries: DataFrame, docs: DataFrame, k: int = 10, query: str = "query_id", doc: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """k best per query from a block-max index of ``docs``: few documents are scored, and only candidates are shuffled."""
    index = build_index(docs, doc, text)
    return ranked(search_index(queries, index, k, query, doc, text), k, query, doc)


# ---------------------------------------------------------------- vectors

class RunningBest:
    """The k best rows for each of some queries, kept while tiles of the corpus go by.

    Scores exist for one tile of ``TILE`` queries and rows at a time. The lengths of a tile's vectors bound what it can hold: it is
    scored for those queries only whose k-th best score so far the bound can still reach. Ties go to the smaller id.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, digits: int, id_type: np.dtype):
        self.queries = _unit_rows(queries) if metric == "cosine" else queries
        self.lengths = np.sqrt((self.queries * self.queries).sum(1))
        self.k, self.metric, self.digits = k, metric, digits
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.zeros((len(queries), k), id_type)
        self.tiles = self.skipped = 0

    def _bound(self, low: float, high: float) -> np.ndarray:
        """What a row whose length is within these limits can score at best, per query."""
        if self.metric == "cosine":
            return np.ones(len(self.lengths))
        if self.metric == "ip":
            return self.lengths * high
        return -np.maximum(0, np.maximum(low - self.lengths, self.lengths - high))

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        if self.metric == "cosine":
            matrix = _unit_rows(matrix)
        lengths = np.sqrt((matrix * matrix).sum(1))
        order = np.argsort(-lengths, kind="stable")  # tiles of like lengths, the longest first
        for lo in range(0, len(order), TILE):
            rows = order[lo : lo + TILE]
            bound = self._bound(lengths[rows[-1]], lengths[rows[0]])
            reach = np.flatnonzero(bound + 10.0**-self.digits >= self.scores[:, -1])
            for some in np.split(reach, range(TILE, len(reach), TILE)):
                self.tiles += 1
                if len(some):
                    self._tile(some, ids[rows], matrix[rows], lengths[rows])
                else:
                    self.skipped += 1

    def _tile(self, some: np.ndarray, ids: np.ndarray, matrix: np.ndarray, lengths: np.ndarray) -> None:
        scores = self.queries[some] @ matrix.T
        if self.metric == "l2":
            scores *= -2
            scores += self.lengths[some, None] ** 2
            scores += lengths[None, :] ** 2
            np.sqrt(np.maximum(scores, 0, out=scores), out=scores)
            np.negative(scores, out=scores)
        np.round(scores, self.digits, out=scores)
        limit = self.scores[some, -1]
        if scores.shape[1] > self.k:  # nothing below the tile's own k-th best
            limit = np.maximum(limit, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        q, c = np.nonzero(scores >= limit[:, None])
        hit = np.unique(q)
        old = np.repeat(hit, self.k), self.scores[some[hit]].ravel(), self.ids[some[hit]].ravel()
        q, values, found = (np.concatenate(x) for x in zip(old, (q, scores[q, c], ids[c]), strict=True))
        order = np.lexsort((_ranks(found), -values, q))
        q, values, found = q[order], values[order], found[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = place < self.k
        self.scores[some[q[keep]], place[keep]] = values[keep]
        self.ids[some[q[keep]], place[keep]] = found[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query numbers, ids, scores) of all that was found."""
        q, place = np.nonzero(self.scores > -np.inf)
        return q, self.ids[q, place], self.scores[q, place]


def _ranks(ids: np.ndarray) -> np.ndarray:
    return ids if ids.dtype != object else np.unique(ids.astype(str), return_inverse=True)[1]


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _whole(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    """The rows with an id and a vector of ``dim`` components, none of them null."""
    ids, vectors = batch.column(0), batch.column(1)
    keep = pc.and_(pc.is_valid(ids), pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    if vectors.flatten().null_count:
        gaps = pc.list_parent_indices(vectors).filter(pc.is_null(vectors.flatten())).to_numpy()
        whole = np.ones(batch.num_rows, bool)
        whole[gaps] = False
        keep = pc.and_(keep, pa.array(whole))
    return batch if pc.all(keep).as_py() else batch.filter(keep)


def vector_scores(queries: DataFrame, corpus: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id",
                  vector: str = "embedding", metric: str = "cosine", digits: int = DIGITS,
                  block_bytes: int = BLOCK_BYTES, timed: bool = False) -> DataFrame:
    """Exact search: candidate rows (query, doc, score), at most k per query and task, which hold the k best of each query.

    ``metric`` is cosine, ip (inner product) or l2 (negative distance, so larger is better). The corpus is neither moved nor copied:
    each task goes over its rows once, tile by tile, with the best lists of all queries of a block. A block of queries and its lists
    are measured to stay below ``block_bytes``; more queries take a further pass over the corpus each block. Vectors are compared with
    those of equal length only; null vectors, vectors with null components and null ids take no part. With ``timed`` a column
    ``seconds`` shares each task's time out over the queries of the block and their rows.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    q = queries.select(query, F.col(vector).cast("array<double>").alias("_v")).where(
        F.col(query).isNotNull() & F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull()) & (F.size("_v") > 0))
    # the kernel picks the corpus rows: a filter here would be pushed below the embedder and make every vector twice
    plain = corpus.schema[vector].dataType in (T.ArrayType(T.FloatType(), True), T.ArrayType(T.FloatType(), False))
    c = corpus.select(doc, (F.col(vector) if plain else F.col(vector).cast("array<double>")).alias("_v"))
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(doc, corpus.schema[doc].dataType),
                           T.StructField("score", T.DoubleType())])
    if timed:
        schema = schema.add("seconds", "double")
    parts = []
    for block in driver_blocks(q, F.size("_v") * 8 + 16 * k, block_bytes):
        block = block.combine_chunks()
        sizes = pc.list_value_length(block.column("_v")).to_numpy()
        for dim in np.unique(sizes).tolist():
            some = block.filter(pa.array(sizes == dim)).combine_chunks()
            shared = spark.sparkContext.broadcast((some.column(query).combine_chunks(), _matrix(some.column("_v").combine_chunks(), dim)))
            kernel = _search(shared, dim, k, metric, digits, schema.names)
            parts.append(c.mapInArrow(kernel, schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _search(shared, dim: int, k: int, metric: str, digits: int, names: list[str]):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, matrix = shared.value
        best, spent = None, 0.0
        for batch in batches:
            began = time.perf_counter()
            batch = _whole(batch, dim)
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            best = best or RunningBest(matrix, k, metric, digits, ids.dtype)
            id_type = batch.column(0).type
            best.add(ids, _matrix(batch.column(1), dim))
            spent += time.perf_counter() - began
        if best is not None:
            q, found, scores = best.rows()
            seconds = spent / len(q_ids) / np.maximum(1, np.bincount(q, minlength=len(q_ids)))[q]
            columns = [q_ids.take(pa.array(q)), pa.array(found, id_type), pa.array(scores), pa.array(seconds)]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return kernel


def retrieve_vector(queries: DataFrame, corpus: DataFrame, k: int = 10, query: str = "query_id", doc: str = "doc_id",
                    vector: str = "embedding", metric: str = "cosine", digits: int = DIGITS) -> DataFrame:
    return ranked(vector_scores(queries, corpus, k, query, doc, vector, metric, digits), k, query, doc)


# ---------------------------------------------------------------- fusion

def min_max(scores: DataFrame, query: str = "query_id", score: str = "score", out: str = "norm",
            bounded: bool = False) -> DataFrame:
    """Scale scores to [0, 1] within each query's result list; a list of equal scores becomes 1.

    Limits come from an aggregate with map-side combine, joined back, so a very long list is not gathered in one task.
    ``bounded`` lists (the output of a top-k, already partitioned by query) take the limits from a window instead,
    which needs no further shuffle.
    """
    if bounded:
        list_of = Window.partitionBy(query)
        limited = scores.withColumn("_lo", F.min(score).over(list_of)).withColumn("_hi", F.max(score).over(list_of))
    else:
        limits = scores.groupBy(query).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
        limited = scores.join(limits, query)
    scaled = F.coalesce(F.try_divide(F.col(score) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(1.0))
    return limited.withColumn(out, scaled).drop("_lo", "_hi")


def fuse(lexical: DataFrame, vector: DataFrame, k: int, alpha: float = 0.5, query: str = "query_id",
         doc: str = "doc_id", scale_vector: bool = True, digits: int = DIGITS) -> DataFrame:
    """alpha * vector + (1 - alpha) * lexical over both top-k lists; a missing side counts 0."""
    lex = min_max(lexical.select(query, doc, "score"), query, out="lex", bounded=True).select(query, doc, "lex")
    scaled = min_max(vector.select(query, doc, "score"), query, out="vec", bounded=True) if scale_vector else (
        vector.select(query, doc, F.col("score").alias("vec")))
    both = lex.join(scaled.select(query, doc, "vec"), [query, doc], "full")
    blend = alpha * F.coalesce("vec", F.lit(0.0)) + (1 - alpha) * F.coalesce("lex", F.lit(0.0))
    return ranked(both.select(query, doc, F.round(blend, digits).alias("score")), k, query, doc)


def query_times(candidates: DataFrame, query: str = "query_id") -> DataFrame:
    """Rows (query, time_taken): what each query of a timed search took, in seconds of the search kernels."""
    return candidates.groupBy(query).agg(F.sum("seconds").alias("time_taken"))


def candidate_depth(k: int) -> int:
    return max(k, 100)


def retrieve_hybrid(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame,
                    k: int = 10, alpha: float = 0.5, depth: int | None = None, query: str = "query_id",
                    doc: str = "doc_id", text: str = "text", scale_vector: bool = True) -> DataFrame:
    depth = depth or candidate_depth(k)
    lexical = retrieve_bm25(queries, docs, depth, query, doc, text)
    vector = retrieve_vector(query_vectors, doc_vectors, depth, query, doc)
    return fuse(lexical, vector, k, alpha, query, doc, scale_vector)


def rerank(results: DataFrame, new_score: Column, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Order a result list again by another score; rows without one go last."""
    rescored = results.drop("rank", "score").withColumn("score", new_score)
    return top_k(rescored, [query], [F.desc_nulls_last("score"), F.col(doc)], k)
