"""BM25 over a stored inverted index, searched by blocks of documents in the order of their upper bounds.

The index has one row per segment, a run of documents of one partition: nothing is shuffled to build it. Inside a segment a
term's postings are cut at blocks of ``BLOCK`` documents, and each piece keeps the highest term frequency and the smallest document
length in it, from which no document of the block can score more than a bound. A search sums these bounds per block, scores the
most promising blocks first and stops at the first bound below the k-th best score: the rest cannot enter the list.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.hooks import word_array, words_of
from assaykit.operators.hotkeys import driver_blocks
from assaykit.session import ship_package, store

K1, B = 1.5, 0.75
DIGITS = 6
BLOCK = 64
SEGMENT_WORDS, SEGMENT_DOCS = 1_000_000, 65_536
SEGMENTS_PER_FILE = 2
QUERY_WORDS = 1_000_000
NUMBERS = ("lens", "dfs", "term_starts", "block", "starts", "most", "shortest", "doc", "tf")


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[0] .. starts[0] + sizes[0] - 1, starts[1] .. and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def segment_columns(tokens: pa.ListArray) -> dict[str, np.ndarray | pa.Array]:
    """The index of some documents, given as lists of words. All arrays are 32-bit.

    Postings (``doc``, ``tf``) are in the order of term and document; pieces (``block``, ``starts``, ``most``, ``shortest``) are a term's
    postings in one block; ``term_starts`` has the first piece of each term and the end.
    """
    lens = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    n = max(1, len(lens))
    keys, tf = np.unique(codes * n + np.repeat(np.arange(len(lens)), lens), return_counts=True)
    term, doc = keys // n, keys % n
    block = doc // BLOCK
    new = np.ones(len(keys), bool)
    new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    starts = np.flatnonzero(new)
    count = len(flat.dictionary)
    out = {"lens": lens, "dfs": np.bincount(term, minlength=count), "term_starts": np.searchsorted(term[starts], np.arange(count + 1)),
           "block": block[starts], "starts": np.append(starts, len(keys)), "doc": doc, "tf": tf,
           "most": np.maximum.reduceat(tf, starts) if len(starts) else tf, "shortest": np.minimum.reduceat(lens[doc], starts) if len(starts) else tf}
    return {"terms": flat.dictionary, **{k: v.astype("<i4") for k, v in out.items()}}


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table of segments of ``docs``: each text is cut into words once, and stays where it is read.

    A segment closes at ``SEGMENT_WORDS`` words or ``SEGMENT_DOCS`` documents, so a row is bounded by that plus one document. Null texts
    have no words but count as documents. A file has few segments, as whatever reads or writes it holds all of them.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[doc].dataType
    schema = T.StructType([T.StructField("n_docs", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("ids", T.ArrayType(id_type)), T.StructField("terms", T.ArrayType(T.StringType())),
                           *[T.StructField(c, T.BinaryType()) for c in NUMBERS]])

    most_words, most_docs = SEGMENT_WORDS, SEGMENT_DOCS
    step = min(1000, most_docs)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        lists: list[pa.Array] = []
        size = docs_in = 0

        def segment() -> pa.RecordBatch:
            all_ids, tokens = pa.concat_arrays(ids), pa.concat_arrays(lists)
            found = segment_columns(tokens)
            nested = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in (("ids", all_ids), ("terms", found["terms"]))}
            return pa.RecordBatch.from_arrays(
                [pa.array([len(tokens)], pa.int64()), pa.array([int(found["lens"].sum())], pa.int64()), nested["ids"], nested["terms"],
                 *[pa.array([found[c].tobytes()], pa.binary()) for c in NUMBERS]], names=schema.names)

        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids.append(part.column(0))
                lists.append(word_array(part.column(1)))
                docs_in += part.num_rows
                size += len(lists[-1].values)
                if size >= most_words or docs_in >= most_docs:
                    yield segment()
                    ids, lists, size, docs_in = [], [], 0, 0
        if ids:
            yield segment()

    return store(docs.select(doc, text).mapInArrow(kernel, schema), "lexical-index", SEGMENTS_PER_FILE)


class Segment:
    """One row of the index, ready for searches with the document statistics of the whole index."""

    def __init__(self, ids: pa.Array, terms: pa.Array, numbers: dict[str, bytes], avg_len: float, k1: float, b: float):
        self.ids, self.terms, self.k1 = ids, terms, k1
        for name, data in numbers.items():
            setattr(self, name, np.frombuffer(data, "<i4"))
        # tf and length to a posting's share: tf * (k1 + 1) / (tf + rest(length))
        self.rest = k1 * (1 - b + b * self.lens / avg_len)
        lowest = k1 * (1 - b + b * self.shortest / avg_len)
        self.bound = self.most * (k1 + 1) / (self.most + lowest)
        order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        self.id_rank = np.empty(len(order), np.int64)
        self.id_rank[order] = np.arange(len(order))
        self.blocks = self.scored = 0

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best by score, then id. ``terms`` are numbers of this segment's terms."""
        first = self.term_starts[terms].astype(np.int64)
        sizes = self.term_starts[terms + 1] - first
        pieces, weight = _ragged(first, sizes), np.repeat(weights, sizes)
        block = self.block[pieces]
        bounds = np.bincount(block, weight * self.bound[pieces], minlength=-(-len(self.lens) // BLOCK))
        order = np.argsort(-bounds, kind="stable")[: np.count_nonzero(bounds)]
        self.blocks += len(order)
        docs, scores, limit = np.zeros(0, np.int64), np.zeros(0), -np.inf
        at, width = 0, 1 + 2 * k // BLOCK
        while at < len(order) and bounds[order[at]] + 10.0**-digits >= limit:
            now = np.zeros(len(bounds), bool)
            now[order[at : at + width]] = True
            now &= bounds + 10.0**-digits >= limit
            self.scored += np.count_nonzero(now)
            use = now[block]
            lo, hi = self.starts[pieces[use]].astype(np.int64), self.starts[pieces[use] + 1]
            postings = _ragged(lo, hi - lo)
            doc, tf = self.doc[postings], self.tf[postings]
            share = np.repeat(weight[use], hi - lo) * tf * (self.k1 + 1) / (tf + self.rest[doc])
            met, number = np.unique(doc, return_inverse=True)
            docs = np.concatenate([docs, met])
            scores = np.concatenate([scores, np.round(np.bincount(number, share), digits)])
            keep = np.lexsort((self.id_rank[docs], -scores))[:k]
            docs, scores = docs[keep], scores[keep]
            limit = scores[-1] if len(docs) == k else -np.inf
            at, width = at + width, width * 2
        return docs, scores


def _numbered(table: pa.Table, query: str) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Query ids, their distinct terms, and per query the numbers of its terms (as offsets and values)."""
    table = table.combine_chunks()
    lists = table.column("_terms").combine_chunks()
    flat = lists.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int64)
    return table.column(query).combine_chunks(), flat.dictionary, ends, flat.indices.to_numpy().astype(np.int64)


def _idf(index: DataFrame, terms: pa.Array, n_docs: int) -> np.ndarray:
    """ln(1 + (N - df + 0.5) / (df + 0.5)) of each term; only the term lists and their counts are read."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for lists, dfs in zip(batch.column("terms"), batch.column("dfs"), strict=True):
                at = pc.index_in(shared.value, value_set=lists.values)
                there = pc.is_valid(at).to_numpy(zero_copy_only=False)
                total[there] += np.frombuffer(dfs.as_buffer(), "<i4")[at.drop_null().to_numpy()]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["t", "n"])

    # one row per term of the block of queries
    counts = index.select("terms", "dfs").mapInArrow(kernel, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms))
    df[counts.column("t").to_numpy()] = counts.column("n").to_numpy()
    return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def search_index(queries: DataFrame, index: DataFrame, k: int = 10, query: str = "query_id", doc: str = "doc_id", text: str = "text",
                 k1: float = K1, b: float = B, digits: int = DIGITS, query_words: int = QUERY_WORDS, timed: bool = False) -> DataFrame:
    """Candidate rows (query, doc, score): at most k per query and segment, which hold the k best of each query.

    With ``timed`` a column ``seconds`` shares the time of a query in a segment out over its rows there, so that its sum per query is
    the time the query took.

    Queries go to the segments in blocks of about ``query_words`` words, each a measured broadcast; no pair of a query and a document
    is ever shuffled. Scores are rounded, so that equal documents tie whatever order their terms were added in.
    """
    spark = index.sparkSession
    ship_package(spark)
    totals = index.agg(F.sum("n_docs").alias("d"), F.sum("n_words").alias("w")).first()
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(doc, id_type), T.StructField("score", T.DoubleType())])
    if timed:
        schema = schema.add("seconds", "double")
    asked = queries.select(query, F.array_distinct(words_of(F.col(text))).alias("_terms")).where(F.size("_terms") > 0)
    parts = []
    for block in driver_blocks(asked, F.size("_terms"), query_words) if totals["w"] else ():
        q_ids, terms, ends, numbers = _numbered(block, query)
        shared = spark.sparkContext.broadcast((q_ids, terms, ends, numbers, _idf(index, terms, totals["d"])))
        parts.append(index.select("ids", "terms", *NUMBERS).mapInArrow(
            _searcher(shared, totals["w"] / totals["d"], k, k1, b, digits, schema.names), schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _searcher(shared, avg_len: float, k: int, k1: float, b: float, digits: int, names: list[str]):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, terms, ends, numbers, idf = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch.column("ids")[row].values, batch.column("terms")[row].values,
                                  {c: batch.column(c)[row].as_buffer() for c in NUMBERS}, avg_len, k1, b)
                own = pc.fill_null(pc.index_in(terms, value_set=segment.terms), -1).to_numpy()
                found = []
                for q in range(len(q_ids)):
                    began = time.perf_counter()
                    mine = numbers[ends[q] : ends[q + 1]]
                    mine = mine[own[mine] >= 0]
                    docs, scores = segment.best(own[mine], idf[mine], k, digits)
                    seconds = (time.perf_counter() - began) / max(1, len(docs))
                    found.append((np.full(len(docs), q), docs, scores, np.full(len(docs), seconds)))
                q, docs, scores, seconds = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [q_ids.take(pa.array(q)), segment.ids.take(pa.array(docs)), pa.array(scores, pa.float64()), pa.array(seconds)]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return kernel
