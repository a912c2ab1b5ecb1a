"""Hooks for outside models: batch embedding, scoring and text completion in Arrow batches.

The hook function is the only Python that runs per row batch; Spark partitions the work around it. Filter rows before
calling a hook: Catalyst does not push filters through Python operators.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.session import ship_package

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str]], Iterable[float | None]]
Completer = Callable[[list[str], int], list]

BATCH = 100
_WORD = re.compile(r"[^\W]+", re.UNICODE)


def term_bucket(term: str, dim: int) -> int:
    """Bucket of a term: first 8 hex digits of its MD5, modulo the dimension."""
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim


class _Hashes(dict):
    """First 8 hex digits of the MD5 of each term, as a number; forgets all of them when there are too many."""

    def __missing__(self, term: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[term] = term_bucket(term, 1 << 32)
        return value


_HASHES = _Hashes()
_LAST: list[tuple] = [((), None, None)]  # the texts hashed last, with the result


def word_lists(texts: list[str]) -> list[list[str]]:
    """The words of each text in lower case: what ``_WORD`` finds, cut in one go for all texts."""
    joined = "\0".join(texts)
    if joined.count("\0") != max(0, len(texts) - 1):  # a text holds the separator
        return [_WORD.findall(t.lower()) for t in texts]
    joined = joined.lower()
    for c in set(joined):
        if not (c == "\0" or c == "_" or c.isalnum() or c.isspace()):
            joined = joined.replace(c, " ")
    return [t.split() for t in joined.split("\0")] if texts else []


def word_array(texts: pa.Array) -> pa.ListArray:
    """The words of each text, as ``functions.text.words`` gives them; a null text has none."""
    found = word_lists(["" if t is None else t for t in texts.to_pylist()])
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(chain.from_iterable(found)), pa.string()))


def words_of(text: Column) -> Column:
    """``word_array`` as a column: where the words of queries are to be those that a kernel cuts its documents into."""
    prepare_workers()

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return word_array(texts)

    return run(text)


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text its number of words, and the hashes of all words; embedders that get the same texts in turn share one pass."""
    key = tuple(texts)
    if _LAST[0][0] != key:
        found = word_lists([t or "" for t in texts])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        _LAST[0] = (key, sizes, np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(found)), np.int64, sizes.sum()))
    return _LAST[0][1:]


def hashed_terms(dim: int = 64) -> Embedder:
    """Default embedder without a model: term counts per hash bucket, scaled to unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        sizes, hashes = _hashed(texts)
        cells = np.repeat(np.arange(len(texts)) * dim, sizes) + hashes % dim
        out = np.bincount(cells, minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0).astype(np.float32)

    return embed


def prepare_workers() -> None:
    """The workers need this package before any hook runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)


def _chunks(texts: list[str], size: int) -> Iterator[list[str]]:
    for i in range(0, len(texts), size):
        yield texts[i : i + size]


def _arrow_vectors(parts: list) -> pa.Array:
    """What an embedder returned, call by call, as one Arrow array of float lists."""
    if parts and all(isinstance(p, np.ndarray) and p.ndim == 2 for p in parts):
        widths = np.concatenate([np.full(len(p), p.shape[1], np.int64) for p in parts])
        flat = np.concatenate([np.ascontiguousarray(p, np.float32).ravel() for p in parts])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]), pa.int32()), pa.array(flat))
    rows = [None if v is None else np.asarray(v, np.float32) for p in parts for v in p]
    return pa.array(rows, pa.list_(pa.float32()))


def embed_each(text: Column, embedders: dict[str, Embedder], batch_size: int = BATCH) -> Column:
    """Struct of one embedding (array<float>) per embedder; each sees the same texts, at most ``batch_size`` per call."""
    prepare_workers()
    kind = T.StructType([T.StructField(name, T.ArrayType(T.FloatType())) for name in embedders])

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        found: dict[str, list] = {name: [] for name in embedders}
        for part in _chunks(texts.to_pylist(), batch_size):
            for name, embedder in embedders.items():
                found[name].append(embedder(part))
        return pa.StructArray.from_arrays([_arrow_vectors(parts) for parts in found.values()], names=list(found))

    return run(text)


def embed(text: Column, embedder: Embedder, batch_size: int = BATCH) -> Column:
    """Embedding column (array<float>); the embedder sees at most ``batch_size`` texts per call."""
    prepare_workers()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(texts: pa.Array) -> pa.Array:
        return _arrow_vectors([embedder(part) for part in _chunks(texts.to_pylist(), batch_size)])

    return run(text)


def score(text: Column, scorer: Scorer, batch_size: int = BATCH) -> Column:
    """Score column (double). The scorer returns one number or one exception per text; an exception gives NULL.

    A batch whose scorer raises is retried row by row; a row that raises gets NULL.
    """
    prepare_workers()

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        out: list[float | None] = []
        for part in _chunks(texts.tolist(), batch_size):
            try:
                out.extend(scorer(part))
            except Exception:  # an outside model failed for the batch
                for one in part:
                    try:
                        out.extend(scorer([one]))
                    except Exception:
                        out.append(None)
        return pd.Series([None if isinstance(x, Exception) else x for x in out], dtype="float64")

    return run(text)


def complete(prompt: Column, completer: Completer, max_attempts: int = 3, batch_size: int = BATCH) -> Column:
    """Text completion with retries: struct<item string, errors array<string>>.

    ``completer(prompts, attempt)`` returns one text or one exception per prompt. Only prompts without a result are
    asked again; each failure is kept as "attempt N: message". After the last attempt the item is NULL, and the job
    goes on.
    """
    prepare_workers()

    @F.pandas_udf("item string, errors array<string>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        texts = prompts.tolist()
        items: list[str | None] = [None] * len(texts)
        errors: list[list[str]] = [[] for _ in texts]
        waiting = list(range(len(texts)))
        for attempt in range(1, max_attempts + 1):
            left = []
            for part in _chunks(waiting, batch_size):
                try:
                    answers = completer([texts[i] for i in part], attempt)
                except Exception as exc:
                    answers = [exc] * len(part)
                for i, answer in zip(part, answers):
                    if isinstance(answer, Exception):
                        errors[i].append(f"attempt {attempt}: {answer}")
                        left.append(i)
                    else:
                        items[i] = answer
            waiting = left
        return pd.DataFrame({"item": items, "errors": errors})

    return run(prompt)


def judge_rows(df: DataFrame, present: str, text: Column, scorer: Scorer, out: str = "score",
               enabled: bool = True) -> DataFrame:
    """Score the rows whose ``present`` column is set; the others and failed calls keep NULL.

    Rows are split before the hook, so records without an item never reach Python. Disabled: all NULL, no Python.
    """
    if not enabled:
        return df.withColumn(out, F.lit(None).cast("double"))
    scored = df.where(F.col(present).isNotNull()).withColumn(out, score(text, scorer))
    skipped = df.where(F.col(present).isNull()).withColumn(out, F.lit(None).cast("double"))
    return scored.unionByName(skipped)
