"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.session import fresh_path, shared_dir, ship_package

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back.

    Cuts the lineage, so a lost executor re-reads the files instead of repeating the work, and fixes generated row keys. Texts take a
    third less disk in zstd than in Spark's default codec.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path)
    back._stored_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Rows of documents are large: batches of this size keep a worker's and the JVM's copies of a batch to some megabytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the Python workers, name the shared folder and size the batches of texts."""
    ship_package(spark)
    shared_dir(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def text_bytes(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes, null as empty: the form that the numpy kernels take."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def row_key() -> Column:
    """A key per row for a table that is stored at once; never used on a plan that may run twice."""
    return F.monotonically_increasing_id()


def ascii_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased and nothing else changed."""
    return text.lower().split()


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, .. and the new name of each: whatever names it has, none meets a helper column."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


_KEPT: dict[str, object] = {}


def kept_in_worker(owner: str, key: object = None, build: Callable[[], object] | None = None) -> object:
    """What an operator keeps in a Python worker between tasks, built once per ``key``.

    A worker serves one operator after the other and lives on, so it lets go of what others kept: call this at the start of every
    kernel that needs the memory, with nothing to build if nothing is kept.
    """
    name = f"{owner} {key}"
    for other in [k for k in _KEPT if k != name]:
        del _KEPT[other]
    if build is not None and name not in _KEPT:
        _KEPT[name] = build()
    return _KEPT.get(name)


Kernel = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Hand what this worker's allocators hold free back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim is not None:
        trim(0)


def tidy(kernel: Kernel, keeps: bool = False) -> Kernel:
    """``kernel`` in a worker that holds nothing of other operators while it runs and gives its own memory back at the end.

    A worker lives on and allocators keep what was freed: without this an executor holds the peaks of all operators so far beside
    what the present one needs. A kernel that ``keeps`` something calls ``kept_in_worker`` itself.
    """

    @wraps(kernel)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            kept_in_worker("nothing")
        give_back()
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run
