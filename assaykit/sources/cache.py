"""Embedding cache: bucketed files that are joined without a shuffle, and a manifest that writers commit to one after the other."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.session import ship_package, store

BUCKETS = 64
COMPACT_AT = 8
_END = "end"


class Manifest:
    """Versions of a list of folders. Version n is one small file that exactly one writer can create.

    A reader takes the last version that was written to its end. A writer that finds its version taken has lost the race: it reads
    the new list and tries the next one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        root = self._path(folder)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(root)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def latest(self) -> tuple[int, list[str]]:
        names = sorted((f.getPath().getName() for f in self.fs.listStatus(self._path(self.folder)) if f.getPath().getName().isdigit()), reverse=True)
        for name in names:
            stream = self.fs.open(self._path(f"{self.folder}/{name}"))
            lines = bytes(stream.readAllBytes()).decode().split("\n")
            stream.close()
            if lines[-1] == _END:
                return int(name), lines[:-1]
        return 0, []

    def commit(self, version: int, folders: list[str]) -> bool:
        """Make ``folders`` the list of this version; False if another writer was first."""
        try:
            stream = self.fs.create(self._path(f"{self.folder}/{version:010d}"), False)
        except Exception as exc:  # the JVM's FileAlreadyExistsException comes as a Py4J error
            if "already exists" not in str(exc).lower() and "FileAlreadyExists" not in str(exc):
                raise
            return False
        stream.write(bytearray("\n".join([*folders, _END]).encode()))
        stream.close()
        return True


class EmbeddingCache:
    """Vectors of one (cache key, model) below ``path``, each key once.

    Every run adds one folder of files in ``buckets`` buckets by hash of the key, sorted inside, so that looking keys up shuffles the
    chunks asked for and never the store. The manifest names the folders that count. A run embeds what no folder has, and
    commits its folder; if another run commits first, what that one stored too is taken out before the next try, so no key is ever
    stored twice. After ``COMPACT_AT`` folders they are merged into one.
    """

    def __init__(self, spark: SparkSession, path: str, cache_key: str, model: str, key: str = "id", key_type: str = "string",
                 buckets: int = BUCKETS):
        ship_package(spark)
        digest = hashlib.sha256(f"{cache_key}\n{model}".encode()).hexdigest()[:24]
        self.spark, self.key, self.key_type, self.buckets = spark, key, key_type, buckets
        self.root = f"{path.rstrip('/')}/{digest}"
        self.manifest = Manifest(spark, f"{self.root}/manifest")

    def _read(self, folder: str) -> DataFrame:
        """A folder with its buckets known: a table for the time of the look-up; the files stay when it is dropped."""
        name = f"cache_{uuid.uuid4().hex}"
        place = folder.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} (`{self.key}` {self.key_type}, embedding ARRAY<FLOAT>) USING parquet CLUSTERED BY (`{self.key}`) "
                       f"SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        found = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return found

    def _write(self, rows: DataFrame) -> str:
        folder, name = f"{self.root}/data-{uuid.uuid4().hex}", f"cache_{uuid.uuid4().hex}"
        dealt = rows.select(self.key, F.col("embedding").cast("array<float>").alias("embedding")).repartition(self.buckets, self.key)
        dealt.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", folder).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return folder

    def stored(self) -> list[DataFrame]:
        """The folders that count; no key is in two of them."""
        return [self._read(f) for f in self.manifest.latest()[1]]

    def missing(self, chunks: DataFrame, folders: list[DataFrame] | None = None) -> DataFrame:
        """Rows of ``chunks`` whose key is not stored."""
        return reduce(lambda rows, part: rows.join(part.select(self.key), self.key, "left_anti"),
                      self.stored() if folders is None else folders, chunks)

    def add(self, chunks: DataFrame, embed_text: Callable[[Column], Column], text: str = "text") -> None:
        """Embed and store what is missing of ``chunks``. A key that repeats is embedded once (by its first text in order); null keys are left out."""
        once = chunks.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(text).alias(text))
        version, folders = self.manifest.latest()
        wanted = self.missing(once, [self._read(f) for f in folders])
        fresh = store(wanted.select(self.key, embed_text(F.col(text)).alias("embedding")), "fresh-embeddings")
        while not fresh.isEmpty():
            mine = self._write(fresh)
            if self.manifest.commit(version + 1, [*folders, mine]):
                break
            seen = set(folders)
            version, folders = self.manifest.latest()
            fresh = self.missing(fresh, [self._read(f) for f in folders if f not in seen])
        if len(folders) + 1 >= COMPACT_AT:
            self.compact()

    def compact(self) -> bool:
        """Merge all folders into one; False if a writer came between, which changes nothing."""
        version, folders = self.manifest.latest()
        if len(folders) < 2:
            return True
        merged = self._write(reduce(DataFrame.unionAll, [self._read(f) for f in folders]))
        return self.manifest.commit(version + 1, [merged])

    def lookup(self, chunks: DataFrame) -> DataFrame:
        """(key, embedding) of every row of ``chunks`` whose key is stored."""
        parts = [chunks.select(self.key).join(part, self.key) for part in self.stored()]
        none = self.spark.createDataFrame([], f"`{self.key}` {self.key_type}, embedding array<float>")
        return reduce(DataFrame.unionAll, parts) if parts else none


def cached_embeddings(spark: SparkSession, chunks: DataFrame, path: str, cache_key: str, model: str,
                      embed_text: Callable[[Column], Column], key: str = "id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Embeddings of all chunks, a row each: stored ones are read, missing ones are computed once and added to the store."""
    cache = EmbeddingCache(spark, path, cache_key, model, key, chunks.schema[key].dataType.simpleString(), buckets)
    cache.add(chunks, embed_text, text)
    return cache.lookup(chunks)
