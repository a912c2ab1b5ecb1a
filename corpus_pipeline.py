"""From documents to token files in five stages, each written as Parquet and read again by the next.

1. language ID: rows whose language cannot be told go.
2. Near-dedup by shingle similarity, verified on whole texts: one document of each group of near copies stays.
3. Benchmark decontamination: documents that contain a benchmark item go.
4. Mixing: all documents, ordered so that sources come at their target weights; the order is that of the rows in the files.
5. Token output: ids in that order with Elias-Fano coded boundaries; returns where each document stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import decontam, elias_fano, langid, near_copies, pfair
from assaykit.llm.common import prepare, stored
from assaykit.llm.plans import bpe_path
from assaykit.session import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; labels, sources and texts of all documents are the evidence.

    Null and empty texts and texts without letters go, as they have no language; repeated rows and null labels stay evidence.
    """
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words a shingle, similarity of 0.8 and more): that of the smallest id.

    A null text is empty, texts without words are copies of each other, repeated rows too. Pairs come from SimHash (operator 7) and,
    as its two bits cannot tell a similarity of 0.8, from MinHash bands besides; every link is verified on the whole texts.
    """
    return near_copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none and stay; repeated rows share their fate."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix. A null source is one like any other; no row goes or comes."""
    return pfair.in_mix_order(pfair.mix(docs), docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the rows read (by id where they come from no file), read back. A null text is an end id only."""
    path = fresh_path(spark, "token-segments")
    placed, order = elias_fano.in_file_order(docs)
    elias_fano.write_segments(placed, path, bpe_path(), order=order or None)
    return elias_fano.read_documents(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language), ("near_copies", drop_copies), ("benchmark", decontaminate),
    ("mix", mix_sources), ("tokens", write_tokens),
]

# Components, byte-pair encoding and trigram likelihoods are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
