"""Ground truth tables and document subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators.hotkeys import running_total

QRELS = "map<string, map<string, int>>"


def explode_qrels(df: DataFrame, qrels: str = "qrels") -> DataFrame:
    """Nested map query -> {document: section} to rows (query_id, document_id, section_index)."""
    outer = df.select(F.explode(qrels).alias("query_id", "_docs"))
    return outer.select("query_id", F.explode("_docs").alias("document_id", "section_index"))


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Read qrels text, one JSON object per line or one object per file."""
    raw = spark.read.text(path, wholetext=False).where(F.trim("value") != "")
    return explode_qrels(raw.select(F.from_json("value", QRELS, {"mode": "FAILFAST"}).alias("qrels")))


def pack_qrels(rows: DataFrame, pieces: int = 16) -> DataFrame:
    """Rows (query_id, document_id, section_index) to JSON objects {query: {document: section}}.

    A query is up to ``pieces`` objects, told apart by a hash of the document, so that one with very many documents is not one row;
    :func:`load_qrels` reads them as one.
    """
    piece = F.pmod(F.xxhash64("document_id"), F.lit(pieces))
    docs = rows.groupBy("query_id", piece.alias("_piece")).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("document_id", "section_index")))).alias("docs"))
    return docs.select(F.to_json(F.create_map("query_id", "docs")).alias("value"))


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """JSON values of text files as variants: one per line, or one per file where a file is one value over several lines.

    A file whose first line is a whole value is read by lines, so a file of many records is never one row. What is no JSON raises.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.limit(1).select(F.try_parse_json("value").isNotNull().alias("whole")).first()
    if first is not None and not first.whole:
        lines = spark.read.text(path, wholetext=True)
    return lines.select(F.parse_json("value").alias("v"))


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of every entry of all objects in the files."""
    _objects(spark, path).createOrReplaceTempView("_truth_objects")
    found = spark.sql("SELECT e.key, e.value FROM _truth_objects, LATERAL variant_explode(v) AS e")
    spark.catalog.dropTempView("_truth_objects")
    return found


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """Rows (query_id, text, type, source) of {query: text} or {query: {"query": text, "type": .., "source": ..}}.

    Files may hold one large object, several, or one a line; other fields are ignored, missing ones are null.
    """
    plain = F.schema_of_variant("value").isin("STRING")
    field = lambda name: F.try_variant_get("value", f"$.{name}", "string")
    text = F.when(plain, F.try_variant_get("value", "$", "string")).otherwise(F.coalesce(field("query"), field("question"), field("text")))
    return _entries(spark, path).select(F.col("key").alias("query_id"), text.alias("text"), field("type").alias("type"),
                                        field("source").alias("source"))


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """Rows (query_id, answer) of {query: answer} or {query: {"answer": ..}}; a list of answers gives a row each, null stays null."""
    kind = F.schema_of_variant("value")
    one = F.coalesce(F.try_variant_get("value", "$.answer", "string"), F.try_variant_get("value", "$.text", "string"))
    many = F.try_variant_get("value", "$", "array<string>")
    answers = F.when(kind.startswith("ARRAY"), many).when(kind.startswith("OBJECT"), F.array(one)).otherwise(
        F.array(F.try_variant_get("value", "$", "string")))
    return _entries(spark, path).select(F.col("key").alias("query_id"), F.explode(answers).alias("answer"))


def load_sections(spark: SparkSession, path: str) -> DataFrame:
    """Rows (document_id, section_index, title, text, start_char, end_char) of documents with a list of sections.

    A document is an object with ``id`` and ``sections``, whose elements are texts or objects with ``text`` (or ``content``) and
    ``title``. Sections follow each other in the document's text, with an empty line between, so that their places are running sums.
    """
    docs = _objects(spark, path).select(
        F.coalesce(F.try_variant_get("v", "$.id", "string"), F.try_variant_get("v", "$.paper_id", "string")).alias("document_id"),
        F.try_variant_get("v", "$.sections", "array<variant>").alias("_s"))
    rows = docs.select("document_id", F.posexplode("_s").alias("section_index", "_v"))
    field = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    text = F.when(F.schema_of_variant("_v").isin("STRING"), F.try_variant_get("_v", "$", "string")).otherwise(
        F.coalesce(field("text"), field("content")))
    rows = rows.select("document_id", "section_index", field("title").alias("title"), F.coalesce(text, F.lit("")).alias("text"))
    placed = running_total(rows, "document_id", "section_index", F.length("text") + 2, "start_char")
    return placed.select("document_id", "section_index", "title", "text", F.col("start_char").cast("long").alias("start_char"),
                         (F.col("start_char") + F.length("text")).cast("long").alias("end_char"))


def first_documents(docs: DataFrame, order: str, limit: int) -> DataFrame:
    """Development subset: the first ``limit`` documents in id order (a top-k, not a full sort)."""
    return docs.orderBy(order).limit(limit)


def missing_from_cache(chunks: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    """Chunks whose embedding is not stored yet."""
    return chunks.join(cache.select(key), key, "left_anti")
