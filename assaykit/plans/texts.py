"""Pages, chunks and sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import chunking, sections
from assaykit.operators.chunking import ChunkConfig
from assaykit.operators.hotkeys import sequential_ids
from assaykit.operators.retrieval import contains_text
from assaykit.plans.registry import ORACLES, query, spread_table, table
from assaykit.sources.pages import full_text, page_offsets

THRESHOLD = 0.15
DIM = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues as documents, turns as pages."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), "text")


PAGES_SQL = """
WITH pages AS (
  SELECT conv_id AS document_id, turn AS page_number, text,
    coalesce(sum(len(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
      AS start_char
  FROM conversations)
"""


@query("page_offsets", PAGES_SQL + """
SELECT document_id, page_number, start_char, start_char + len(text) AS end_char FROM pages""")
def offsets(spark, sf_dir):
    return page_offsets(pages(spark, sf_dir))


@query("full_text", """
SELECT conv_id AS document_id, string_agg(text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def whole_text(spark, sf_dir):
    return full_text(pages(spark, sf_dir))


@query("trace_ids", """
SELECT doc_id, 'qa_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS trace_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)""")
def trace_ids(spark, sf_dir):
    from assaykit.operators.generation import number_records

    return number_records(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "trace_id")


@query("sequence_numbers", "SELECT l_key, row_number() OVER (ORDER BY l_key) AS seq FROM "
       "(SELECT DISTINCT l_orderkey * 10 + l_linenumber AS l_key FROM lineitem)")
def sequence_numbers(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_key"))
    return sequential_ids(keys.distinct(), "l_key")


# ---------------------------------------------------------------- chunks

def words_sql(source: str, doc: str = "doc_id") -> str:
    return (f"SELECT {doc} AS doc_id, regexp_extract_all(text, '\\S+\\s*') AS pieces, "
            f"len(regexp_extract(text, '^\\s*')) AS lead FROM {source}")


def sentences_sql(source: str, doc: str = "doc_id") -> str:
    return (f"SELECT {doc} AS doc_id, list_filter(string_split(regexp_replace(text, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), "
            f"chr(1)), lambda p: regexp_matches(p, '\\S')) AS pieces, 0 AS lead FROM {source}")


def windows_sql(tiles: str, size: int, overlap: int) -> str:
    """Chunks of a tile table (doc_id, pieces, lead)."""
    stride = size - overlap
    return f"""
SELECT doc_id, i::INT AS chunk_index, (pos + len(raw) - len(regexp_replace(raw, '^\\s+', '')))::BIGINT AS start_char,
  (pos + len(raw) - len(regexp_replace(raw, '^\\s+', '')) + len(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')))::BIGINT AS end_char,
  regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text
FROM (
  SELECT doc_id, i, array_to_string(pieces[i * {stride} + 1 : i * {stride} + {size}], '') AS raw,
    lead + len(array_to_string(pieces[1 : i * {stride}], '')) AS pos
  FROM (SELECT *, unnest(range(0, CASE WHEN len(pieces) <= {size} THEN 1
      ELSE 1 + ceil((len(pieces) - {size})::DOUBLE / {stride})::BIGINT END)) AS i FROM ({tiles}) WHERE len(pieces) > 0))
"""


@query("chunk_fixed", windows_sql(words_sql("documents"), 256, 50))
def chunk_fixed(spark, sf_dir):
    return chunking.chunk_fixed(documents(spark, sf_dir), "doc_id")


@query("chunk_sliding", windows_sql(words_sql("documents"), 128, 64))
def chunk_sliding(spark, sf_dir):
    return chunking.chunk_sliding(documents(spark, sf_dir), "doc_id", size=128, step=64)


@query("chunk_sentence", windows_sql(sentences_sql("documents"), 5, 1))
def chunk_sentence(spark, sf_dir):
    return chunking.chunk_sentences(documents(spark, sf_dir), "doc_id")


@query("chunk_recursive", f"""
WITH p AS (SELECT doc_id, generate_subscripts(x, 1) AS p_no, unnest(x) AS piece
  FROM (SELECT doc_id, string_split(regexp_replace(text, '(\\n)([^\\n])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS x FROM documents)),
s AS (SELECT doc_id, p_no, generate_subscripts(x, 1) AS s_no, unnest(x) AS piece
  FROM (SELECT doc_id, p_no, CASE WHEN len(regexp_extract_all(piece, '\\S+\\s*')) > 40
      THEN string_split(regexp_replace(piece, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [piece] END AS x FROM p)),
w AS (SELECT doc_id, p_no, s_no, i AS w_no, CASE WHEN n > 40 THEN
      CASE WHEN i = 0 THEN regexp_extract(piece, '^\\s*') ELSE '' END || array_to_string(tiles[i * 40 + 1 : i * 40 + 40], '')
      ELSE piece END AS piece
  FROM (SELECT *, unnest(range(0, CASE WHEN n > 40 THEN ceil(n / 40.0)::BIGINT ELSE 1 END)) AS i
    FROM (SELECT *, regexp_extract_all(piece, '\\S+\\s*') AS tiles, len(regexp_extract_all(piece, '\\S+\\s*')) AS n FROM s))),
o AS (SELECT *, coalesce(sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY p_no, s_no, w_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p_no, s_no, w_no) - 1)::INT AS chunk_index,
  (pos + len(piece) - len(regexp_replace(piece, '^\\s+', '')))::BIGINT AS start_char,
  (pos + len(regexp_replace(piece, '\\s+$', '')))::BIGINT AS end_char, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS text
FROM o WHERE regexp_matches(piece, '\\S')""")
def chunk_recursive(spark, sf_dir):
    return chunking.chunk_recursive(documents(spark, sf_dir), "doc_id", max_words=40)


def hashed_sql(source: str, keys: str, dim: int = DIM) -> str:
    """Hashed term vectors as rows (keys, bucket, v), as the default embedder makes them (32-bit values)."""
    return f"""
SELECT {keys}, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {keys})))::FLOAT::DOUBLE AS v
FROM (SELECT {keys}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM {source}) GROUP BY ALL)
"""


SIM_SQL = f"""
s AS (SELECT doc_id, generate_subscripts(pieces, 1) - 1 AS no, unnest(pieces) AS text FROM ({sentences_sql('documents')})),
v AS ({hashed_sql('s', 'doc_id, no')}),
l AS (SELECT doc_id, no, sum(v * v) AS l FROM v GROUP BY ALL),
d AS (SELECT b.doc_id, b.no, sum(a.v * b.v) AS d FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.no = a.no + 1 AND a.bucket = b.bucket
  GROUP BY ALL),
sim AS (SELECT s.doc_id, s.no, CASE WHEN s.no > 0 THEN round(CASE WHEN lb.l * la.l > 0 THEN coalesce(d, 0.0) / sqrt(lb.l * la.l) ELSE 0.0 END, 6) END AS similarity
  FROM s LEFT JOIN d ON s.doc_id = d.doc_id AND s.no = d.no LEFT JOIN l lb ON s.doc_id = lb.doc_id AND s.no = lb.no
    LEFT JOIN l la ON s.doc_id = la.doc_id AND s.no - 1 = la.no)
"""


@query("semantic_groups", f"""WITH {SIM_SQL}
SELECT doc_id, no::INT AS sentence_no, similarity, sum(coalesce((similarity < {THRESHOLD})::INT, 0)) OVER (PARTITION BY doc_id ORDER BY no)::INT AS group_no
FROM sim""")
def semantic_groups(spark, sf_dir):
    return chunking.semantic_groups(documents(spark, sf_dir), "doc_id", threshold=THRESHOLD)


def semantic_sql(limit: int, threshold: float) -> str:
    """Greedy packing as a recursion over the sentences of all documents."""
    return f"""WITH RECURSIVE {SIM_SQL},
n AS MATERIALIZED (SELECT s.doc_id, s.no, s.text, len(regexp_extract_all(s.text, '\\S+\\s*')) AS words,
    coalesce(similarity < {threshold}, false) AS cut
  FROM s JOIN sim ON s.doc_id = sim.doc_id AND s.no = sim.no),
p AS (SELECT doc_id, no, words AS used, 0 AS chunk FROM n WHERE no = 0
  UNION ALL SELECT n.doc_id, n.no, CASE WHEN n.cut OR p.used + n.words > {limit} THEN n.words ELSE p.used + n.words END,
    p.chunk + (n.cut OR p.used + n.words > {limit})::INT
  FROM p JOIN n ON n.doc_id = p.doc_id AND n.no = p.no + 1),
c AS (SELECT p.doc_id, chunk, string_agg(n.text, '' ORDER BY p.no) AS piece
  FROM p JOIN n ON n.doc_id = p.doc_id AND n.no = p.no GROUP BY ALL),
o AS (SELECT *, coalesce(sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY chunk
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM c)
SELECT doc_id, chunk::INT AS chunk_index, (pos + len(piece) - len(regexp_replace(piece, '^\\s+', '')))::BIGINT AS start_char,
  (pos + len(regexp_replace(piece, '\\s+$', '')))::BIGINT AS end_char, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS text
FROM o"""


@query("chunk_semantic", semantic_sql(60, THRESHOLD))
def chunk_semantic(spark, sf_dir):
    return chunking.chunk_semantic(documents(spark, sf_dir), "doc_id", max_tokens=60, threshold=THRESHOLD)


CONFIG = ChunkConfig("fixed_size", chunk_size=64, overlap=16)


@query("chunk_records", f"""
SELECT sha256(doc_id::VARCHAR || '|{CONFIG.cache_key}|' || chunk_index) AS id, doc_id AS document_id, chunk_index,
  start_char, end_char, len(text)::INT AS n_chars, 'fixed_size' AS method, '{CONFIG.label}' AS config
FROM ({windows_sql(words_sql('documents'), 64, 16)})""")
def chunk_records(spark, sf_dir):
    chunks = chunking.create_chunks(documents(spark, sf_dir), CONFIG, "doc_id")
    return chunks.select("id", "document_id", "chunk_index", "start_char", "end_char", F.length("text").alias("n_chars"),
                         "method", F.col("metadata")["config"].alias("config"))


MARKED = {
    "fixed_size": (ChunkConfig("fixed_size", chunk_size=64, overlap=16), windows_sql(words_sql("documents"), 64, 16)),
    "sliding": (ChunkConfig("sliding", chunk_size=128, overlap=64), ORACLES["chunk_sliding"]),
    "sentence": (ChunkConfig("sentence"), ORACLES["chunk_sentence"]),
    "recursive": (ChunkConfig("recursive", max_tokens=40), ORACLES["chunk_recursive"]),
    "semantic": (ChunkConfig("semantic", max_tokens=60), ORACLES["chunk_semantic"]),
}


@query("chunk_marks", f"""
WITH c AS MATERIALIZED ({' UNION ALL '.join(f"SELECT '{m}' AS method, doc_id, chunk_index, start_char, end_char FROM ({sql})" for m, (_, sql) in MARKED.items())}),
n AS (SELECT doc_id, length(text) AS n FROM documents),
p AS (SELECT doc_id, i + 1 AS page_number, i * 1500 AS p0, least((i + 1) * 1500, n) AS p1 FROM n, unnest(range(0, ceil(n / 1500.0)::BIGINT)) t(i)),
s AS (SELECT doc_id, i AS section_index, i * 1000 AS s0, least((i + 1) * 1000, n) AS s1 FROM n, unnest(range(0, ceil(n / 1000.0)::BIGINT)) t(i))
SELECT method, doc_id AS document_id, chunk_index, any_value(page_number)::INT AS page_number,
  coalesce(string_agg(section_index, ',' ORDER BY section_index), '') AS sections
FROM c LEFT JOIN p ON p.doc_id = c.doc_id AND start_char >= p0 AND start_char < p1
  LEFT JOIN s ON s.doc_id = c.doc_id AND start_char < s1 AND s0 < end_char
GROUP BY method, c.doc_id, chunk_index""".replace("SELECT method, doc_id AS", "SELECT method, c.doc_id AS"))
def chunk_marks(spark, sf_dir):
    """Chunks of all five methods with their page (of 1,500 characters) and sections (of 1,000)."""
    docs = documents(spark, sf_dir)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.length("text").alias("n"))
    parts = sections.fixed_sections(sizes, "document_id", F.col("n"))
    leaves = sections.fixed_sections(sizes, "document_id", F.col("n"), 1500).withColumn("page_number", F.col("section_index") + 1).drop("section_index")
    rows = chunking.create_chunk_sets(docs, [config for config, _ in MARKED.values()], "doc_id", pages=leaves, sections=parts)
    return reduce(DataFrame.unionByName, rows).select(
        "method", "document_id", "chunk_index", "page_number", F.array_join("section_indices", ",").alias("sections"))


# ---------------------------------------------------------------- ranges

@query("chunk_pages", PAGES_SQL + f"""
, d AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
c AS ({windows_sql(words_sql('d'), 40, 8)})
SELECT c.doc_id AS document_id, chunk_index, c.start_char, c.end_char, page_number
FROM c LEFT JOIN pages p ON p.document_id = c.doc_id AND c.start_char >= p.start_char AND c.start_char < p.start_char + len(p.text)""")
def chunk_pages(spark, sf_dir):
    turns = pages(spark, sf_dir)
    rows = chunking.chunk_fixed(full_text(turns), "document_id", size=40, overlap=8).drop("text")
    return sections.with_page_numbers(rows, page_offsets(turns))


SECTIONS_SQL = f"""
WITH sec AS (SELECT doc_id, i::INT AS section_index, i * 1000 AS s0, least((i + 1) * 1000, n_chars) AS s1
  FROM (SELECT doc_id, n_chars, unnest(range(0, ceil(n_chars / 1000.0)::BIGINT)) AS i FROM documents)),
ch AS ({windows_sql(sentences_sql('documents'), 5, 1)}),
touch AS (SELECT ch.doc_id, chunk_index, section_index FROM ch JOIN sec ON ch.doc_id = sec.doc_id AND start_char < s1 AND s0 < end_char),
qrels AS (SELECT item_id, doc_id, ((instr(d.text, b.text) - 1) // 1000)::INT AS section_index
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))
"""


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_index, section_index) of sentence chunks over sections of 1,000 characters."""
    docs = documents(spark, sf_dir)
    chunks = chunking.chunk_sentences(docs, "doc_id").drop("text")
    parts = sections.fixed_sections(table(spark, sf_dir, "documents"), "doc_id", F.col("n_chars"))
    return sections.section_overlap(chunks, parts, "doc_id")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, section_index): where a document repeats a benchmark text, and in which section it starts."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = documents(spark, sf_dir)
    found = contains_text(items, docs)
    both = found.join(docs, "doc_id").join(items.withColumnRenamed("text", "wanted"), "query_id")
    at = F.instr("text", F.col("wanted"))
    return both.where(at > 0).select("query_id", "doc_id", F.floor((at - 1) / 1000).cast("int").alias("section_index"))


@query("section_overlap", SECTIONS_SQL + """
SELECT doc_id, chunk_index, array_to_string(list(section_index ORDER BY section_index), ',') AS sections
FROM touch GROUP BY doc_id, chunk_index""")
def section_overlap(spark, sf_dir):
    return touched(spark, sf_dir).groupBy("doc_id", "chunk_index").agg(
        F.array_join(F.array_sort(F.collect_set("section_index")), ",").alias("sections"))


@query("qrel_relevance", SECTIONS_SQL + """
SELECT DISTINCT item_id AS query_id, doc_id, chunk_index FROM touch JOIN qrels USING (doc_id, section_index)""")
def qrel_relevance(spark, sf_dir):
    return sections.relevant_chunks(touched(spark, sf_dir), judgements(spark, sf_dir), "doc_id")
