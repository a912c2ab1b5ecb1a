"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import (
    centroids, chat, decontam, elias_fano, graph_search, langid, licenses, pfair, secrets, simhash, suffix_tree, whiten, winnow,
)
from assaykit.llm.common import ORACLES, PLANS
from assaykit.session import fresh_path

Plan = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.mix(docs)


@query("op6_token_output")
def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-segments")
    elias_fano.write_segments(table(spark, sf_dir, "documents"), path, bpe_path())
    return elias_fano.read_documents(spark, path)


@query("op7_simhash")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+')"


@query("op4_benchmark_leaks", rf"""
WITH d AS (SELECT doc_id, {WORDS} w FROM documents),
i AS (SELECT item_id, {WORDS} w FROM benchmark),
cut AS (SELECT item_id, w, least(5, len(w)) k FROM i WHERE len(w) > 0),
grams AS (SELECT item_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2),
    lambda x: array_to_string(w[x:x + k - 1], ' ')))) s FROM cut),
sizes AS (SELECT item_id, count(*) n FROM grams GROUP BY 1),
places AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') s
    FROM d, (SELECT DISTINCT k FROM cut) ks, unnest(range(1, len(w) - k + 2)) t(p)),
hits AS (SELECT doc_id, item_id, count(DISTINCT s) n_shared, min(p) - 1 first_word
    FROM places JOIN grams USING (k, s) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment, first_word
FROM hits JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n
""")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_line_dedup", r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
w AS (SELECT doc_id, i, ls[i:i + 1] c FROM l, unnest(range(1, len(ls))) t(i)
    WHERE trim(ls[i], ' ') <> '' OR trim(ls[i + 1], ' ') <> ''
    UNION ALL SELECT doc_id, i, [ls[i]] c FROM l, unnest(range(1, len(ls) + 1)) t(i)
    WHERE len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) >= 50),
again AS (SELECT doc_id, i, len(c) k, row_number() OVER (PARTITION BY c ORDER BY doc_id, i) r FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) n FROM again WHERE r > 1),
island AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) g FROM gone),
runs AS (SELECT doc_id, min(n) a, max(n) b, count(*) m FROM island GROUP BY doc_id, g),
per AS (SELECT doc_id, sum(m)::BIGINT n_removed, string_agg((a - 1) || '-' || (b - 1), ',' ORDER BY a) removed_runs
    FROM runs GROUP BY 1),
lines AS (SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) n FROM l),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) t FROM lines ANTI JOIN gone USING (doc_id, n) GROUP BY 1)
SELECT l.doc_id, len(ls) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_runs, '') AS removed_runs,
    md5(coalesce(t, '')) AS kept_md5
FROM l LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return winnow.without_repeats(docs).select("doc_id", "n_lines", "n_removed", "removed_runs",
                                               F.md5("kept_text").alias("kept_md5"))


@query("op9_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.array_distinct(F.transform("places", lambda p: p.label))
    words = F.transform("places", lambda p: p.word)
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "found")), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("coverage")).alias("score"))


@query("op10_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = F.filter("spans", lambda s: s.kind != "model")
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"),
                        secrets.listed("spans").alias("spans"))


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s.kind == kind)


@query("op2_suffix_tree")
def suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


@query("op5_graph_search")
def graph_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op1_page_language")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = langid.learn_profiles(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), profiles, ["page_id"], F.col("html"), langid.host_of(F.col("url")),
                           langid.declared_in(F.col("html")), markup=True)


@query("op11_whiten_embeddings")
def whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def _clusters_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """The rounds one after the other: distances of all vectors to all centroids, then the floor of each mean."""
    steps = [f"""
WITH v AS (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) q
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 k, q c FROM v ORDER BY k LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT r, vec_id, any_value(q) q, min(struct_pack(d := list_sum(list_transform(list_zip(q, c),
    lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k := k)) m FROM v, c{i} GROUP BY r, vec_id)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT m.k k, p, sum(q[p])::BIGINT s, count(*) n FROM a{i}, range(1, 65) t(p) GROUP BY 1, 2),
m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) c FROM s{i} GROUP BY 1),
c{i + 1} AS (SELECT k, coalesce(m.c, o.c) c FROM c{i} o LEFT JOIN m{i} m USING (k))""")
    return ",".join(steps) + f"""
SELECT vec_id, m.k::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.k)::BIGINT AS cluster_inertia,
    sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = m.k"""


@query("op12_cluster_embeddings", _clusters_sql())
def cluster_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query("op13_format_chats", r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') learned,
    sum(23 + length(regexp_replace(role, '<\|(\**)(turn|text|end)\|>', '<|*\1\2|>', 'g'))
        + length(regexp_replace(text, '<\|(\**)(turn|text|end)\|>', '<|*\1\2|>', 'g')))::BIGINT formatted_chars
    FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
    formatted_chars FROM g
""")
def format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(planted.columns).unionAll(planted)
    chats = chat.format_chats(chat.canonical_turns(chat.gather(rows)))
    read = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                        chat.read_turns(F.col("formatted")).alias("turns"),
                        F.array_join(chat.learned_texts(F.col("formatted"), F.col("loss_mask")), "").alias("learned"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       "formatted_chars")
