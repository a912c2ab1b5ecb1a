"""Language of documents: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import plain_names, prepare, row_key, stored, text_bytes, tidy
from assaykit.operators.hotkeys import fits_broadcast, spread_join

CODES = 1 << 16
TEMPER = 0.25
HOST_WEIGHT = 10.0
MAX_LANGUAGES = 200
MIN_POSTERIOR = 0.5
UNKNOWN = "und"
# Likelihoods hold this share of a uniform one, so that a rare trigram weighs no more the larger the corpus is.
UNIFORM = 0.05
# A text of none of the languages: this many nats a trigram less likely than the languages' own texts, in one text of a hundred.
STRANGE_NATS, STRANGE_SHARE = 3.5, 0.01

# Letters keep a class of their own (A-Z as a-z, bytes beyond ASCII as they are); everything else is one separator.
CLASSES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def trigram_codes(text: bytes) -> np.ndarray:
    """Hashed codes of all runs of three bytes that hold a letter."""
    x = CLASSES[np.frombuffer(text, np.uint8)]
    x = np.concatenate([[32], x, [32]]).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    a, b, c = x[:-2], x[1:-1], x[2:]
    mixed = ((a << np.uint32(16)) | (b << np.uint32(8)) | c) * np.uint32(2654435761)
    return (mixed >> np.uint32(16))[(a != 32) | (b != 32) | (c != 32)].astype(np.int64)


_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def page_text(page: str) -> str:
    """Text of a web page: scripts, styles, comments and tags out, entities resolved."""
    return html.unescape(_DROP.sub(" ", page))


class Profiles:
    """Log likelihood of each trigram code in each language, smoothed by half a count, and the languages' shares.

    ``background`` is the log likelihood a trigram has in a text that only looks like the language: ``STRANGE_NATS`` below what the
    language's own texts reach on average, which its counts tell.
    """

    def __init__(self, languages: list[str], counts: np.ndarray, texts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.logs = np.log((1 - UNIFORM) * smooth / smooth.sum(1, keepdims=True) + UNIFORM / CODES)
        own = (counts / np.maximum(1, counts.sum(1, keepdims=True)) * self.logs).sum(1)
        self.background = np.where(counts.sum(1) > 0, own - STRANGE_NATS, -1e300)
        self.prior = np.log((texts + 1) / (texts.sum() + len(texts)))

    def likelihoods(self, text: bytes) -> tuple[np.ndarray, int]:
        codes = trigram_codes(text)
        # neighbouring trigrams overlap, so each counts for a quarter of an independent one
        return TEMPER * self.logs[:, codes].sum(1), len(codes)


def learn_profiles(labelled: DataFrame, lang: str = "lang", text: str = "text") -> Profiles:
    """Trigram counts of every labelled text, whole. Rows without a label are left out; at most ``MAX_LANGUAGES`` labels.

    Without any labelled row the only language is 'und'.
    """
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.lower(lang).alias("lang"), text_bytes(text).alias("_text"))
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(shares) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = shares or {UNKNOWN: 0}
    languages = sorted(shares)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            codes: dict[str, list[np.ndarray]] = {}
            for name, cell in zip(batch.column("lang").to_pylist(), batch.column("_text"), strict=True):
                codes.setdefault(name, []).append(trigram_codes(cell.as_py()))
            for name, found in codes.items():
                total = totals.setdefault(name, np.zeros(CODES, np.int64))
                for i in range(0, len(found), 256):
                    total += np.bincount(np.concatenate(found[i : i + 256]), minlength=CODES)
        for name, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(total[seen])],
                                             names=["lang", "code", "n"])

    counts = np.zeros((len(languages), CODES), np.int64)
    summed = rows.mapInArrow(tidy(kernel), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    where = summed["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
    counts[where, summed["code"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return Profiles(languages, counts, np.array([shares[x] for x in languages]))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def site_of(host: Column) -> Column:
    """The last two labels of a host: what hosts of one owner share."""
    return F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))


def declared_in(page: Column) -> Column:
    """First two or three letters of the lang attribute of the html element."""
    found = F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.nullif(F.lower(found), F.lit(""))


def read_likelihoods(rows: DataFrame, profiles: Profiles, markup: bool) -> DataFrame:
    """Stored once per row: ``row`` key, log likelihoods ``ll`` and trigrams ``n_grams``; the text goes no further."""
    keep = [c for c in rows.columns if c != "_text"]
    source = rows.withColumn("_text", F.coalesce("_text", F.lit("")))

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.likelihoods((page_text(c.as_py()) if markup else c.as_py()).encode()) for c in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([x.tolist() for x, _ in found], pa.list_(pa.float64())),
                 pa.array([n for _, n in found], pa.int64())], names=[*keep, "ll", "n_grams"])

    schema = rows.select(*keep).schema.add("ll", T.ArrayType(T.DoubleType())).add("n_grams", "long")
    return stored(source.mapInArrow(tidy(kernel), schema).withColumn("row", row_key()), "language-likelihoods")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    odds = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))


def _sums(size: int) -> list[Column]:
    return [F.sum(F.col("p")[i]) for i in range(size)]


def fuse(read: DataFrame, profiles: Profiles) -> DataFrame:
    """Adds ``posterior`` to rows with ``ll``, ``_host``, ``_site``, ``_suffix`` and ``_declared``.

    Each row's text posterior ``p`` under the global shares is summed by host, site, declared language and suffix: aggregates
    combined before the shuffle. A host's prior shrinks to its site's and that to the global one, each by ``HOST_WEIGHT``
    rows; a row's own ``p`` is taken out of its host and site first, so it never votes for itself. Declared language and suffix
    are evidence by how often each value goes with each language. A missing value is no evidence.
    """
    size = len(profiles.languages)
    prior = F.array(*[F.lit(float(x)) for x in profiles.prior])
    rows = read.withColumn("p", _softmax(F.zip_with("ll", prior, lambda a, b: a + b)))
    total = [x or 0.0 for x in rows.agg(*_sums(size)).first()]
    share = F.array(*[F.lit((x + 1) / (sum(total) + size)) for x in total])

    def by(key: str, name: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*_sums(size)).alias(name), F.count("*").alias(f"{name}_n"))

    def joined(left: DataFrame, small: DataFrame, key: str) -> DataFrame:
        return spread_join(left, small, [key], small_fits=fits_broadcast(small), spread_by=F.col("row"), how="left")

    out = joined(joined(rows, by("_host", "_h"), "_host"), by("_site", "_s"), "_site")
    totals = F.array(*[F.lit(x) for x in total])
    for key, name in (("_declared", "_d"), ("_suffix", "_x")):
        values = max(1, rows.select(F.approx_count_distinct(key)).first()[0])
        seen = by(key, name).drop(f"{name}_n")
        out = joined(out, seen.select(key, _value_weight(name, totals, float(values)).alias(name)), key)

    site = _shrunk("_s", "_s_n", share)
    host = _shrunk("_h", "_h_n", F.col("_site_prior"))
    out = out.withColumn("_site_prior", F.when(F.col("_s").isNull(), share).otherwise(site))
    out = out.withColumn("_host_prior", F.when(F.col("_h").isNull(), F.col("_site_prior")).otherwise(host))
    none = F.array(*[F.lit(0.0)] * size)
    logs = F.zip_with("ll", F.transform("_host_prior", lambda x: F.log(F.greatest(x, F.lit(1e-12)))), lambda a, b: a + b)
    for name in ("_d", "_x"):
        logs = F.zip_with(logs, F.coalesce(name, none), lambda a, b: a + b)
    return out.withColumn("_logs", logs).withColumn("posterior", _softmax(F.col("_logs")))


def _value_weight(name: str, totals: Column, values: float) -> Column:
    return F.zip_with(name, totals, lambda a, b: F.log((a + 1.0) / (b + values)))


def _shrunk(counts: str, n: str, towards: Column) -> Column:
    """(count without the row itself + weight * prior) / (rows without itself + weight), language by language."""
    rest = F.zip_with(counts, F.col("p"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return F.zip_with(rest, towards, lambda a, b: (a + HOST_WEIGHT * b) / (F.col(n) - 1 + HOST_WEIGHT))


def identify(rows: DataFrame, profiles: Profiles, keep: list[str], text: Column, host: Column | None = None,
             declared: Column | None = None, markup: bool = False, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Columns ``keep`` with ``host``, ``suffix``, ``declared``, ``text_language``, ``language`` and ``confidence``.

    ``language`` is 'und' if the text has no letters, if a background model explains it better than the language whose text it
    looks like most, or if no language reaches ``min_posterior``; ``text_language`` is what the text alone says. Every row is read whole and returned once, repeated rows too. Null texts are empty; a null or odd host,
    suffix or declared value counts as missing. Names in ``keep`` may not be one of the columns added. An empty table gives an
    empty table.
    """
    prepare(rows.sparkSession)
    none = F.lit(None).cast("string")
    base = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text.cast("string").alias("_text"),
                       (none if host is None else host.cast("string")).alias("_host"),
                       (none if declared is None else F.lower(declared.cast("string"))).alias("_declared"))
    base = base.withColumn("_site", site_of(F.col("_host"))).withColumn("_suffix", suffix_of(F.col("_host")))
    found = fuse(read_likelihoods(base, profiles, markup), profiles)
    names = F.array(*[F.lit(x) for x in profiles.languages])

    def best(p: str) -> Column:
        return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))

    logs = F.zip_with("ll", F.array(*[F.lit(float(x)) for x in profiles.prior]), lambda a, b: a + b)
    background = F.element_at(F.array(*[F.lit(float(x)) for x in profiles.background]), F.array_position(logs, F.array_max(logs)).cast("int"))
    strange = F.lit(math.log(STRANGE_SHARE)) + TEMPER * F.col("n_grams") * background > F.array_max(logs)
    letters = (F.col("n_grams") > 0) & ~strange
    sure = letters & (F.array_max("posterior") >= min_posterior)
    return found.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("_host").alias("host"), F.col("_suffix").alias("suffix"),
        F.col("_declared").alias("declared"), F.when(letters, best("p")).otherwise(UNKNOWN).alias("text_language"),
        F.when(sure, best("posterior")).otherwise(UNKNOWN).alias("language"),
        F.when(letters, F.array_max("posterior")).otherwise(0.0).alias("confidence"))


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                    min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """``docs`` without rows whose language stays 'und', all columns as they were.

    The likelihoods are learned from the labels in ``lang``; the same label is each row's declared language and ``source`` its
    host. Edge cases as in ``identify``.
    """
    plain, at = plain_names(docs)
    found = identify(plain, learn_profiles(plain, at[lang], at[text]), plain.columns, F.col(at[text]), F.col(at[source]),
                     F.col(at[lang]), min_posterior=min_posterior)
    return found.where(F.col("language") != UNKNOWN).select(*plain.columns).toDF(*docs.columns)
