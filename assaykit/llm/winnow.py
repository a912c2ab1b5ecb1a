"""Repeated runs of lines, found through winnowed line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import plain_names, stored

WINDOW, LONG_WORDS = 2, 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _is_long(line: Column, words: int) -> Column:
    """Has the line so many words (runs of anything but space and \\x09-\\x0D)? Short lines are told by their length."""
    parts = F.filter(F.split(line, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return F.when(F.length(line) >= 2 * words - 1, F.size(parts) >= words).otherwise(F.lit(False))


def _windows(window: int) -> Column:
    """Per window of ``window`` line hashes ``h``: start, hash of its content, least hash, and where that one stands (last of ties).

    Windows of blank lines only are left out: they are not a repeat of anything. A long line (``l``) is a window of its own too.
    """
    # both arrays are also used outside the lambda: Catalyst would otherwise work them out again for every window
    numbers = F.when((F.size("b") >= window) & (F.size("h") >= window), F.sequence(F.lit(0), F.size("h") - window)).otherwise(
        F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        part = F.slice("h", i + 1, window)
        low = F.array_min(part)
        last = window - F.array_position(F.reverse(part), low)
        return F.struct(i.alias("i"), F.lit(window).alias("n"), F.xxhash64(part).alias("content"), low.alias("f"),
                        (i + last).cast("int").alias("p"), F.exists(F.slice("b", i + 1, window), lambda x: ~x).alias("written"))

    several = F.filter(F.transform(numbers, one), lambda x: x.written)
    if window == 1:
        return several
    alone = F.filter(F.transform("h", lambda h, i: F.when(F.element_at("l", i + 1), F.struct(
        i.alias("i"), F.lit(1).alias("n"), F.xxhash64(F.array(h)).alias("content"), h.alias("f"), i.alias("p"), F.lit(True).alias("written")))),
        lambda x: x.isNotNull())
    return F.concat(several, alone)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                   long_words: int = LONG_WORDS) -> DataFrame:
    """Per document with something to delete: ``_id``, ``_h`` (hash of its text) and ``removed``, line numbers from 0 in order.

    Each window of line hashes contributes its least hash as a fingerprint, so two equal runs of ``window`` lines or more
    always share one at the same place. Fingerprints that stand at one position only are dropped before anything else is
    joined. The windows behind the others are joined on their content with the earliest position of it, and windows that
    overlap on a match extend it both ways: together they cover exactly the lines of runs of ``window`` lines or more, and the
    single lines of ``long_words`` words or more, that occurred at an earlier position, in the order of (id, hash of the text, line
    number). Minima are combined before the
    shuffle and a content is joined with one earliest position, so a line in a third of all documents makes no pairs.
    """
    hashed = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"),
        F.transform(_lines(F.col(text)), lambda x: F.xxhash64(x)).alias("h"),
        F.transform(_lines(F.col(text)), lambda x: F.trim(x) == "").alias("b"),
        F.transform(_lines(F.col(text)), lambda x: _is_long(x, long_words)).alias("l"),
    )
    windows = hashed.select("_id", "_h", _windows(window).alias("w"))
    windows = stored(windows.distinct(), "line-windows")
    marks = windows.select(F.explode(F.array_distinct(F.transform("w", lambda x: F.struct(x.p, x.f)))).alias("m"))
    common = marks.groupBy(F.col("m.f").alias("f")).agg(F.count("*").alias("n")).where("n > 1").select("f")
    places = windows.select("_id", "_h", F.explode("w").alias("w")).select("_id", "_h", "w.i", "w.n", "w.content", "w.f")
    places = places.join(common, "f", "left_semi").select("_id", "_h", "i", "n", "content")
    at = F.struct("_id", "_h", "i")
    earliest = places.groupBy("content").agg(F.min(at).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = places.join(earliest.select("content", "first"), "content").where(at > F.col("first"))
    starts = later.groupBy("_id", "_h").agg(F.collect_set(F.struct("i", "n")).alias("starts"))
    lines = F.flatten(F.transform("starts", lambda s: F.sequence(s.i, s.i + s.n - 1)))
    return starts.select("_id", "_h", F.array_sort(F.array_distinct(lines)).alias("removed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                    long_words: int = LONG_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with ``kept_text``, ``n_lines``, ``n_removed`` and ``removed_runs`` ("0-2,7-8").

    A run of ``window`` lines or more that stood earlier goes, and so does a single line of ``long_words`` words or more. Lines end
    at \\n and are compared exactly; blank lines count inside a run but a run of blank lines alone is no repeat. A
    null text is one empty line and ``kept_text`` is empty. Rows with the same id and text are one document: they do not
    repeat each other and get the same result. Null ids come first in the order. A document whose lines all go has an empty
    ``kept_text``. Existing columns of these names are replaced. An empty table gives an empty table.
    """
    added = ["kept_text", "n_lines", "n_removed", "removed_runs"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in added])
    plain, at = plain_names(base)
    body = F.coalesce(at[text], F.lit(""))
    gone = repeated_lines(docs, id_col, text, window, long_words)
    rows = plain.withColumn("_t", F.xxhash64(body)).join(
        gone, F.col(at[id_col]).eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h")), "left")
    rows = rows.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>"))).withColumn(
        "_lines", _lines(F.col(at[text])))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "removed")
    text_left = F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i + 1)), "\n")
    first = F.array_except("removed", F.transform("removed", lambda i: i + 1))
    last = F.array_except("removed", F.transform("removed", lambda i: i - 1))
    runs = F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda r: F.concat_ws("-", r.a, r.b))
    return rows.select(
        *plain.columns, F.when(F.size("removed") == 0, body).otherwise(text_left), F.size("_lines").cast("long"),
        F.size("removed").cast("long"), F.array_join(runs, ",")).toDF(*base.columns, *added)
