"""Page text: running character offsets and whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.hotkeys import running_total

# A row's value holds up to 2 GiB of bytes, and a character can take four.
MAX_CHARS = 1 << 29


def page_offsets(pages: DataFrame, doc: str = "document_id", page: str = "page_number", text: str = "text",
                 separator: int = 1) -> DataFrame:
    """Add start_char and end_char of each page in the document's full text (one separator between pages).

    Only lengths travel through the shuffles of the running sum; the text is joined back on the unique page key.
    """
    lengths = pages.select(doc, page, F.length(text).cast("long").alias("_len"))
    placed = running_total(lengths, doc, page, F.col("_len") + separator, "start_char")
    return placed.withColumn("end_char", F.col("start_char") + F.col("_len")).drop("_len")


def full_text(pages: DataFrame, doc: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """One row per document: (doc, text), its pages in order with one newline between them.

    A document is one value and has to fit a row; beyond ``MAX_CHARS`` characters the query fails with a message that says so.
    """
    whole = F.sum(F.length(text).cast("long") + 1)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    fits = F.assert_true(F.col("_n") <= MAX_CHARS, F.lit(f"a document has more than {MAX_CHARS} characters"))
    return pages.groupBy(doc).agg(ordered.alias("_p"), whole.alias("_n")).select(
        doc, F.when(fits.isNull(), F.array_join("_p.t", "\n")).alias("text"))
