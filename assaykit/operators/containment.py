"""Which texts hold which items as a run of words: one pass over the documents with all items at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.hooks import word_array, words_of
from assaykit.operators.hotkeys import driver_blocks
from assaykit.session import ship_package

ANCHOR = 6
ITEM_WORDS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class RunMatcher:
    """Finds every item, a list of words, in lists of words.

    Words of a batch and of the items get common numbers, so runs compare as arrays of numbers. A rolling hash over the first
    ``ANCHOR`` words (all of a shorter item) is looked up in the sorted hashes of the items' anchors; a position that meets one is
    compared with the whole item, word by word.
    """

    def __init__(self, items: pa.ListArray, anchor: int = ANCHOR):
        sizes = pc.list_value_length(items).to_numpy().astype(np.int64)
        flat = items.flatten().dictionary_encode()
        self.terms, self.codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        # a number per term, spread over 64 bits; the hash of a run is a polynomial in them
        self.values = (np.arange(1, len(self.terms) + 1, dtype=np.uint64) * _BASE) ^ (np.arange(1, len(self.terms) + 1, dtype=np.uint64) << np.uint64(40))
        self.anchors = {}
        for length in np.unique(np.minimum(sizes, anchor)).tolist():
            mine = np.flatnonzero(np.minimum(sizes, anchor) == length)
            hashes = self._rolled(self.values[self.codes], length)[self.starts[mine]]
            order = np.argsort(hashes, kind="stable")
            self.anchors[length] = hashes[order], mine[order]

    @staticmethod
    def _rolled(values: np.ndarray, length: int) -> np.ndarray:
        """Hash of the run of ``length`` values at each position where one fits."""
        total = np.zeros(max(0, len(values) - length + 1), np.uint64)
        for j in range(length):
            total = total * _BASE + values[j : j + len(total)]
        return total

    def match(self, texts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item) numbers."""
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
        flat = texts.flatten().dictionary_encode()
        if not len(flat) or not len(self.sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = pc.fill_null(pc.index_in(flat.dictionary, value_set=self.terms), -1).to_numpy().astype(np.int64)
        codes = known[flat.indices.to_numpy()]
        values = np.where(codes >= 0, self.values[codes], np.uint64(0))
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        pairs = []
        for length, (hashes, items) in self.anchors.items():
            rolled = self._rolled(values, length)
            lo = np.searchsorted(hashes, rolled, "left")
            at = np.flatnonzero((lo < len(hashes)) & (hashes[np.minimum(lo, len(hashes) - 1)] == rolled))
            counts = np.searchsorted(hashes, rolled[at], "right") - lo[at]
            place = np.repeat(at, counts)
            item = items[np.repeat(lo[at] - (np.cumsum(counts) - counts), counts) + np.arange(len(place))]
            fits = place + self.sizes[item] <= ends[text_of[place]]
            place, item = place[fits], item[fits]
            # word by word over all that is left, one word of each at a time
            offset = 0
            while offset < (self.sizes[item].max() if len(item) else 0):
                more = self.sizes[item] > offset
                same = ~more
                same[more] = codes[place[more] + offset] == self.codes[self.starts[item[more]] + offset]
                place, item, offset = place[same], item[same], offset + 1
            pairs.append(text_of[place] * len(self.sizes) + item)
        found = np.unique(np.concatenate(pairs))
        return found // len(self.sizes), found % len(self.sizes)


def contains_text(items: DataFrame, docs: DataFrame, item: str = "query_id", doc: str = "doc_id", text: str = "text",
                  anchor: int = ANCHOR, item_words: int = ITEM_WORDS) -> DataFrame:
    """Rows (item, doc) where the item's words occur as one run in the document's words.

    Documents are read once and stay where they are; each row of the result is verified in the task that reads the document. The
    items go to the tasks as a measured broadcast; more than ``item_words`` words of them go in several blocks, a pass each.
    Items and documents without words match nothing.
    """
    spark = docs.sparkSession
    ship_package(spark)
    schema = T.StructType([T.StructField(item, items.schema[item].dataType), T.StructField(doc, docs.schema[doc].dataType)])
    wanted = items.select(item, words_of(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    parts = []
    for block in driver_blocks(wanted, F.size("_w"), item_words):
        block = block.combine_chunks()
        shared = spark.sparkContext.broadcast((block.column(item).combine_chunks(), block.column("_w").combine_chunks()))
        parts.append(docs.select(doc, text).mapInArrow(_matcher(shared, anchor, schema.names), schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _matcher(shared, anchor: int, names: list[str]):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists = shared.value
        matcher = RunMatcher(lists, anchor)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                text, found = matcher.match(word_array(part.column(1)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(found)), part.column(0).take(pa.array(text))], names=names)

    return kernel
