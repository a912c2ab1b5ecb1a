"""Benchmark items inside documents: size-partitioned MinHash containment search, verified on exact shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import ascii_words, plain_names, prepare, text_bytes, tidy
from assaykit.llm.simhash import shingle_hashes

SHINGLE = 5
CONTAINMENT = 0.8
HASHES = 64
BLOCK_SHINGLES = 1 << 20
CHUNK_WORDS = 1 << 19
# Multipliers of the 64 permutations, from a fixed seed so that every task uses the same.
FACTORS = np.random.default_rng(20240517).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def permuted(hashes: np.ndarray, number: int) -> np.ndarray:
    mixed = hashes * FACTORS[number]
    return mixed ^ (mixed >> np.uint64(31))


class ItemIndex:
    """MinHash postings of a block of benchmark items, by shingle length and size class.

    An item of s shingles is in class ``floor(log2 s)``. Documents are cut for each class into windows of four times the
    class's lower bound, half overlapping, so that any run as long as the item lies inside one window and an item contained
    to 0.8 has a Jaccard similarity of at least 0.19 with it, however long the document is. An item and a window are
    candidates if any of 64 minima agree (bands of one row); the chance to miss such a window is about one in a million.
    """

    def __init__(self, item_ids: list, texts: list[bytes], shingle: int = SHINGLE):
        self.item_ids, self.sets = [], []
        groups: dict[tuple[int, int], list[int]] = {}
        for item_id, text in zip(item_ids, texts, strict=True):
            words = len(ascii_words(text))
            if words:
                found = np.unique(shingle_hashes(text, shingle))
                groups.setdefault((min(words, shingle), len(found).bit_length() - 1), []).append(len(self.sets))
                self.item_ids.append(item_id)
                self.sets.append(found)
        self.postings = {}
        for group, members in groups.items():
            for number in range(HASHES):
                minima = np.array([permuted(self.sets[m], number).min() for m in members], dtype=np.uint64)
                order = np.argsort(minima, kind="stable")
                self.postings[(*group, number)] = (minima[order], np.array(members)[order])
        self.groups = sorted(groups)
        self.screens: dict[tuple[int, int, int], np.ndarray] = {}

    def _screen(self, key: tuple[int, int, int]) -> np.ndarray:
        """Which last 16 bits a posting has: made where it is used, so that it is not sent along."""
        if key not in self.screens:
            screen = np.zeros(1 << 16, bool)
            screen[(self.postings[key][0] & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.screens[key] = screen
        return self.screens[key]

    def search(self, texts: list[bytes], threshold: float = CONTAINMENT) -> list[tuple[int, int, int, int]]:
        """Rows (text number, item number, shared shingles, first word of a shared one) of all verified items."""
        out = []
        for length in sorted({k for k, _ in self.groups}):
            hashes = [shingle_hashes(t, length) for t in texts]
            sizes = np.array([len(h) for h in hashes])
            if not sizes.sum():
                continue
            flat = np.concatenate(hashes)
            pairs = set()
            for level in [c for k, c in self.groups if k == length]:
                pairs |= self._candidates(flat, sizes, length, level)
            for text, item in sorted(pairs):
                shared = np.isin(self.sets[item], hashes[text])
                if shared.sum() >= threshold * len(shared):
                    first = int(np.flatnonzero(np.isin(hashes[text], self.sets[item]))[0])
                    out.append((text, item, int(shared.sum()), first))
        return sorted(out)

    def _candidates(self, flat: np.ndarray, sizes: np.ndarray, length: int, level: int) -> set[tuple[int, int]]:
        stride = 2 << level
        cells = -(-sizes // stride)
        owner = np.repeat(np.arange(len(sizes)), cells)
        ends = np.cumsum(sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
        starts = (ends - sizes)[owner] + inner * stride
        joined = np.append(owner[:-1] == owner[1:], False)
        found = set()
        for number in range(HASHES):
            minima = np.minimum.reduceat(permuted(flat, number), starts)
            following = np.append(minima[1:], np.uint64(0))
            minima = np.where(joined, np.minimum(minima, following), minima)
            keys, members = self.postings[(length, level, number)]
            maybe = np.flatnonzero(self._screen((length, level, number))[(minima & np.uint64(0xFFFF)).astype(np.int64)])
            low, high = (np.searchsorted(keys, minima[maybe], side=s) for s in ("left", "right"))
            for cell, i, j in zip(maybe, low, high, strict=True):
                found.update((int(owner[cell]), int(m)) for m in members[i:j])
        return found


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of a bounded total size (or one text), with the number of the first."""
    texts, first, size = [], 0, 0
    for row, text in enumerate(batch.column("_text")):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size > 8 * CHUNK_WORDS:
            yield first, texts
            texts, first, size = [], row + 1, 0
    if texts:
        yield first, texts


def item_blocks(items: DataFrame, item_id: str, text: str, shingle: int) -> Iterator[ItemIndex]:
    """Indexes over blocks of the items, each bounded by about a million words, one block on the driver at a time."""
    rows = items.select(F.col(item_id).alias("i"), text_bytes(text).alias("t"))
    words = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-words // (6 * BLOCK_SHINGLES)))
    for block in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).collect()
        some.sort(key=lambda r: (r.i is not None, r.i, bytes(r.t)))
        yield ItemIndex([r.i for r in some], [bytes(r.t) for r in some], shingle)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", threshold: float = CONTAINMENT,
                    shingle: int = SHINGLE) -> DataFrame:
    """One row per document and item whose distinct shingles lie in the document to ``threshold`` or more.

    Columns: document id, ``item_id``, ``n_shingles`` of the item, ``n_shared``, ``containment``, ``first_word`` (first word
    in the document of a shared shingle). Words are as in ``ascii_words``; an item of fewer words than ``shingle`` is one
    shingle of its own length. Items are searched in blocks of bounded size over all documents, whole texts, nothing is
    shuffled. Null or wordless texts contain nothing and are contained nowhere; repeated documents and items are returned
    each; null ids are kept; empty tables give no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), text_bytes(text).alias("_text"))
    id_type, item_type = source.schema["_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = (f"`{id_col}` {id_type}, item_id {item_type}, n_shingles long, n_shared long, containment double, "
              "first_word long")
    found = None
    for index in item_blocks(items, item_id, item_text, shingle):

        def kernel(batches: Iterable[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, texts in _chunks(batch):
                    rows = index.search(texts, threshold)
                    ids = batch.column("_id").take(pa.array([first + r[0] for r in rows], pa.int64()))
                    n = [len(index.sets[r[1]]) for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([index.item_ids[r[1]] for r in rows], items_type), pa.array(n, pa.int64()),
                         pa.array([r[2] for r in rows], pa.int64()),
                         pa.array([r[2] / m for r, m in zip(rows, n, strict=True)], pa.float64()),
                         pa.array([r[3] for r in rows], pa.int64())],
                        names=[id_col, "item_id", "n_shingles", "n_shared", "containment", "first_word"])

        items_type = {"bigint": pa.int64(), "int": pa.int32()}.get(item_type, pa.string())
        part = source.mapInArrow(kernel, schema)
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", threshold: float = CONTAINMENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows that contain an item, all columns as they were. Edge cases as in ``contained_items``."""
    prepare(docs.sparkSession)
    columns = docs.columns
    left, at = plain_names(docs)
    kept = left.columns
    for index in item_blocks(items, item_id, item_text, shingle):
        source = left.withColumn("_text", text_bytes(at[text]))

        def kernel(batches: Iterable[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, texts in _chunks(batch):
                    keep[[first + r[0] for r in index.search(texts, threshold)]] = False
                yield batch.select(kept).filter(pa.array(keep))

        left = source.mapInArrow(tidy(kernel), left.schema)
    return left.toDF(*columns)
