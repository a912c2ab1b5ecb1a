"""Near-duplicate documents by SimHash fingerprints that share blocks of bits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import ascii_words, prepare, stored, text_bytes, tidy
from assaykit.llm.components import components

# Odd multipliers that derive further 64-bit hashes of a shingle from its first one.
MIXERS = np.array([2 * ((0x9E3779B97F4A7C15 * i) % 2**63) + 1 for i in range(1, 16)], dtype=np.uint64)
BUCKET = 32


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, repeats included; a shorter text is one run, no words give none."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], 42) for i, j in spans], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set. Sums of 255 rows fit a byte, so most of it runs on bytes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """``lanes`` signed 64-bit words: a bit is 1 if it is set in over half the hashes. No hashes give zero."""
    out = []
    for lane in range(lanes):
        mixed = hashes if lane == 0 else _mix(hashes, MIXERS[lane - 1])
        ones = bit_counts(mixed) * 2 > len(hashes)
        out.append(int(np.packbits(ones, bitorder="little").view(np.int64)[0]))
    return out


def _mix(hashes: np.ndarray, by: np.uint64) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * by
    return mixed ^ (mixed >> np.uint64(32))


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3, lanes: int = 1) -> DataFrame:
    """Columns ``keep`` and ``f0 .. f{lanes-1}`` (long) for every row; the text itself goes no further."""
    source = docs.select(*keep, text_bytes(text).alias("_text"))
    schema = source.drop("_text").schema
    for lane in range(lanes):
        schema = schema.add(f"f{lane}", "long", False)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(t.as_py(), shingle), lanes) for t in batch.column("_text")],
                              dtype=np.int64).reshape(-1, lanes)
            columns = [batch.column(c) for c in keep] + [pa.array(prints[:, i]) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f"f{i}" for i in range(lanes))])

    return source.mapInArrow(tidy(kernel), schema)


def distance(left: list[Column], right: list[Column]) -> Column:
    total = F.lit(0)
    for a, b in zip(left, right, strict=True):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


def _block_key(print_: Column, blocks: int, chosen: tuple[int, ...]) -> Column:
    """Number of the chosen blocks and the bits in them, as one hash key: the fingerprint with all other bits masked."""
    width, mask = 64 // blocks, 0
    for block in chosen:
        high = 64 if block == blocks - 1 else (block + 1) * width
        mask |= (1 << high) - (1 << block * width)
    return print_.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def close_links(prints: DataFrame, max_distance: int = 2, blocks: int | None = None) -> DataFrame:
    """Links ``(a, b)`` among distinct 64-bit fingerprints ``f`` whose components are those of all pairs within the distance.

    Fingerprints are cut into ``blocks`` (default ``max_distance + 2``). A pair within the distance agrees on all of some
    ``blocks - max_distance`` of them, so rows are keyed by every such choice and joined on it; chance neighbours stay rare
    because two blocks or more must agree. Keys with one row are dropped. Up to 32 rows of a key are compared with each
    other and verified by Hamming distance. A key with more rows is not compared pairwise: within it, rows are keyed again
    by their remaining bits, unchanged and (for distances up to 2) with each single bit flipped. Two rows share such a
    pattern exactly if they differ in at most two bits, and every row is linked to the smallest one of its pattern, then
    verified: no link between components is lost and the work stays linear in the rows of the key.
    """
    if max_distance > 2:
        raise ValueError("crowded keys are handled exactly for distances up to 2")
    blocks = blocks or max_distance + 2
    choices = list(combinations(range(blocks), blocks - max_distance))
    keys = F.array(*[F.struct(F.lit(i).alias("t"), _block_key(F.col("f"), blocks, c).alias("k"))
                     for i, c in enumerate(choices)])
    rows = prints.select("f", F.explode(keys).alias("key")).select("f", "key.t", "key.k")
    crowd = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(rows.join(crowd, ["t", "k"]), "shared-blocks")

    near = shared.where(F.col("n") <= BUCKET).groupBy("t", "k").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    pairs = F.filter(
        F.flatten(F.transform("fs", lambda a: F.transform("fs", lambda b: F.struct(a.alias("a"), b.alias("b"))))),
        lambda p: (p.a < p.b) & (F.bit_count(p.a.bitwiseXOR(p.b)) <= max_distance),
    )
    few = near.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    flips = [F.col("f").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long")) for i in range(64)]
    patterns = F.array(F.col("f"), *flips)
    spread = shared.where(F.col("n") > BUCKET).select("t", "k", "f", F.explode(patterns).alias("p"))
    # a flip inside the key's own bits leaves the key: nothing else can share it
    inside = F.lit(False)
    for i, c in enumerate(choices):
        inside = inside | ((F.col("t") == i) & (_block_key(F.col("p"), blocks, c) == F.col("k")))
    spread = spread.where(inside)
    lowest = spread.groupBy("t", "k", "p").agg(F.min("f").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    many = (
        spread.join(lowest, ["t", "k", "p"])
        .where((F.col("a") < F.col("f")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("f"))) <= max_distance))
        .select("a", F.col("f").alias("b"))
    )
    return few.union(many).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_distance: int = 2) -> DataFrame:
    """One row per document: id, ``f0`` (64-bit SimHash) and ``component_id``, the smallest id reachable over links.

    Null texts count as empty; texts without words have fingerprint zero and are linked like any other. Rows with equal
    fingerprints are one node, so a huge group of copies is combined before any join. Null ids take part, with the
    component's smallest id that is not null (null if there is none). Repeated rows are returned each. Other columns of
    ``docs`` are not read.
    """
    prepare(docs.sparkSession)
    prints = stored(with_fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")), ["_id"], "_t", shingle),
                    "simhash")
    nodes = prints.groupBy(F.col("f0").alias("f")).agg(F.min("_id").alias("_low"))
    roots = components(close_links(nodes.select("f"), max_distance))
    rooted = nodes.join(roots, F.col("f") == F.col("node"), "left").select(
        "f", "_low", F.coalesce("root", "f").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("_low").alias("component_id"))
    labels = rooted.join(smallest, "root").select(F.col("f").alias("f0"), "component_id")
    return prints.join(labels, "f0").select(F.col("_id").alias(id_col), "f0", "component_id")
