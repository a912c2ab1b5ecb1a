"""Near copies by the Jaccard similarity of shingle sets: SimHash and MinHash bands propose pairs, the whole texts decide."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from assaykit.llm.common import ascii_words, discard, plain_names, prepare, row_key, stored, text_bytes, tidy
from assaykit.llm.components import components
from assaykit.llm.simhash import near_duplicates
from assaykit.operators.hotkeys import fits_broadcast

# Two sets of similarity 0.8 share none of 25 bands of 5 values with probability (1 - 0.8^5)^25 = 5 in 100,000.
BANDS, ROWS = 25, 5
CROWD = 8
# A pair of 0.8 has 100 of 125 values in common, give or take 4.5, and fewer than 78 once in a million times.
LEAST_COMMON = 78
KNOWN_WORDS = 200_000
CHUNK = 4096


class _WordHashes(dict):
    """Hash of each word met. Starts anew when full: it only saves hashing a word again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 42)
        return found


def _odd(count: int, seed: int, bits: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << (bits - 1), count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """The distinct runs of ``size`` words as sorted 64-bit hashes; a shorter text is one run, a text without words has none."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    count, length = max(1, len(words) - size + 1), min(size, len(words))
    total = np.full(count, length, np.uint64)
    for j, by in enumerate(_odd(size, 1, 64)[:length]):
        total += (each[j : j + count] ^ (each[j : j + count] >> np.uint64(31))) * by
    total = (total ^ (total >> np.uint64(32))) * _odd(1, 2, 64)
    return np.unique(total ^ (total >> np.uint64(29)))


def min_hashes(shingles: np.ndarray, level: int) -> np.ndarray:
    """``BANDS`` times ``ROWS`` MinHash values; every level has values of its own."""
    by = _odd(BANDS * ROWS, 10 + level, 32).astype(np.uint32)[:, None]
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    lows = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for lo in range(0, len(short), CHUNK):
        np.minimum(lows, (short[None, lo : lo + CHUNK] * by).min(1), out=lows)
    return lows


def band_keys(lows: np.ndarray) -> np.ndarray:
    """A key for each band of ``ROWS`` values."""
    key = (lows.astype(np.uint64).reshape(BANDS, ROWS) * _odd(BANDS * ROWS, 3, 64).reshape(BANDS, ROWS)).sum(1, dtype=np.uint64)
    key = (key ^ (key >> np.uint64(32))) * _odd(BANDS, 4, 64)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def sketch(lows: np.ndarray) -> bytes:
    """One byte of each value: enough to tell how many two sets have in common."""
    return ((lows * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def with_keys(docs: DataFrame, text: str, shingle: int, level: int) -> DataFrame:
    """All columns of ``docs`` with ``s0``, ``s1`` (hash of the set of shingles), ``n`` (its size), ``keys`` (none without words) and
    ``sketch``."""
    source = docs.withColumn("_text", text_bytes(text))
    schema = source.drop("_text").schema.add("s0", "long").add("s1", "long").add("n", "long").add("keys", ArrayType(LongType())).add("sketch", "binary")
    names = schema.names

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle, hashes) for t in batch.column("_text")]
            print_ = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
            lows = [min_hashes(s, level) for s in sets]
            keys = [band_keys(x) if len(s) else np.zeros(0, np.int64) for s, x in zip(sets, lows, strict=True)]
            columns = [*batch.columns[:-1], pa.array(print_[:, 0]), pa.array(print_[:, 1]),
                       pa.array(np.array([len(s) for s in sets], np.int64)), _lists(keys), pa.array(map(sketch, lows), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(tidy(kernel), schema)


def likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs ``(a, b)`` whose sketches have ``LEAST_COMMON`` values in common, stored: all of 0.8 but one in a million.

    Two hundredths of a text's size are compared instead of the text, and strangers that share a passage go.
    """
    some = texts.select("row", "sketch")
    both = pairs.distinct().join(some.select(F.col("row").alias("b"), F.col("sketch").alias("sb")), "b").join(
        some.select(F.col("row").alias("a"), F.col("sketch").alias("sa")), "a").select("a", "b", "sa", "sb")

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
            keep = pa.array((left == right).sum(1) >= LEAST_COMMON)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return stored(both.mapInArrow(tidy(kernel), "a long, b long"), "near-pairs")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Pairs ``(a, b)`` of rows whose sets of shingles have a Jaccard similarity of 0.8 or more, on their whole texts.

    ``texts`` has ``row``, ``t`` and ``sketch``. What the sketches leave is compared by the texts, which compress in the shuffle as
    hashes do not.
    """
    pairs = likely(pairs, texts)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    some = texts.select("row", "t").join(wanted, "row", "left_semi")
    both = pairs.join(some.select(F.col("row").alias("b"), F.col("t").alias("tb")), "b").join(
        some.select(F.col("row").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, left = _WordHashes(), None, None
        for batch in batches:
            close = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if a != last:  # rows of one a follow each other
                    last, left = a, shingle_set(ta.as_py(), shingle, hashes)
                right = shingle_set(tb.as_py(), shingle, hashes)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                close.append(5 * shared >= 4 * (len(left) + len(right) - shared))
            keep = pa.array(close, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    links = stored(both.mapInArrow(tidy(kernel), "a long, b long"), "near-links")
    discard(pairs)
    return links


def _may_reach(left: Column, right: Column, sizes: Column) -> Column:
    """Whether sets of ``sizes`` values in all, of which ``left`` and ``right`` at most can be common ones, may have a similarity of 0.8."""
    return 9 * F.least(left, right) >= 4 * sizes


def _in_common(keys: DataFrame) -> DataFrame:
    """The rows of keys that several nodes have, with ``low``, the node of each key with the least ``own`` (the smallest of these), and ``c``, their number."""
    keys = keys.select("k", F.struct("own", "node", "n", "rest").alias("v")).repartition("k")  # the counts and the join read one shuffle
    low = keys.groupBy("k").agg(F.min("v").alias("low"), F.count("*").alias("c")).where("c > 1")
    return stored(keys.join(low.hint("merge"), "k").select("k", "v.*", "low", "c"), "near-keys")


def prefix_keys(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, n, own, k, rest): the rarest shingles of each of ``nodes`` (node, n), one of which any pair of 0.8 has in common.

    Shingles are ordered by the number of ``nodes`` that have them, then by hash. Two sets of 0.8 share four fifths of either, so the first
    shingle they share is among the first ``n // 5 + 1`` of both; ``rest``, the shingles from it on, bounds what they share. Shingles of one
    node (``own`` of them) come first and are shared by no pair: they use the places up and need no rows. A text with more than a fifth of them has none.
    """
    source = texts.select("row", "t").join(nodes.select(F.col("node").alias("row")), "row", "left_semi")

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle, hashes) for t in batch.column("t")]
            sizes = pa.array(np.array([len(s) for s in sets], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row"), sizes, _lists([s.view(np.int64) for s in sets])], names=["node", "n", "s"])

    each = source.mapInArrow(tidy(kernel), "node long, n long, s array<long>").select(F.explode("s").alias("k"), F.struct("node", "n").alias("v"))
    each = each.repartition("k")  # as in _in_common
    seen = each.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("k", "c")
    rare = each.join(seen.hint("merge"), "k").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("c", "k"))).alias("s")).select("v.*", "s")
    own = (F.col("n") - F.size("s")).cast("long")
    places = F.greatest(F.floor(F.col("n") / 5) + 1 - own, F.lit(0)).cast("int")
    first = rare.select("node", "n", own.alias("own"), F.posexplode(F.slice("s", F.lit(1), places)).alias("at", "v"))
    return first.select("node", "n", "own", "v.k", (F.col("n") - F.col("own") - F.col("at")).alias("rest"))


def simhash_links(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Stored links ``(a, b)`` of 0.8 and more among ``nodes`` that their SimHash fingerprints propose.

    Each node is compared with the smallest one of its class of fingerprints. Texts that differ in a word or two meet here.
    """
    some = texts.select("row", "t").join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    found = near_duplicates(some, "row", "t").where(F.col("row") != F.col("component_id"))
    return verified(found.select(F.col("component_id").alias("a"), F.col("row").alias("b")), texts, shingle)


def _joined(keys: DataFrame, texts: DataFrame, shingle: int, links: list[DataFrame], most: int | None) -> DataFrame:
    """Add to ``links`` those among nodes that share a key, keys of more than ``most`` rows by one node only.

    ``keys`` has (node, n, own, k, rest). First each node is compared with the ``low`` one of its key, the text that has least alone, which
    joins most of a group of copies without making pairs of it. A key that still holds several components is compared in full, but for pairs of one
    component. Returns the stored rows of such keys.
    """
    shared = _in_common(keys)
    first = shared.where((F.col("node") != F.col("low.node")) & _may_reach(F.col("rest"), F.col("low.rest"), F.col("n") + F.col("low.n")))
    first = first.select(F.col("low.node").alias("a"), F.col("node").alias("b"))
    links.append(verified(first.join(_all(links), ["a", "b"], "left_anti") if links else first, texts, shingle))
    roots = components(_all(links))
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("k")
    rooted = stored(rooted.join(mixed, "k"), "near-mixed")
    discard(shared)
    few = rooted if most is None else rooted.where(F.col("c") <= most)
    left, right = (few.select("k", F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("rest").alias(f"{x}rest"),
                              F.col("root").alias(f"{x}r"), F.col("low.node").alias(f"{x}low")) for x in "ab")
    found = left.join(right.drop("blow"), "k").where(
        (F.col("a") < F.col("b")) & (F.col("ar") != F.col("br")) & (F.col("a") != F.col("alow"))
        & _may_reach(F.col("arest"), F.col("brest"), F.col("an") + F.col("bn")))
    links.append(verified(found.select("a", "b"), texts, shingle))
    return rooted


def set_links(nodes: DataFrame, texts: DataFrame, shingle: int, known: list[DataFrame]) -> list[DataFrame]:
    """Stored links ``(a, b)`` of 0.8 and more among ``nodes`` (node, n, keys), whose components are those of all candidates.

    They begin with the ``known`` ones, whose pairs are not compared again. Candidates are nodes that share a band. A band of more
    than ``CROWD`` nodes in several components is not compared in full: its nodes get the keys of ``prefix_keys``, counted among
    them all, and those that share one of these meet again. That loses no pair of 0.8, and texts that differ in what each has
    alone, however many they are and whatever else they share, do not meet.
    """
    links = list(known)
    keys = nodes.select("node", "n", F.lit(0).cast("long").alias("own"), F.col("n").alias("rest"), F.explode("keys").alias("k"))
    rooted = _joined(keys, texts, shingle, links, CROWD)
    crowd = stored(rooted.where(F.col("c") > CROWD).select("node", "n").distinct(), "near-crowd")
    discard(rooted)
    if not crowd.isEmpty():
        discard(_joined(prefix_keys(crowd, texts, shingle), texts, shingle, links, None))
    discard(crowd)
    return links


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id (null last), all columns as they were.

    Near copies have a Jaccard similarity of 0.8 or more over their distinct runs of ``shingle`` words; a group is what is
    reachable over such pairs. SimHash proposes first; bands of MinHash propose what differs in more than its two bits. A pair of exactly 0.8 is proposed with a probability of 0.99995, closer ones more surely, and each
    link is verified on the whole texts. Texts with equal sets and repeated rows are one node; texts without words are copies
    of each other, null counts as empty. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    plain, at = plain_names(docs)
    held = stored(with_keys(plain, at[text], shingle, 0).withColumn("row", row_key()), "near-held")
    nodes = stored(held.groupBy("s0", "s1").agg(F.min("row").alias("node")), "near-nodes")
    ones = held.select(F.col("row").alias("node"), "n", "keys").join(nodes.select("node"), "node", "left_semi")
    texts = held.select("row", F.col(at[text]).alias("t"), "sketch")
    links = set_links(ones, texts, shingle, [simhash_links(nodes, texts, shingle)])
    roots = components(_all(links))
    rooted = nodes.join(roots, "node", "left").select("s0", "s1", F.coalesce("root", "node").alias("root"))
    rows = held.select("row", F.col(at[id_col]).alias("_id"), "s0", "s1").join(rooted, ["s0", "s1"]).select("row", "_id", "root")
    rows = stored(rows, "near-groups")
    for used in [*links, nodes]:
        discard(used)
    # smallest id, then smallest row: two plain minima, each combined before the shuffle
    ids = rows.groupBy("root").agg(F.min("_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    first = rows.join(ids, "root").where(F.col("_id").eqNullSafe(F.col("low"))).groupBy("root").agg(F.min("row").alias("keep"))
    gone = rows.join(first, "root").where("row <> keep").select("row")
    gone = F.broadcast(gone) if fits_broadcast(gone) else gone
    return held.join(gone, "row", "left_anti").select(*plain.columns).toDF(*docs.columns)
