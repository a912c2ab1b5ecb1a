"""Token-id segments with Elias-Fano coded document boundaries, written and read as Spark tables."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import kept_in_worker, prepare, tidy
from assaykit.operators.hotkeys import fits_broadcast

SEGMENT_IDS = 1 << 20
SAMPLE = 512
CACHED = 500_000
SLICE = 1000
HEAD = struct.Struct("<4sBQQ")
MAGIC = b"EFB1"


class EliasFano:
    """A non-decreasing sequence in about ``2 + log2(last / n)`` bits a value.

    The low bits stand side by side; the high bits are unary: value i sets bit ``high(i) + i``. ``select`` finds the i-th
    set bit from 32-bit samples taken every 512 set bits, so no table of 64-bit offsets exists.
    """

    def __init__(self, count: int, universe: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.universe, self.low, self.high, self.samples = count, universe, low, high, samples
        self.width = low_width(count, universe)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        count = len(values)
        if count and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("values must be non-negative and in order")
        universe = int(values[-1]) if count else 0
        width = low_width(count, universe)
        low_bits = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
        places = (values >> width) + np.arange(count)
        high_bits = np.zeros(count + (universe >> width) + 1, np.uint8)
        high_bits[places] = 1
        return cls(count, universe, np.packbits(low_bits.ravel(), bitorder="little"),
                   np.packbits(high_bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return HEAD.pack(MAGIC, self.width, self.count, self.universe) + self.samples.tobytes() + self.low.tobytes() + \
            self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        magic, width, count, universe = HEAD.unpack_from(data)
        if magic != MAGIC or width != low_width(count, universe):
            raise ValueError("not an Elias-Fano block")
        at = HEAD.size
        samples = np.frombuffer(data, "<u4", -(-count // SAMPLE), at)
        at += samples.nbytes
        low = np.frombuffer(data, np.uint8, -(-count * width // 8), at)
        return cls(count, universe, low, np.frombuffer(data, np.uint8, offset=at + low.nbytes), samples)

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.width:
            return np.zeros(last - first, np.int64)
        start, end = first * self.width, last * self.width
        bits = np.unpackbits(self.low[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start]
        return bits.reshape(-1, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value i, read from the sample before it."""
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last - 1``: the high bits are read from the sample before the first of them to the last one."""
        if not 0 <= first <= last <= self.count:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.int64)
        at = int(self.samples[first // SAMPLE])
        base, byte = first // SAMPLE * SAMPLE, at // 8
        # the sample after the range bounds it, if there is one
        end = int(self.samples[(last - 1) // SAMPLE + 1]) // 8 + 1 if (last - 1) // SAMPLE + 1 < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[byte:end], bitorder="little")
        bits[: at % 8] = 0
        places = np.flatnonzero(bits)[first - base : last - base] + byte * 8
        return ((places - np.arange(first, last)) << self.width) | self._low(first, last)

    def values(self) -> np.ndarray:
        """All values at once."""
        return self.select_range(0, self.count)


def low_width(count: int, universe: int) -> int:
    return max(0, (universe // count).bit_length() - 1) if count else 0


# A space next to other white space, or at an end, may belong to a longer run of white space.
_SPACE = r"[\t\n\v\f\r\x1c-\x1f\x{85}\p{Z}]"
_RUNS = rf"{_SPACE} | {_SPACE}|\A | \z"
_STOPS = ".,;:!?"


def _byte_alphabet() -> dict[int, str]:
    """Character of each byte in the byte-level alphabet: printable Latin-1 ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _is_word(part: str) -> bool:
    """Letters only, of scripts whose letters have long been settled: one piece for the splitting rule, whatever its version."""
    return part.isalpha() and (part.isascii() or max(part) < "\u0600")


class ChunkEncoder:
    """Ids of whole texts from the tokenizers library, with each distinct chunk of a batch encoded once.

    The byte-level rule splits a text before it merges, and always in front of a single space between two other characters. A
    text is therefore cut at these spaces, and its ids are those of its chunks. Chunks of letters, stops and single line breaks go
    to the library's merge model at once, others through the whole library. Texts with other runs of white space around a space are
    encoded whole, and so is every text if the tokenizer splits by another rule. Cutting, telling distinct chunks apart and
    putting ids together are array operations; only distinct chunks are Python objects. The first ``CACHED`` chunks stay
    for the life of the worker.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        rule = json.loads(tokenizer_json)
        split = rule.get("pre_tokenizer") or {}
        self.by_space = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                         and not rule.get("normalizer") and not rule.get("truncation")
                         and (rule.get("post_processor") or split).get("type") == "ByteLevel"
                         and rule["model"]["type"] == "BPE" and not any(" " in t["content"] for t in rule.get("added_tokens", [])))
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.space = self.alphabet[ord(" ")]
        self.stops: dict[str, list[int]] = {}
        self.numbers: dict[str, int] = {}
        self.count = self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, self.dtype)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, text: str) -> list[int]:
        mapped = (text if text.isascii() else text.encode().decode("latin-1")).translate(self.alphabet)
        return [t.id for t in self.model.tokenize(mapped)]

    def _simple(self, chunk: str) -> list[int] | None:
        """Ids of a chunk that follows a space, if it is words with stops behind them, parted by single line breaks."""
        ids: list[int] = []
        for i, part in enumerate(chunk.split("\n") if "\n" in chunk else (chunk,)):
            word = part.rstrip(_STOPS)
            if not _is_word(word):
                return None
            if i:
                ids += self._piece("\n") + self._piece(word)
            else:
                ids = [t.id for t in self.model.tokenize(self.space + word)] if word.isascii() else self._piece(" " + word)
            if len(word) < len(part):
                stops = part[len(word):]
                if stops not in self.stops:
                    self.stops[stops] = self._piece(stops)
                ids += self.stops[stops]
        return ids

    def _add(self, found: list[list[int]]) -> np.ndarray:
        """Put ids at the end of the pool; the numbers they got."""
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        total, count = int(sizes.sum()), len(found)
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * total, self.dtype)])
        if self.count + count > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(self.count + 2 * count, np.int64)])
            self.sizes = np.concatenate([self.sizes, np.zeros(self.count + 2 * count, np.int32)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), self.dtype, total)
        new = np.arange(self.count, self.count + count)
        self.starts[new] = self.used + np.cumsum(sizes) - sizes
        self.sizes[new] = sizes
        self.count, self.used = self.count + count, self.used + total
        return new

    def _spaced(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks that follow a space; those not met before are encoded, and kept while there is room."""
        numbers = np.fromiter((self.numbers.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(numbers < 0)
        fresh = [chunks[i] for i in new.tolist()]
        found = [self._simple(c) for c in fresh]
        odd = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(odd, self._whole([" " + fresh[i] for i in odd]), strict=True):
            found[i] = ids
        numbers[new] = self._add(found)
        room = max(0, CACHED - len(self.numbers))
        self.numbers.update(zip(fresh[:room], numbers[new[:room]].tolist(), strict=True))
        return numbers

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text, in order."""
        odd = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False) if self.by_space else np.ones(len(texts), bool)
        whole = iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        chunks, ends = lists.flatten(), np.diff(lists.offsets.to_numpy()).cumsum()
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        head = np.zeros(len(chunks), bool)
        head[starts] = True
        if len(chunks):
            rest = chunks.filter(pa.array(~head)).dictionary_encode()
            spaced = self._spaced(rest.dictionary.to_pylist())
            numbers = np.zeros(len(chunks), np.int64)
            numbers[~head] = spaced[rest.indices.to_numpy()] if len(rest) else 0
            numbers[head] = self._add(self._whole(chunks.filter(pa.array(head)).to_pylist()))
        i = 0
        for is_odd in odd.tolist():
            if is_odd:
                yield np.array(next(whole), self.dtype)
                continue
            some = numbers[starts[i] : ends[i]]
            sizes = self.sizes[some].astype(np.int64)
            shift = np.repeat(self.starts[some] - (np.cumsum(sizes) - sizes), sizes)
            yield self.pool[shift + np.arange(len(shift))]
            i += 1
        # kept chunks come first; forget what no later batch asks for
        if self.count > len(self.numbers):
            self.count = len(self.numbers)
            self.used = int(self.starts[self.count])


def _encoder(tokenizer_json: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker process, until it serves another operator."""
    return kept_in_worker("elias_fano", zlib.crc32(tokenizer_json.encode()), lambda: ChunkEncoder(tokenizer_json))


SEGMENT = T.StructType([
    T.StructField("part", T.IntegerType(), False), T.StructField("seq", T.IntegerType(), False),
    T.StructField("n_docs", T.LongType(), False), T.StructField("n_ids", T.LongType(), False),
    T.StructField("id_bytes", T.IntegerType(), False), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("ends", T.BinaryType(), False), T.StructField("ids", T.BinaryType(), False),
])


def write_segments(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text: str = "text",
                   order: list[str] | None = None, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text, append ``end_id`` to each, and write the ids in ascending order of ``order`` (the id).

    A file row is a segment: its document ids, the Elias-Fano coded ends of its documents and the concatenated ids (16 bits
    each if the vocabulary fits, else 32). A segment closes once it holds ``segment_ids`` ids, so a row is bounded by that
    plus one document. Parquet carries the segments: its commit keeps one attempt of a task whatever is lost, and any store
    that Spark reaches will do. Range partitions give the order; null ids come first, null texts count as empty, repeated
    rows are written each, ties are written in the order of their texts. An empty table writes no segment.
    """
    prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    order = order or [id_col]
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
                         *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = source.repartitionByRange(*keys).sortWithinPartitions(*keys, F.xxhash64("_text"), "_text")

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(tokenizer_json), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.dtype)
        width = encoder.dtype.itemsize
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        blobs: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            ends = EliasFano.encode(np.cumsum(lengths)).to_bytes()
            values = [[part], [seq], [len(doc_ids)], [size], [width], [doc_ids], [ends], [np.concatenate(blobs).tobytes()]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(),
                                                         pa.list_(pa.int64()), pa.binary(), pa.binary()], strict=True)],
                names=SEGMENT.names)

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                for doc_id, found in zip(some.column("_id").to_pylist(), encoder.encode(some.column("_text")), strict=True):
                    doc_ids.append(doc_id)
                    blobs += (found, end)
                    lengths.append(len(found) + 1)
                    size += lengths[-1]
                    if size >= segment_ids:
                        yield segment()
                        doc_ids, lengths, blobs, size, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield segment()

    ranged.select("_id", "_text").mapInArrow(tidy(kernel, keeps=True), SEGMENT).write.parquet(path)


def in_file_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that give the order of its rows in the files it is read from; none if it is not read from files."""
    place = {"_file": "_metadata.file_name", "_place": "_metadata.row_index"}
    try:
        return docs.withColumns({c: F.col(source) for c, source in place.items()}), list(place)
    except AnalysisException:
        return docs, []


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``base``, the ids before each: totals per part first, so that one task sees one row per part only."""
    segments = spark.read.parquet(path)
    sizes = segments.select("part", "seq", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    bases = sizes.join(parts, "part").select(
        "part", "seq", (F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))
    # one small row per segment of about a million ids
    return segments.join(F.broadcast(bases) if fits_broadcast(sizes) else bases, ["part", "seq"])


def read_ids(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """``doc_id``, ``start`` among all ids and ``ids`` of some documents: two selects find each, nothing else is decoded.

    A document that is not there gives no row, one that was written twice gives two; null ids cannot be asked for.
    """
    asked = F.array(*[F.lit(i).cast("long") for i in sorted(set(wanted))]) if wanted else F.array().cast("array<long>")
    some = segment_starts(spark, path).where(F.arrays_overlap("doc_ids", asked))
    numbers = set(wanted)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, block, ids, base, width = (batch.column(c)[row] for c in ("doc_ids", "ends", "ids", "base", "id_bytes"))
                ends = EliasFano.from_bytes(block.as_py())
                flat = np.frombuffer(ids.as_buffer(), "<u2" if width.as_py() == 2 else "<u4")
                found = [i for i, d in enumerate(doc_ids.as_py()) if d in numbers]
                spans = [(ends.select(i - 1) if i else 0, ends.select(i)) for i in found]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values.take(pa.array(found, pa.int64())), pa.array([base.as_py() + lo for lo, _ in spans], pa.int64()),
                     pa.array([flat[lo:hi].astype(np.int64) for lo, hi in spans], pa.list_(pa.int64()))],
                    names=["doc_id", "start", "ids"])

    return some.select("doc_ids", "ends", "ids", "base", "id_bytes").mapInArrow(kernel, "doc_id long, start long, ids array<long>")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: id, start among all ids, number of ids with the end, CRC-32 of them as 32-bit."""
    bases = segment_starts(spark, path)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, block, ids, base, width = (batch.column(c)[row] for c in ("doc_ids", "ends", "ids", "base", "id_bytes"))
                ends = EliasFano.from_bytes(block.as_py()).values()
                starts = np.concatenate([[0], ends[:-1]])
                flat = np.frombuffer(ids.as_buffer(), "<u2" if width.as_py() == 2 else "<u4").astype("<u4")
                crcs = [zlib.crc32(flat[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(starts + base.as_py()), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return bases.select("doc_ids", "ends", "ids", "base", "id_bytes").mapInArrow(tidy(kernel), READ)
