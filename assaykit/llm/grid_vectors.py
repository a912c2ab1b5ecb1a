"""Vectors on an integer grid, so that counts, sums and distances are exact whatever the order of the tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_length(vectors: DataFrame, vector: str) -> int:
    """The length that most vectors have (the longest of ties); 0 if there is none."""
    sizes = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return best["d"] if best else 0


def on_grid(vectors: DataFrame, id_col: str, vector: str, dim: int, scale: int, limit: int) -> DataFrame:
    """Rows ``(_id, _x)``: the id and floor(``scale`` * component) of every component, as 64-bit little-endian bytes.

    Only vectors of ``dim`` components that are neither null nor NaN nor infinite take part; so do none with a scaled component
    of ``limit`` or more either way, which exact arithmetic on them would not hold. Null ids and repeated rows stay.
    """
    source = vectors.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    schema = source.select("_id").schema.add("_x", "binary", False)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_v")
            fit = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), dim), False)
            values = lists.filter(fit).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(values * scale)
                sound = (np.abs(scaled) < limit).all(1)
            ids = batch.column("_id").filter(fit).filter(pa.array(sound))
            yield pa.RecordBatch.from_arrays([ids, packed(scaled[sound].astype("<i8"))], names=["_id", "_x"])

    return source.mapInArrow(kernel, schema)


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as the bytes of one binary value."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The rows that ``packed`` wrote: int64, one row per value."""
    if not len(column):
        return np.zeros((0, dim), np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.view("<i8").reshape(-1, dim)
