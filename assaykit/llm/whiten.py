"""Whitening of embeddings: exact covariance, float32 eigenvectors, refined by matrix products in higher precision."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import prepare, stored
from assaykit.llm.grid_vectors import on_grid, unpacked, usual_length

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LIMIT = 1 << 50
WIDE = np.longdouble
PLACES = "i int, j int, s decimal(38,0)"


def refined_eigenvectors(matrix: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, both in extended precision.

    Start: eigenvectors X of the matrix in float32. Each round works out R = I - X'X and S = X'AX in extended precision and
    corrects X by X(I + E) with E_ij = (S_ij + l_j R_ij) / (l_j - l_i), which about squares the error (Ogita and Aishima). E is
    written as R / 2, which restores orthogonality, and an antisymmetric turn, so that rounding errors over small gaps turn
    vectors but never bend them. Where two eigenvalues are closer than the error bound of the round there is no turn; such a
    cluster is solved by itself: the eigenvectors of X_J'(A - m I)X_J, whose entries are no larger than the cluster is wide,
    turn X_J to its true directions, which the next rounds refine. Vectors of equal eigenvalues are any basis of theirs.
    """
    a = np.asarray(matrix, WIDE)
    dim = len(a)
    size = np.abs(a).max() if dim else WIDE(0)
    if not size:
        return np.zeros(dim, WIDE), np.eye(dim, dtype=WIDE)
    a = a / size
    fine = 8 * dim * np.finfo(WIDE).eps
    one = np.eye(dim, dtype=WIDE)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    norm_a = np.sqrt((a * a).sum())
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        bound = 2 * (np.sqrt((off * off).sum()) + norm_a * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= bound
        turning = np.where(near, 0, (off + (values[None, :] + values[:, None]) / 2 * r) / np.where(near, 1, gap))
        x = x + x @ (r / 2 + turning - np.diag(np.diag(turning)))
        order = np.argsort(values)
        cuts = np.flatnonzero(np.diff(values[order]) > bound) + 1
        solved = True
        for part in np.split(order, cuts):
            turn = x[:, part]
            inner = turn.T @ (a @ turn - values[part].mean() * turn)
            if len(part) > 1 and np.abs(inner - np.diag(np.diag(inner))).max() > fine * norm_a:
                solved = False
                turned = np.linalg.eigh((inner / np.abs(inner).max()).astype(np.float64))[1].astype(WIDE)
                for _ in range(2):  # orthogonal to extended precision too
                    turned = turned + turned @ (np.eye(len(part)) - turned.T @ turned) / 2
                x[:, part] = turn @ turned
        if solved and max(np.abs(r).max(), np.abs(off).max() / norm_a) < fine:
            break
    x = x / np.sqrt((x * x).sum(0))
    values = (x * (a @ x)).sum(0) * size
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def _exact_rows(total: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys = list(total)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([Decimal(int(total[k])) for k in keys], pa.decimal128(38, 0))], names=["i", "j", "s"])


def _product(y: np.ndarray) -> np.ndarray:
    """y'y for integers, exactly."""
    most = int(np.abs(y).max(initial=0))
    if len(y) * most * most < 1 << 53:
        wide = y.astype(np.float64)  # every partial sum is an integer below 2^53
        return (wide.T @ wide).astype(np.int64).astype(object)
    if len(y) * most * most < 1 << 63:
        return (y.T @ y).astype(object)
    y = y.astype(object)
    return y.T @ y


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows of the fit list and the sum of each dimension."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = unpacked(batch.column(0), dim)
            n += len(x)
            total = total + x.sum(0, dtype=np.int64).astype(object)  # below 2^50 times the rows of a batch
        yield _exact_rows({(-1, -1): n, **{(i, -1): v for i, v in enumerate(total)}})

    found = {r.i: int(r.s) for r in fit.mapInArrow(kernel, PLACES).groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n = found.get(-1, 0)
    return n, [found.get(i, 0) + n * SHIFT for i in range(dim)]


def _covariance(fit: DataFrame, dim: int, n: int, base: list[int], rest: list[int]) -> np.ndarray:
    """Covariance, divisor n: integers centred on ``base`` are multiplied and summed exactly, then rounded once."""
    centre = np.array(base, np.int64) - SHIFT
    upper = np.triu_indices(dim)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for batch in batches:
            total = total + _product(unpacked(batch.column(0), dim) - centre)
        yield _exact_rows(dict(zip(zip(*(u.tolist() for u in upper), strict=True), total[upper], strict=True)))

    out = np.zeros((dim, dim), WIDE)
    for r in fit.mapInArrow(kernel, PLACES).groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        exact = Fraction(n * int(r.s) - rest[r.i] * rest[r.j], n * n)
        high = float(exact)
        out[r.i, r.j] = out[r.j, r.i] = WIDE(high) + WIDE(float(exact - Fraction(high)))
    return out


def _identity_error(fit: DataFrame, dim: int, n: int, centre: np.ndarray, part: np.ndarray, weights: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = weights.shape[1]
    upper = np.triu_indices(k)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = ((unpacked(batch.column(0), dim) - centre) - part) @ weights
            sums += w.sum(0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.arange(k), upper[0]]), pa.int32()),
             pa.array(np.concatenate([np.full(k, -1), upper[1]]), pa.int32()),
             pa.array(np.concatenate([sums, products[upper]]), pa.float64())], names=["i", "j", "s"])

    found = {(r.i, r.j): r.s for r in
             fit.mapInArrow(kernel, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    return max(abs(found[i, j] / n - found[i, -1] * found[j, -1] / n / n - (i == j)) for i, j in zip(*upper, strict=True))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           dim: int | None = None) -> DataFrame:
    """Per row and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    A component c becomes the integer x = floor(64 c) + 1,000,000. The mean S/n and the covariance are those of the distinct x
    vectors, worked out exactly in two distributed passes; eigenvectors are refined to double precision on the driver, whose
    matrices follow the dimension and not the rows. ``whitened`` is x - S/n projected on the unit eigenvector, over the root of its
    eigenvalue; ``deviation`` the exact sum of (n x - S)^2 (null where it exceeds a long); ``explained`` the eigenvalue's share of
    the trace; ``identity_error`` the largest absolute entry of the covariance of ``whitened`` over the distinct vectors minus
    the identity.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those with an entry of 2^44 or more,
    or of another length than ``dim`` (default: the length most have). A vector in many rows counts once in the fit, and each of
    its rows is returned; null ids are returned as null. Components without variance (fewer distinct vectors than
    components, or one vector only) give no rows. Other columns are not read. An empty table gives an empty table.
    """
    prepare(vectors.sparkSession)
    dim = usual_length(vectors, vector) if dim is None else dim
    rows = on_grid(vectors, id_col, vector, dim, SCALE, LIMIT)
    fit = stored(rows.select("_x").distinct(), "whiten-fit")
    n, sums = _sums(fit, dim) if dim else (0, [])
    base, rest = [s // n for s in sums] if n else [], [s % n for s in sums] if n else []
    weights, explained, error = np.zeros((dim, 0)), np.zeros(0), 0.0
    centre, part = np.array(base, np.int64) - SHIFT, np.array([r / n for r in rest])
    if n:
        covariance = _covariance(fit, dim, n, base, rest)
        values, directions = refined_eigenvectors(covariance)
        trace = np.trace(covariance)
        k = int((values[:components] > 4 * dim * np.finfo(WIDE).eps * trace).sum())
        weights = (directions[:, :k] / np.sqrt(values[:k])).astype(np.float64)
        explained = (values[:k] / trace).astype(np.float64) if k else explained
        error = _identity_error(fit, dim, n, centre, part, weights) if k else error
    schema = rows.select(F.col("_id").alias(id_col)).schema
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"),
                       ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, kind)
    names, k = schema.names, weights.shape[1]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            y = unpacked(batch.column("_x"), dim) - centre
            each = np.repeat(np.arange(len(y)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()),
                 pa.array(np.full(len(each), n), pa.int64()), _deviation(y, n, rest).take(pa.array(each)),
                 pa.array(((y - part) @ weights).reshape(-1), pa.float64()), pa.array(np.tile(explained, len(y)), pa.float64()),
                 pa.array(np.full(len(each), error), pa.float64())], names=names)

    return rows.mapInArrow(kernel, schema)


def _deviation(y: np.ndarray, n: int, rest: list[int]) -> pa.Array:
    """Sum of (n y - rest)^2 of each row; null where a long does not hold it."""
    most = n * (int(np.abs(y).max(initial=0)) + 1)
    if y.shape[1] * most * most < 1 << 63:
        return pa.array(((n * y - np.array(rest, np.int64)) ** 2).sum(1), pa.int64())
    exact = ((n * y.astype(object) - np.array(rest, object)) ** 2).sum(1)
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
