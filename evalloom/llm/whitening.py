"""Embedding whitening: exact integer sums give the mean, a second pass sums centred outer products.

Each task turns its Arrow batches into one D x D matrix by NumPy's GEMM; ``treeAggregate`` merges the
tasks' matrices level by level, so that neither the driver nor a task ever holds more than a few of
them. LAPACK's symmetric ``eigh`` runs once, on the driver, on that one matrix, and the projection
(D x K) is broadcast: its size is bounded by ``MAX_DIMS``, not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.session import ship_package

#: Dimensions beyond which a matrix would exceed the bound of what is sent around (128 MB).
MAX_DIMS = 4096
#: Entries whose scaled integer does not fit a long with room for the offset count as not finite.
MAX_SCALED = float(1 << 61)
#: Eigenvalues under this share of the largest are zero to double precision: no direction is defined.
RANK_TOLERANCE = 1e-13

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Moments = tuple[int, np.ndarray, np.ndarray]


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, v`` of the rows whose vector is there and holds neither null nor non-finite entries."""
    v = F.col(vector_col)
    good = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < MAX_SCALED / scale, F.lit(False)))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & good).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def _integers(batch: pa.RecordBatch, dims: int, scale: int, offset: int) -> np.ndarray:
    return np.floor(_matrix(batch["v"], dims) * scale).astype(np.int64) + offset


def _exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python integers: no partial sum of 2**20 rows of halves overflows."""
    low, high = x & 0xFFFFFFFF, x >> 32
    return [(int(h) << 32) + int(a) for h, a in zip(high.sum(0), low.sum(0), strict=True)]


def integer_sums(rows: DataFrame, dims: int, scale: int, offset: int) -> tuple[int, list[int]]:
    """First pass: rows and the exact sum of every dimension's integers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            n += batch.num_rows
            total = [a + b for a, b in zip(total, _exact_sums(_integers(batch, dims, scale, offset)), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))],
                ["place", "n", "total"],
            )

    sums = rows.mapInArrow(partial, "place int, n long, total decimal(38,0)").groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = sorted(sums.collect())
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [0] * dims)


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """Moments (rows, mean, centred outer products) of two sets of rows together."""
    if a is None or b is None:
        return b if a is None else a
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _pack(m: Moments) -> tuple[int, bytes, bytes]:
    return m[0], m[1].tobytes(), m[2].tobytes()


def _unpack(row: tuple[int, bytes, bytes]) -> Moments:
    mean = np.frombuffer(row[1])
    return row[0], mean, np.frombuffer(row[2]).reshape(len(mean), len(mean))


def _moments(y: np.ndarray) -> Moments:
    mean = y.mean(0)
    centred = y - mean
    return len(y), mean, centred.T @ centred


def tree_moments(rows: DataFrame, transform, depth: int = 2) -> Moments | None:
    """Moments of ``transform(batch)``'s rows: one matrix for each task, merged by ``treeAggregate``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                total = merged(total, _moments(transform(batch.slice(start, 4096))))
        if total:
            n, mean, outer = _pack(total)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean], pa.binary()), pa.array([outer], pa.binary())], ["n", "mean", "outer"])

    parts = rows.mapInArrow(partial, "n long, mean binary, outer binary").rdd

    def add(total: tuple | None, row: tuple) -> tuple:
        return tuple(row) if total is None else _pack(merged(_unpack(total), _unpack(row)))

    def join(a: tuple | None, b: tuple | None) -> tuple | None:
        return b if a is None else a if b is None else add(a, b)

    total = parts.treeAggregate(None, add, join, depth)
    return None if total is None else _unpack(total)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over the dimensions of (n x - S)^2; null where it does not fit a long."""
    low, high = int(x.min()), int(x.max())
    reach = max(max(abs(n * low - s), abs(n * high - s)) for s in sums)
    if max(abs(n * low), abs(n * high), *map(abs, sums)) < 1 << 62 and len(sums) * reach * reach < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [t if t < 1 << 63 else None for t in (d * d).sum(1).tolist()]


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 32,
    scale: int = 64,
    offset: int = 1_000_000,
) -> DataFrame:
    """Whitened coordinates of every vector: one row for each vector and component.

    A vector that is null, empty or holds a null or non-finite entry takes no part; neither does one of
    another length than the most common (of equally common ones the longest), which has no place in the
    matrix. An entry c is the integer ``floor(scale * c) + offset``. Components are numbered from 1 by
    falling eigenvalue, the sign makes the largest entry positive. Where an eigenvalue is zero to double
    precision, ``whitened`` is null: equal vectors have no direction. ``deviation`` is null where the
    exact number does not fit a long. Repeated rows and null ids are rows like any other; other columns
    are ignored. No row, or fewer dimensions than components: no row, or as many as dimensions.

    Four reads of the table and no shuffle of vectors: sums, outer products, the whitened covariance
    (measured on the whitened rows themselves, for ``identity_error``) and the projection.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = valid_vectors(vectors, id_col, vector_col, scale)
    size = F.size("v")
    common = rows.groupBy(size.alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    dims = common["dims"]
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions; a covariance matrix holds at most {MAX_DIMS}")
    rows = rows.where(size == dims)
    n, sums = integer_sums(rows, dims, scale, offset)
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return (_integers(batch, dims, scale, offset) - base) - rest

    total = tree_moments(rows, centred)
    # Moments are about the mean of what was centred, which differs from zero by rounding only.
    covariance = (total[2] + n * np.outer(total[1], total[1])) / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, dims)
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    directions = directions * np.where(np.take_along_axis(directions, np.abs(directions).argmax(0)[None], 0) < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    defined = values > max(RANK_TOLERANCE * values[0], 0.0)
    projection = spark.sparkContext.broadcast(directions[:, defined] / np.sqrt(values[defined]))
    explained = np.where(defined, values, 0.0) / trace if trace > 0 else np.zeros(k)
    error = 0.0
    if defined.any():
        white = tree_moments(rows, lambda batch: centred(batch) @ projection.value)
        error = float(np.abs(white[2] / n - np.eye(int(defined.sum()))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                m = batch.num_rows
                out = np.full((m, k), np.nan)
                out[:, defined] = centred(batch) @ projection.value
                deviation = pa.array(_deviations(_integers(batch, dims, scale, offset), n, sums), pa.int64())
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["vec_id"].take(at),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        deviation.take(at),
                        pa.array(out.ravel(), from_pandas=True),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, SCHEMA)
