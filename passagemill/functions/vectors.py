"""Vector arithmetic: column expressions for one query, numpy kernels for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def literal_vector(values) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vectors must have the same length"))
    )


def _sum_zip(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum_zip(as_double(a), as_double(b), lambda x, y: x * y)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum_zip(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; unequal lengths are an error."""
    return _same_length(a, b, F.sqrt(squared_l2(a, b)))


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """Cosine similarity, 0 when a vector is all zero.

    Unequal lengths give 0, or an error with ``strict``.
    """
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    if strict:
        return _same_length(a, b, value)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.lit(0.0))


def squared_l2_to(vector: Column, point) -> Column:
    """Squared distance of a vector column to one fixed point; unequal lengths are an error.

    Only the vector column goes through Arrow; measured on a million 64-wide vectors this takes a
    third of the time of the array-function form.
    """
    target = np.array([float(x) for x in point])

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        rows = matrix_of(vectors)
        if len(rows) and rows.shape[1] != len(target):
            raise ValueError("vectors must have the same length")
        diff = rows - target if len(rows) else np.empty((0, len(target)))
        return pa.array(np.einsum("ij,ij->i", diff, diff))

    return distance(vector)


# --------------------------------------------------------------------------- numpy kernels


def matrix_of(column: pa.Array) -> np.ndarray:
    """Arrow list column -> 2-d double array, without touching rows one by one."""
    rows = len(column)
    if not rows:
        return np.empty((0, 0))
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or (widths != widths[0]).any():
        raise ValueError("vectors must have the same length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(rows, -1)


def distinct_rows(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers that keep, of equal vectors, the k smallest ids: more of them can't be among the k nearest."""
    raw = np.ascontiguousarray(x + 0.0)  # no negative zeros, which would differ in bytes
    _, group = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_inverse=True)
    _, rank = np.unique(ids, return_inverse=True)
    order = np.lexsort((rank, group))
    starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return np.sort(order[place < k])


def near_pairs(x: np.ndarray, y: np.ndarray, k: int, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, exact squared distance) holding at least the k nearest rows of x for each of y.

    One matrix product finds them with a margin wider than its rounding error; only those are then
    computed by subtracting, so that equal distances come out equal.
    """
    found = []
    step = max(1, cells // max(1, len(x)))
    x2 = (x * x).sum(axis=1)
    for at in range(0, len(y), step):
        part = y[at : at + step]
        y2 = (part * part).sum(axis=1)
        rough = x2[None, :] + y2[:, None] - 2.0 * (part @ x.T)
        if len(x) > k:
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
            margin = 1e-9 * (1.0 + x2.max() + y2)
            query, row = np.nonzero(rough <= (bound + margin)[:, None])
        else:
            query, row = np.nonzero(np.ones_like(rough, dtype=bool))
        exact = np.empty(len(row))
        most = max(1, cells // max(1, x.shape[1]))
        for low in range(0, len(row), most):
            diff = x[row[low : low + most]] - part[query[low : low + most]]
            exact[low : low + most] = np.einsum("ij,ij->i", diff, diff)
        found.append((query + at, row, exact))
    return tuple(np.concatenate(c) for c in zip(*found))


def nearest_rows(x: np.ndarray, y: np.ndarray, digits: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """For every row of y the nearest row of x and its distance; the first row wins ties."""
    query, row, squared = near_pairs(x, y, 1)
    dist = np.round(np.sqrt(squared), digits)
    order = np.lexsort((row, dist, query))
    first = order[np.r_[True, np.diff(query[order]) != 0]]
    return row[first], dist[first]
