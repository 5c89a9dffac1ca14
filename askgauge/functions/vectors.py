"""Column helpers over ``array<float>`` embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(col: Column) -> Column:
    return col.cast("array<double>")


def array_sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def squared_gap(a: Column, b: Column) -> Column:
    """Sum over positions of (a - b)^2."""
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def unit_directions(dim: int, count: int, seed: int = 0) -> np.ndarray:
    """``count`` random unit rows; a fixed seed gives the same rows on every run."""
    rows = np.random.RandomState(seed).normal(size=(count, dim)).astype(np.float32)
    norms = np.linalg.norm(rows, axis=1, keepdims=True).astype(np.float32)
    return (rows / (norms + np.float32(1e-8))).astype(np.float64)


def _as_matrix(batch: pa.ListArray, dim: int) -> np.ndarray:
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(batch), dim)


def _as_lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), type=kind))


def project(col: Column, directions: np.ndarray) -> Column:
    """Dot products of a vector with every direction, one matrix product per Arrow batch.

    Written as an Arrow function because a higher-order expression would run
    ``directions.size`` interpreted lambda calls per row.
    """
    dim = directions.shape[1]
    basis = np.ascontiguousarray(directions.T)

    @F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
    def dot_all(batch: pa.Array) -> pa.Array:
        return _as_lists(_as_matrix(batch, dim) @ basis, pa.float64())

    return dot_all(col)


def project_by_key(key: Column, col: Column, directions: Mapping[object, np.ndarray]) -> Column:
    """Like :func:`project`, with a set of directions of its own for every key."""
    some = next(iter(directions.values()))
    count, dim = some.shape
    table = dict(directions)

    @F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
    def dot_own(keys: pa.Array, batch: pa.Array) -> pa.Array:
        vectors = _as_matrix(batch, dim)
        names = np.asarray(keys.to_pylist(), dtype=object)
        out = np.empty((len(vectors), count))
        for name in set(names.tolist()):
            rows = names == name
            out[rows] = vectors[rows] @ table[name].T
        return _as_lists(out, pa.float64())

    return dot_own(key, col)


def second_moments(df: DataFrame, key: str, dim: int) -> DataFrame:
    """``key, n, total, products``: count, sum and summed outer products of the vectors of each
    key, one row per key and task batch; callers add the rows up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch.column(0).to_pylist(), dtype=object)
            vectors = _as_matrix(batch.column(1), dim)
            found = sorted(set(names.tolist()))
            rows = []
            for name in found:
                part = vectors[names == name]
                rows.append(np.concatenate([[len(part)], part.sum(0), (part.T @ part).reshape(-1)]))
            moments = _as_lists(np.array(rows).reshape(len(found), 1 + dim + dim * dim), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(found, type=batch.column(0).type), moments], names=[key, "moments"])

    schema = T.StructType([df.schema[key], T.StructField("moments", T.ArrayType(T.DoubleType()))])
    return df.select(key, "embedding").mapInArrow(sums, schema)


def sketched_moments(df: DataFrame, key: str, dim: int, bases: Mapping[object, np.ndarray], shared: bool = False) -> DataFrame:
    """``key, moments``: count, sum, and the summed outer products times each key's basis (m x D).

    One row per key and task batch with 1 + D + D x m numbers.  ``shared`` vectors count for every key.
    """
    table = dict(bases)
    m = len(next(iter(table.values())))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch.column(0).to_pylist(), dtype=object)
            vectors = _as_matrix(batch.column(1), dim)
            found = sorted(table) if shared else sorted(set(names.tolist()))
            rows = []
            for name in found:
                part = vectors if shared else vectors[names == name]
                rows.append(np.concatenate([[len(part)], part.sum(0), (part.T @ (part @ table[name].T)).reshape(-1)]))
            moments = _as_lists(np.array(rows).reshape(len(found), 1 + dim + dim * m), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(found, type=batch.column(0).type), moments], names=[key, "moments"])

    schema = T.StructType([df.schema[key], T.StructField("moments", T.ArrayType(T.DoubleType()))])
    return df.select(key, "embedding").mapInArrow(sums, schema)


def leading_directions(moments: Column, dim: int, k: int) -> Column:
    """Top principal directions of summed second moments, flattened; largest loading positive."""

    @F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
    def solve(batch: pa.Array) -> pa.Array:
        packed = _as_matrix(batch, 1 + dim + dim * dim)
        out = np.empty((len(packed), k * dim))
        for i, row in enumerate(packed):
            mean = row[1 : 1 + dim] / row[0]
            spread = row[1 + dim :].reshape(dim, dim) / row[0] - np.outer(mean, mean)
            top = np.linalg.eigh(spread)[1][:, ::-1].T[:k]
            out[i] = fix_signs(top).reshape(-1)
        return _as_lists(out, pa.float64())

    return solve(moments)


def fix_signs(directions: np.ndarray) -> np.ndarray:
    """Make the largest loading of every direction positive."""
    peak = np.abs(directions).argmax(axis=1)
    return directions * np.sign(directions[np.arange(len(directions)), peak])[:, None]


def slot_of(col: Column, bounds: np.ndarray) -> Column:
    """For each projected value, the range slot it falls in (``bounds`` is one row per direction)."""
    count = bounds.shape[0]

    @F.arrow_udf(returnType=T.ArrayType(T.IntegerType()))
    def locate(batch: pa.Array) -> pa.Array:
        values = _as_matrix(batch, count)
        slots = np.empty(values.shape, dtype=np.int32)
        for d in range(count):
            slots[:, d] = np.searchsorted(bounds[d], values[:, d], side="left")
        return _as_lists(slots, pa.int32())

    return locate(col)
