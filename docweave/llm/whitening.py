"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Spark sums: the number of distinct vectors, their entries, and the products of their centred entries, a d x d matrix per task that is
added up row by row. The driver sees d x d numbers at any number of vectors. It factors the scatter as L times its transpose with the
largest remaining diagonal first, and rotates pairs of L's columns until all are orthogonal: their squared norms are the eigenvalues and the
normalised columns the eigenvectors, without ever forming a product that would square the condition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import stored, tidy

_INFINITY = float("inf")


@dataclass(frozen=True)
class Whitening:
    """n vectors with entry sums; components as rows, by falling eigenvalue, of the covariance with divisor n, whose trace is the sum of all its eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


# Linear algebra of d x d numbers.


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with matrix[order][:, order] = L @ L.T, L lower-trapezoidal with as many columns as the matrix has rank."""
    rest, d = matrix.astype(float).copy(), len(matrix)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(rest.diagonal().max(initial=0), 0)
    for k in range(d):
        pivot = k + int(np.argmax(rest.diagonal()[k:]))
        if not rest[pivot, pivot] > least:
            return factor[:, :k], order
        if pivot != k:
            swap = [pivot, k]
            rest[[k, pivot]], factor[[k, pivot]] = rest[swap], factor[swap]
            rest[:, [k, pivot]] = rest[:, swap]
            order[[k, pivot]] = order[swap]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def orthogonal_columns(factor: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """factor times a rotation, with columns that are orthogonal to double precision. The pairs of a round have no column in common and turn at once."""
    g = np.ascontiguousarray(factor.T)  # a column of factor is a row here
    r, bound = len(g), np.sqrt(factor.shape[0]) * np.finfo(float).eps
    places = np.arange(r + r % 2)
    half = len(places) // 2
    for _ in range(sweeps):
        turned = False
        for _ in range(len(places) - 1):
            p, q = places[:half], places[half:][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            places[1:] = np.roll(places[1:], 1)
            a, b, c = (g[p] ** 2).sum(1), (g[q] ** 2).sum(1), (g[p] * g[q]).sum(1)
            turn = np.abs(c) > bound * np.sqrt(a) * np.sqrt(b)
            if not turn.any():
                continue
            turned, p, q, a, b, c = True, p[turn], q[turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cosine = 1 / np.hypot(1, tangent)
            sine = cosine * tangent
            one, two = g[p], g[q]
            g[p], g[q] = cosine[:, None] * one - sine[:, None] * two, sine[:, None] * one + cosine[:, None] * two
        if not turned:
            break
    return g.T


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as rows) of a positive semidefinite matrix, largest first, as many as its rank. The entry of largest size of a vector is positive."""
    factor, order = pivoted_cholesky(scatter)
    columns = orthogonal_columns(factor)
    norms = np.linalg.norm(columns, axis=0)
    by_size = np.argsort(-norms, kind="stable")
    vectors = np.zeros((len(norms), len(scatter)))
    vectors[:, order] = (columns[:, by_size] / norms[by_size]).T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]) if len(vectors) else np.ones(0)
    return norms[by_size] ** 2, vectors * signs[:, None]


# Vectors.


def usable(vector: Column) -> Column:
    """Not null, and no entry is null, not a number or infinite."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < _INFINITY))


def scaled(vector: Column, scale: int = 256) -> Column:
    """The entries as long integers: floor(scale * entry), within the range of long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n. The whole part of the mean is taken off in integers, the rest in doubles."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    bound = 1 << 62
    if max(map(abs, whole), default=0) < bound and len(x) and max(int(x.max(initial=0)), -int(x.min(initial=0))) < bound:
        return (x - np.array(whole, np.int64)).astype(float) - rest
    return (x.astype(object) - np.array(whole, object)).astype(float) - rest


def _sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sums of their entries."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            near = np.abs(x.astype(float)).max(initial=0) * max(1, len(x)) < 2.0**62
            total += (x.sum(0) if near else x.astype(object).sum(0)).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(n), *(Decimal(int(v)) for v in total)], pa.decimal128(38, 0))], names=["at", "value"])

    added = fit.mapInArrow(of, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value"))
    found = {r["at"]: int(r["value"]) for r in added.collect()}  # d + 1 rows
    return found.get(-1, 0), tuple(found.get(k, 0) for k in range(d))


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Arrays by number, each the sum of those that tasks give under that number."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = total + np.stack(batch.column("part").to_numpy(zero_copy_only=False)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["at", "part"])

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(add(key, table.to_batches())))

    return {r["at"]: np.array(r["part"]) for r in parts.groupBy("at").applyInArrow(whole, "at int, part array<double>").collect()}


def _products(fit: DataFrame, n: int, sums: tuple[int, ...], components: np.ndarray | None = None, middle: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sum, scatter) of centred vectors, or of their projections less middle."""
    d, size = len(sums), len(sums) if components is None else len(components)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, total, n_rows = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            y = _centred(_matrix(batch.column(0), d), n, sums)
            if components is not None:
                y = y @ components.T - middle
            scatter, total, n_rows = scatter + y.T @ y, total + y.sum(0), n_rows + len(y)
        if n_rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([total.tolist(), *scatter.tolist()], pa.list_(pa.float64()))], names=["at", "part"])

    found = _added(fit.mapInArrow(of, "at int, part array<double>"))
    return found.get(-1, np.zeros(size)), np.array([found.get(k, np.zeros(size)) for k in range(size)]).reshape(size, size)


def fit_list(rows: DataFrame, vector: str) -> DataFrame:
    """Each distinct vector of integers once, stored; equal vectors meet in map-side combination first."""
    return stored(rows.select(F.col(vector).alias("x")).distinct(), "fit-list")


def fitted(fit: DataFrame, d: int) -> tuple[Whitening, np.ndarray]:
    """The whitening of distinct d-dimensional integer vectors, and the mean of their centred entries (zero but for rounding)."""
    n, sums = _sums(fit, d)
    if not n:
        return Whitening(0, sums, np.zeros((0, d)), np.zeros(0), 0.0), np.zeros(d)
    total, scatter = _products(fit, n, sums)
    values, vectors = eigen(scatter)
    return Whitening(n, sums, vectors, values / n, float(scatter.diagonal().sum()) / n), total / n


def identity_error(fit: DataFrame, of: Whitening, middle: np.ndarray, components: int) -> float:
    """The largest absolute entry of the covariance of the first components' whitened values, less the identity."""
    k = min(components, len(of.eigenvalues))
    if not k:
        return 0.0
    axes = of.components[:k] / np.sqrt(of.eigenvalues[:k])[:, None]
    _, scatter = _products(fit, of.n, of.sums, axes, axes @ middle)
    return float(np.abs(scatter / of.n - np.eye(k)).max())


def whitened(rows: DataFrame, of: Whitening, components: int, key: str = "vec_id", vector: str = "x") -> DataFrame:
    """key, whitened (array<double>, one entry per component) and deviation: the sum of the squares of n * x - sums, exact; null from 10 ** 38 on."""
    k, n, sums = min(components, len(of.eigenvalues)), of.n, of.sums
    axes = of.components[:k] / np.sqrt(of.eigenvalues[:k])[:, None]
    key_type = dict(rows.dtypes)[key]

    def deviations(x: np.ndarray) -> pa.Array:
        s, wide = np.array(sums, object), pa.decimal128(38, 0)
        most = float(n) * np.abs(x.astype(float)).max(initial=0) + max(map(abs, sums), default=0)
        if most < 2.0**62 and most**2 * max(1, len(sums)) < 2.0**62:
            return pa.array(((x * n - s.astype(np.int64)) ** 2).sum(1), pa.int64()).cast(wide)
        exact = ((x.astype(object) * n - s) ** 2).sum(1)
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], wide)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(sums))
            y = _centred(x, n, sums) @ axes.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(y).ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, deviations(x)], names=[key, "whitened", "deviation"])

    return rows.select(key, vector).mapInArrow(apply, f"`{key}` {key_type}, whitened array<double>, deviation decimal(38,0)")


@tidy
def whiten(rows: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Per usable row: key, n, deviation (decimal), whitened (array), and explained and identity_error, which are the same for all rows.

    Rows whose vector is null, or holds null or non-finite entries, are left out. So are vectors, the empty one too, whose length isn't that of most usable
    rows (ties: the longer one), since a covariance needs one dimension. Repeated rows count once in the fit and each is a row of the result; null keys are kept, and
    other columns aren't looked at. There are at most as many components as the fit has rank, so no rows where it holds less than two vectors
    or the table is empty. Entries beyond the range of long are its ends.
    """
    kept = stored(rows.where(usable(F.col(vector))).select(F.col(key).alias("key"), scaled(F.col(vector), scale).alias("x")), "scaled-vectors")
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    even = kept.where(F.size("x") == d) if d else kept.where("false")
    fit = fit_list(even, "x")
    of, middle = fitted(fit, d)
    k = min(components, len(of.eigenvalues))
    error = identity_error(fit, of, middle, components)
    out = whitened(even if k else even.where("false"), of, components, "key") if d else even.select("key", F.array().cast("array<double>").alias("whitened"), F.lit(0).cast("decimal(38,0)").alias("deviation"))
    explained = F.array(*(F.lit(float(v)) for v in of.eigenvalues[:k] / of.trace)).cast("array<double>") if k else F.array().cast("array<double>")
    return out.select(F.col("key").alias(key), F.lit(of.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Up to four whitened components of every usable row of embeddings, a row for each; deviation is null where it doesn't fit into a long."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = found.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_of"), "identity_error")
    return each.select("vec_id", (F.col("_at") + 1).alias("component"), "n", "deviation", F.col("_of.whitened").alias("whitened"), F.col("_of.explained").alias("explained"), "identity_error")
