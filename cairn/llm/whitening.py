"""Embedding whitening with covariances by polarisation.

1. Entries become integers; one pass sums every dimension exactly.
2. Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b): a second pass aggregates the exact squares of the centred values of every
   dimension and of every sum of two dimensions, as integers of any size scaled by the number of rows. Differences of these
   variances give all covariances as exact fractions; only the quotients are rounded, once each.
3. The matrix (dimensions squared, however many rows) is decomposed by eigh on the driver; rows are projected in tasks.
4. The covariance of what came out is measured against the identity.
Tasks hold one Arrow batch; per task and pair of dimensions one number is shuffled. The driver gets one row per dimension
and one per pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read_table, tasks, written

SCALE, OFFSET, COMPONENTS, BATCH = 1024, 100_000, 8, 2048
_WIDE = Context(prec=76)
_DECIMAL = pa.decimal128(38, 0)


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def integers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of every entry c; an error where that is beyond 2^60."""
    def entry(c: Column) -> Column:
        y = c.cast("double") * scale
        return F.when(F.abs(y) < 2.0**60, F.floor(y) + offset).otherwise(F.raise_error(F.lit("an entry is too large to become an integer")).cast("long"))

    return F.transform(vector, entry)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if (column.value_lengths().to_numpy() != d).any():
        raise ValueError(f"vectors differ in length: not all have {d} entries")
    return column.flatten().to_numpy().reshape(-1, d)


def _centred(x: np.ndarray, sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """y and t with n * x - S = n * y - t: y is centred but for the fraction t / n of each dimension's mean."""
    return x - np.array([s // n for s in sums]), np.array([s % n for s in sums])


def _squares(y: np.ndarray) -> list[int]:
    """Exact sums of squares of columns."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**63:
        return np.einsum("ij,ij->j", y, y).tolist()
    wide = y.astype(object)
    return (wide * wide).sum(0).tolist()


def _exact(values: list[int]) -> pa.Array:
    return pa.array([_WIDE.create_decimal(v) for v in values], _DECIMAL)


def dimension_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension of (x array<long>)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            column = batch.column("x")
            if len(column):
                x = _matrix(column, len(column[0]) if total is None else len(total))
                part = x.astype(object).sum(0) if int(np.abs(x).max()) * len(x) >= 2**63 else x.sum(0).astype(object)
                n, total = n + len(x), part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total)), _exact(total.tolist())], ["dim", "n", "s"])

    parts = fit.select("x").mapInArrow(add, "dim int, n long, s decimal(38,0)")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()  # a row per dimension
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [])


def polarised(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(i, j, q): for i = j the exact sum of (n * x_i - S_i)^2, for i < j that of (n * (x_i + x_j) - S_i - S_j)^2."""
    d = len(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y, t = _centred(_matrix(batch.column("x"), d), sums, n)
            if not len(y):
                continue
            total = total or [0] * (d * (d + 1) // 2)
            at = 0
            for i in range(d):
                # (n y - t)^2 = n^2 y^2 - 2 n t y + t^2, summed over the batch
                z, u = np.hstack([y[:, i : i + 1], y[:, i : i + 1] + y[:, i + 1 :]]), [int(t[i]), *(int(t[i]) + t[i + 1 :]).tolist()]
                for sq, s, v in zip(_squares(z), z.sum(0).tolist(), u):
                    total[at] += n * n * sq - 2 * n * v * s + len(z) * v * v
                    at += 1
        if total:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _exact(total)], ["i", "j", "q"])

    parts = tasks(fit.select("x"), n, 20_000).mapInArrow(add, "i int, j int, q decimal(38,0)")
    return parts.groupBy("i", "j").agg(F.sum("q").alias("q"))


def covariance(squares: list[tuple[int, int, int]], n: int, d: int) -> np.ndarray:
    """The covariance matrix of the sums (i, j, q): every entry is an exact fraction, rounded once."""
    q = {(i, j): v for i, j, v in squares}
    out = np.empty((d, d))
    for (i, j), v in q.items():
        out[i, j] = out[j, i] = v / n**3 if i == j else (v - q[i, i] - q[j, j]) / (2 * n**3)
    return out


def components_of(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as columns, ``most`` at most; without those that rounding makes up."""
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    real = e > max(e[0], 0.0) * len(e) * np.finfo(float).eps * 8
    k = min(most, int(real.sum()))
    return e[:k], v[:, :k]


def whitened(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, deviation decimal(38,0), w array<double>, n, explained array<double>, identity_error) of vectors (vec_id, embedding).

    One row per vector that has entries, all of them finite numbers; null, empty and other vectors are left out. Repeated
    rows count as often as they occur; a null vec_id stays. Entries c become floor(scale * c) + offset; those must stay within 2^60,
    and all vectors must have one length (an error otherwise). ``deviation`` is the sum of (n * x - S)^2 over the
    dimensions, exact. ``w`` holds x - S / n on the components with the largest variance, k at most, each divided by its
    standard deviation; components without variance are left out, so w is empty where all vectors are equal.
    ``identity_error`` is measured on all rows. An empty table gives an empty result. Further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding"), scale, offset).alias("x"))
    fit = written(rows, "fit")
    n, sums = dimension_sums(fit)
    d = len(sums)
    squares = [(r.i, r.j, int(r.q)) for r in polarised(fit, n, sums).collect()] if n else []  # a row per pair of dimensions
    cov = covariance(squares, n, d)
    e, v = components_of(cov, k) if n else (np.zeros(0), np.zeros((0, 0)))
    scaled = v / np.sqrt(e) if len(e) else np.zeros((d, 0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                y, t = _centred(_matrix(part.column("x"), d), sums, n)
                w = (y - t / n) @ scaled
                most = (int(np.abs(y).max(initial=0)) + 1) * n
                z = y * n - t if most < 2**63 else y.astype(object) * n - t
                if most * most * d >= 2**63:
                    z = z.astype(object)
                dev = (z * z).sum(1).tolist()
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), _exact(dev), flat], ["vec_id", "deviation", "w"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = written(fit.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>"), "projected")
    error = 0.0
    if len(e):
        w = lambda i: F.get("w", F.lit(i))
        measured = out.agg(*[F.covar_pop(w(i), w(j)) for i in range(len(e)) for j in range(i, len(e))]).first()
        wanted = [float(i == j) for i in range(len(e)) for j in range(i, len(e))]
        error = float(np.abs(np.array(measured) - np.array(wanted)).max())
    explained = F.array(*[F.lit(float(x)) for x in e / np.trace(cov)]) if len(e) else F.array().cast("array<double>")
    return out.select("vec_id", "deviation", "w", F.lit(n).cast("long").alias("n"), explained.alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(read_table(spark, sf_dir, "embeddings"))
    out = rows.select("*", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
