"""Embedding whitening by QDWH spectral divide-and-conquer.

1. Two scans give the mean and then the covariance of the vectors, centred
   before multiplying: each task sums its outer products with numpy and hands
   on one row per matrix row, which Spark adds up.  Only the d x d matrix
   reaches the driver (d: dimensions, at most ``MAX_DIM``).
2. The covariance is taken apart on the driver.  With a shift s between its
   eigenvalues, the polar factor U of ``A - s I`` (dynamically weighted Halley
   iteration, by QR factorisations) gives the spectral projector
   ``(U + I) / 2`` on the eigenvalues above s.  Orthonormal bases of the
   projector's range and of its complement split A into two smaller blocks, and
   so on until the blocks are diagonal.  Blocks below the components asked for
   are left whole.
3. The k x d whitening matrix is shipped to the tasks (at most ``MAX_DIM``
   squared doubles); one scan more gives the whitened vectors' own covariance.

Defined results: vectors that are null, hold null or non-finite entries, are
empty, or have another length than most (of equally frequent lengths the
smaller) are left out; equal vectors and repeated ids are separate rows.  A
component needs variance: those with an eigenvalue of at most ``d * 1e-13`` of the
largest are left out, so a single vector or equal ones have none.  An empty
table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.llm.scratch import materialise

#: Most dimensions of a vector: bounds what the driver and each task hold.
MAX_DIM = 4096
#: Components that the query returns.
COMPONENTS = 8
EPS = np.finfo(float).eps


# ---------------------------------------------------------------- divide and conquer
def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QR-based
    dynamically weighted Halley iteration."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low, last = EPS, None  # a lower bound of the singular values that matter
    for _ in range(40):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        basis = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))[0]
        x = (q / r) * x + (p - q / r) / np.sqrt(r) * (basis[:n] @ basis[n:].T)
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * l2) / (1 + r * l2))
        if last is not None and np.linalg.norm(x - last) <= 8 * EPS * np.sqrt(n) and low > 1 - 1e-8:
            break
        last = x
    return x


def projector_basis(c: np.ndarray, rank: int) -> np.ndarray:
    """Orthogonal matrix whose first ``rank`` columns span the range of the projector ``c``."""
    left, taken = c.copy(), []
    for _ in range(rank):  # the columns with most of what the earlier ones don't explain
        j = int(np.argmax(np.where(np.isin(np.arange(len(c)), taken), -1.0, np.diag(left))))
        taken.append(j)
        left = left - np.outer(left[:, j], left[j]) / max(left[j, j], EPS)
    first = np.linalg.qr(c[:, taken])[0]
    full = np.linalg.qr(np.hstack([c @ first, np.eye(len(c)) - c]), mode="reduced")[0]
    return full[:, :len(c)]


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """(orthogonal matrix, k): its first k columns span the invariant subspace
    of the larger eigenvalues.  None: no shift parts the spectrum further."""
    n, diagonal = len(a), np.diag(a)
    lo, hi = diagonal.min(), diagonal.max()
    mean = diagonal.mean()
    for shift in (np.median(diagonal), mean, *(mean + f * (hi - lo + np.abs(a).max()) for f in (.01, -.01, .07, -.07, .23, -.23))):
        c = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(c)))
        if not 0 < k < n or np.linalg.norm(c @ c - c) > 1e-10 * n:  # an eigenvalue too close to the shift
            continue
        basis = projector_basis(c, k)
        if np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]) <= 1e-12 * n * scale:
            return basis, k
    return None


def spectral_components(a: np.ndarray, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors in rows) of a symmetric matrix,
    the ``top`` largest (None: all)."""
    a = (a + a.T) / 2
    top = len(a) if top is None else min(top, len(a))
    scale = max(np.linalg.norm(a), np.finfo(float).tiny)
    vectors: list[np.ndarray] = []
    todo = [(np.eye(len(a)), a)]  # blocks by falling eigenvalues, the largest last
    while todo and len(vectors) < top:
        basis, block = todo.pop()
        off = block - np.diag(np.diag(block))
        if len(block) == 1 or np.linalg.norm(off) <= 2 * EPS * scale or (cut := split(block, scale)) is None:
            if len(block) > 1 and np.linalg.norm(off) > 2 * EPS * scale:
                basis = basis @ rotations(block)
                block = basis.T @ a @ basis
            order = np.argsort(-np.diag(block), kind="stable")
            vectors.extend(basis[:, order].T)
            continue
        q, k = cut
        for part in (q[:, k:], q[:, :k]):
            todo.append((basis @ part, part.T @ block @ part))
    v = np.array(vectors)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    e = np.einsum("ki,ij,kj->k", v, a, v)
    order = np.argsort(-e, kind="stable")[:top]
    return e[order], v[order]


def rotations(a: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """Eigenvectors (columns) of a block whose eigenvalues are too close for a shift between them: Jacobi rotations."""
    n, v = len(a), np.eye(len(a))
    for _ in range(sweeps):
        for i in range(n - 1):
            for j in range(i + 1, n):
                if abs(a[i, j]) > EPS * np.sqrt(abs(a[i, i] * a[j, j])):
                    t = 0.5 * np.arctan2(2 * a[i, j], a[i, i] - a[j, j])
                    g = np.eye(n)
                    g[i, i] = g[j, j] = np.cos(t)
                    g[j, i], g[i, j] = np.sin(t), -np.sin(t)
                    a, v = g.T @ a @ g, v @ g
    return v


# ---------------------------------------------------------------- moments
def _matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, d), column.iloc[0].dtype if len(column) else float), np.stack(column)]) if len(column) else np.zeros((0, d))


def usable(vectors: DataFrame, col: str) -> DataFrame:
    """The rows whose vector is there, not empty and all finite."""
    v = F.col(col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))


def vector_sums(vectors: DataFrame, col: str) -> tuple[int, int, list]:
    """(dimensions, vectors, sum of each dimension); integer columns are summed exactly."""
    kind = "bigint" if vectors.schema[col].dataType.elementType.typeName() in ("long", "integer", "short", "byte") else "double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            by_size = b[col].map(len)
            for d, rows in b[col].groupby(by_size):
                m = _matrix(rows, d)
                got = held.setdefault(d, [0, np.zeros(d, np.int64 if kind == "bigint" else float)])
                got[0] += len(m)
                got[1] = got[1] + m.sum(0)
        if held:
            yield pd.DataFrame({"d": list(held), "n": [x[0] for x in held.values()], "sums": [x[1] for x in held.values()]})

    parts = materialise(vectors.select(col).mapInPandas(run, f"d int, n long, sums array<{kind}>"), "sums")
    best = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").first()
    if best is None:
        return 0, 0, []
    if best.d > MAX_DIM:
        raise ValueError(f"vectors of {best.d} dimensions: at most {MAX_DIM}")
    cells = parts.where(F.col("d") == best.d).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    return best.d, best.n, [r.s for r in cells.orderBy("i").collect()]


def covariance(vectors: DataFrame, col: str, n: int, mean: np.ndarray) -> np.ndarray:
    """Covariance about ``mean``, divisor ``n``; products of centred entries only."""
    d = len(mean)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for b in batches:
            y = _matrix(b[col], d) - mean
            total += y.T @ y
        yield pd.DataFrame({"i": np.arange(d), "cells": list(total)})

    parts = vectors.select(col).mapInPandas(run, "i int, cells array<double>")
    cells = parts.select("i", F.posexplode("cells").alias("j", "c")).where("j >= i").groupBy("i", "j").agg(F.sum("c").alias("c"))
    out = np.zeros((d, d))
    got = cells.toPandas()
    out[got.i, got.j] = out[got.j, got.i] = got.c / n
    return out


# ---------------------------------------------------------------- whitening
@dataclass
class Whitening:
    """A fitted whitening: ``sums`` and ``n`` of the fit list, ``eigenvalues``
    falling, ``vectors`` in rows, ``trace`` of the covariance."""

    n: int
    sums: list
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def transform(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of a matrix."""
        return (x - self.mean) @ (self.vectors / np.sqrt(self.eigenvalues)[:, None]).T

    def rows(self, vectors: DataFrame, col: str) -> DataFrame:
        """The rows that this whitening applies to."""
        return usable(vectors, col).where(F.size(col) == self.dimensions)


def fit(vectors: DataFrame, col: str, top: int | None = None) -> Whitening:
    """Fit on all usable vectors."""
    good = usable(vectors, col)
    d, n, sums = vector_sums(good, col)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    mean = np.array([s / n for s in sums])
    v = covariance(good.where(F.size(col) == d), col, n, mean)
    e, u = spectral_components(v, top)
    has = e > d * 1e-13 * max(e[0], 0.0) if len(e) and e[0] > 0 else np.zeros(len(e), bool)
    return Whitening(n, sums, e[has], u[has], float(np.trace(v)))


def whiten(vectors: DataFrame, col: str, model: Whitening, out_col: str = "whitened") -> DataFrame:
    """The usable rows with their whitened vector."""
    apply = F.pandas_udf(lambda s: pd.Series(list(model.transform(_matrix(s, model.dimensions)))), "array<double>")
    return model.rows(vectors, col).withColumn(out_col, apply(F.col(col)))


def identity_error(vectors: DataFrame, col: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the
    identity; about their own mean, which takes a scan before."""
    k = len(model.vectors)
    if not k:
        return 0.0
    z = whiten(vectors.select(col), col, model).select("whitened")
    _, n, sums = vector_sums(z, "whitened")
    return float(np.abs(covariance(z, "whitened", n, np.array(sums) / n) - np.eye(k)).max())


# ---------------------------------------------------------------- query
def deviations(x: np.ndarray, n: int, sums: list) -> list:
    """Sum over the dimensions of ``(n * x - sum) ** 2``, exact; None where it needs more than 63 bits."""
    if not len(x):
        return []
    reach = max(abs(n * int(m) - s) for ext in (x.max(0), x.min(0)) for m, s in zip(ext, sums))
    if reach * reach * len(sums) < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def integer_entries(col: Column) -> Column:
    """``floor(1024 * c) + 100000`` of each entry as a long, null for entries that
    are not finite or of 2**50 and more."""
    def entry(c):
        return F.when(F.abs(c) < float(1 << 50), F.floor(1024 * c).cast("long") + 100000)
    return F.transform(col, lambda c: entry(c.cast("double")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per remaining vector and component up to eight.  A vector with
    an entry of 2**50 or more, which has no long, is dropped like one that isn't finite."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.select("vec_id", integer_entries(F.col("embedding")).alias("x"))
    model = fit(rows, "x", COMPONENTS)
    error = identity_error(rows, "x", model)
    k, d = len(model.vectors), model.dimensions
    explained = model.eigenvalues / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["x"], d)
            yield pd.DataFrame({
                "vec_id": b["vec_id"].repeat(k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(b)), "n": model.n,
                "deviation": pd.array(deviations(x, model.n, model.sums), dtype="Int64").repeat(k),
                "whitened": model.transform(x).ravel(), "explained": np.tile(explained, len(b)), "identity_error": error})

    if not k:
        rows = rows.limit(0)
    kept = model.rows(rows, "x") if d else rows
    return kept.mapInPandas(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
