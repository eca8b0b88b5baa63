"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Vectors are whole numbers here (the contract's x), so count, sums and scatter are exact and the
same in any order: x is centred at the whole number next to its mean before anything is
multiplied, products of blocks of rows stay below 2^53, and what is left of the centring is done in
whole numbers on the d x d matrix. The tasks send sums only; the driver holds d x d numbers,
whatever the number of rows. The factor L of V = L L' is rotated from the right until its columns
are orthogonal: L J = U S, so V = U S^2 U'. Squared column norms are the eigenvalues and unit
columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators._store import spread

COMPONENTS = 8
#: Rows that are multiplied at once.
ROWS = 4096
#: Whole numbers beyond this don't fit a long with the steps that follow.
FITS = 2.0**62


def usable(vectors: Column) -> Column:
    """Vectors with entries, all of them finite; null vectors and null entries aren't."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vectors) > 0) & F.forall(vectors, lambda x: F.coalesce(entry(x), F.lit(False))), F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """x = floor(1024 c) + 100000 as long."""
    with np.errstate(over="ignore"):
        scaled = np.floor(1024 * vectors)
    if len(scaled) and not np.abs(scaled).max() < FITS:
        raise OverflowError("an entry times 1024 does not fit a long")
    return scaled.astype(np.int64) + 100000


def added(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    safe = not x.size or int(np.abs(x).max()) * len(x) < 2**62
    return x.sum(0).tolist() if safe else x.astype(object).sum(0).tolist()


def multiplied(y: np.ndarray) -> np.ndarray:
    """Exact y'y, of Python numbers where a long could overflow. Doubles hold all products of blocks of small numbers; larger numbers are split in two."""
    d = y.shape[1]
    if not y.size:
        return np.zeros((d, d), np.int64)
    most = int(np.abs(y).max())
    if most >= 2**40:
        z = y.astype(object)
        return z.T @ z
    if most >= 2**20:
        hi, lo = y >> 20, y & (2**20 - 1)
        both = multiplied(np.concatenate([hi, lo], 1)).astype(object)
        return both[:d, :d] * 2**40 + (both[:d, d:] + both[d:, :d]) * 2**20 + both[d:, d:]
    out = np.zeros((d, d), np.int64)
    rows = min(ROWS, 2**53 // max(1, most * most))
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(float)
        out += (part.T @ part).astype(np.int64)
    return out if most * most * len(y) < 2**62 else out.astype(object)


def rows_of(frame: DataFrame, d: int) -> DataFrame:
    """(vec_id, v): usable vectors of ``d`` entries as doubles."""
    return frame.where(usable(F.col("embedding")) & (F.size("embedding") == d)).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def totals(frame: DataFrame) -> tuple[int, int, list[int]]:
    """(n, d, S): rows of the commonest length d (the longer of two alike), and their exact sums. n is 0 for an empty table."""
    good = frame.where(usable(F.col("embedding"))).select(F.size("embedding").alias("d"))
    sizes = good.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return 0, 0, []
    n, d = sizes[0]["n"], sizes[0]["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            total = [a + b for a, b in zip(total, added(whole(matrix(batch.column(0), d))))]
        yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    sums = few(rows_of(frame, d).select("v")).mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("string").alias("s")).orderBy("i").collect()
    return n, d, [int(r["s"]) for r in sums]


def few(frame: DataFrame) -> DataFrame:
    """At most four tasks for each core, so that the number of partial sums doesn't grow with the table. No shuffle."""
    return frame.coalesce(4 * frame.sparkSession.sparkContext.defaultParallelism)


def centre(n: int, s: list[int]) -> list[int]:
    """The whole numbers next to the means."""
    return [(2 * t + n) // (2 * n) for t in s]


def covariance(frame: DataFrame, n: int, d: int, s: list[int]) -> np.ndarray:
    """V as doubles, each entry the double next to the exact value."""
    c = np.array(centre(n, s), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            total = total + multiplied(whole(matrix(batch.column(0), d)) - c)
        i, j = np.triu_indices(d)
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([Decimal(int(t)) for t in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "s"])

    sums = few(rows_of(frame, d).select("v")).mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").cast("string").alias("s")).collect()
    off = [t - n * int(m) for t, m in zip(s, c)]  # sums of what is centred
    v = np.zeros((d, d))
    for r in sums:
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * int(r["s"]) - off[i] * off[j]) / (n * n)
    return v


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (d x rank, lower triangular in pivot order) and the order, largest remaining diagonal first; it ends where what remains is rounding."""
    d = len(v)
    rest, order, factor = v.copy(), np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(float(np.trace(v)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(rest)[k:]))
        if not rest[p, p] > least:
            return factor[:, :k], order
        for a in (rest, rest.T, factor):
            a[[k, p]] = a[[p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def rounds(m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of m columns as rounds of disjoint pairs: one place is fixed, the others turn."""
    even = m + m % 2
    ring, out = list(range(even)), []
    for _ in range(even - 1):
        pairs = [(a, b) for a, b in zip(ring[: even // 2], reversed(ring[even // 2 :])) if max(a, b) < m]
        out.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns turned against each other until all are orthogonal to rounding."""
    a, m = factor.copy(), factor.shape[1]
    close = 8 * np.sqrt(max(len(a), 1)) * np.finfo(float).eps
    turns = rounds(m) if m > 1 else []
    for _ in range(sweeps):
        worst = 0.0
        for p, q in turns:
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > close
            zeta = (beta - alpha) / (2 * np.where(turn, gamma, 1.0))
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst <= close:
            break
    return a


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues falling and unit eigenvectors as columns (largest entry positive); directions without variance are left out."""
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    back = np.empty_like(turned)
    back[order] = turned
    values = (back * back).sum(0)
    rank = np.argsort(-values, kind="stable")
    values, vectors = values[rank], back[:, rank] / np.sqrt(values[rank])
    if vectors.size:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors


def whiten(frame: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) of ``frame(vec_id, embedding)``.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are
    rows whose length isn't the commonest one. Directions without variance have no component, so
    equal vectors only, one vector or an empty table give no rows. Repeated and null ids are rows
    like others; other columns are ignored. An entry of 2^52 and more is an error.
    """
    spark = frame.sparkSession
    kind = frame.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, d, s = totals(frame)
    values, vectors = eigen(covariance(frame, n, d, s)) if n else (np.zeros(0), np.zeros((0, 0)))
    top = min(components, len(values))
    if not top:
        return spark.createDataFrame([], shape)
    c = np.array(centre(n, s), np.int64)
    weights = vectors[:, :top] / np.sqrt(values[:top])
    shift = np.array([(n * int(m) - t) / n for t, m in zip(s, c)]) @ weights
    explained = values[:top] / values.sum()

    def project(y: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk->ik", y.astype(float), weights) + shift  # row by row: a row doesn't depend on its neighbours

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((top + 1, top))
        for batch in batches:
            z = project(whole(matrix(batch.column(0), d)) - c)
            total += np.concatenate([z.sum(0)[None], z.T @ z])
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    got = np.zeros((top + 1, top))
    for r in few(rows_of(frame, d).select("v")).mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r["i"], r["j"]] = r["s"] / n
    error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(top)).max())
    off = [n * int(m) - t for t, m in zip(s, c)]

    def deviations(y: np.ndarray) -> pa.Array:
        if len(y) and (n * int(np.abs(y).max()) + max(map(abs, off))) ** 2 * d < 2**63:
            return pa.array(((n * y + np.array(off, np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
        return pa.array([Decimal(int(t)) for t in ((n * y.astype(object) + np.array(off, object)) ** 2).sum(1)], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = whole(matrix(part.column(1), d)) - c
                m = len(y)
                who = pa.array(np.repeat(np.arange(m), top))
                yield pa.record_batch(
                    [part.column(0).take(who), pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), m)), pa.array(np.full(m * top, n)), deviations(y).take(who), pa.array(project(y).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * top, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows_of(frame, d).mapInArrow(run, shape)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``whiten`` on all ``embeddings``; ``deviation`` as long, null where it doesn't fit one. Dropped rows, ids, ties and empty tables as ``whiten`` says."""
    return whiten(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
