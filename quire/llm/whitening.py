"""Whitening of an embeddings table: pivoted Cholesky and one-sided Jacobi on the triangular factor.

Every entry c becomes the whole number x = floor(1024 * c) + 100000.  Three aggregations run over
the whole table, each a partial result per task and a grouped sum: the count and exact per-dimension
sums S; the scatter of the centred vectors; the covariance of the whitened vectors.  Vectors are
centred before they are multiplied: z = x - round(S / n) is a whole number, so its products are
exact in doubles, and the remaining shift of under one half is taken out of the sum.

The scatter (dimensions x dimensions, the only thing that comes to the driver) is factored by Cholesky
with diagonal pivoting, which stops at the numerical rank.  One-sided Jacobi rotates the columns
of the factor itself until they are orthogonal: their squared norms over n are the eigenvalues of the
covariance, the normalised columns its unit eigenvectors.  The covariance is never diagonalised itself,
so small eigenvalues keep their relative accuracy.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite number or one of
2 ** 43 or more are dropped, and so are rows of another length than the most frequent one (of equally
frequent ones the longest); repeated rows and null identifiers are rows like any other; there are as many
components as the rank of the covariance has, so equal vectors, a single one or an empty table give no rows;
equal eigenvalues have any orthonormal basis of theirs as components; a deviation beyond 64 bits is null;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.vectors import matrix, usable_rows

OFFSET = 100_000
COMPONENTS = 8
LIMB = 26  # bits of the lower part when exact sums are carried in two longs


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]             # exact per-dimension sums of x
    components: np.ndarray      # dimensions x rank, unit columns by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole number and the rest, which is at most one half."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(whole, dtype=np.int64), np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole)])


def common_length(rows: DataFrame) -> int:
    found = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def whole_values(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return matrix(batch.column(at)).astype(np.int64) + OFFSET


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Row count and per-dimension sums of x; each is summed as two longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = whole_values(batch, 0)
            n += len(x)
            high += (x >> LIMB).sum(axis=0)
            low += (x & ((1 << LIMB) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)],
                                             names=["d", "n", "high", "low"])

    found = (rows.select("vec").mapInArrow(run, "d long, n long, high long, low long")
             .groupBy("d").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("d").collect())
    return (found[0]["n"], [(r["high"] << LIMB) + r["low"] for r in found]) if found else (0, [])


def summed_products(rows: DataFrame, size: int, shifted) -> np.ndarray:
    """Sum over all rows of v v^T, with v (at most ``size`` long) what ``shifted`` makes of a batch's values."""
    i, j = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((size, size)), False
        for batch in batches:
            v = shifted(whole_values(batch, 0))
            total += v.T @ v
            any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "value"])

    out = np.zeros((size, size))
    for r in rows.select("vec").mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (dimensions x rank, rows in the order of ``a``) with L L^T = a; the largest remaining
    diagonal entry is the next pivot, and the factor ends where none stands out of rounding."""
    rest, diagonal = a.copy(), np.diag(a).copy()
    least = len(a) * np.finfo(float).eps * diagonal.max(initial=0.0)
    columns = []
    free = np.ones(len(a), dtype=bool)
    while free.any():
        p = int(np.argmax(np.where(free, diagonal, -np.inf)))
        if not diagonal[p] > least:
            break
        column = np.where(free, rest[:, p], 0.0) / np.sqrt(diagonal[p])
        column[p] = np.sqrt(diagonal[p])
        free[p] = False
        columns.append(column)
        rest -= np.outer(column, column)
        diagonal = np.diag(rest).copy()
    return np.array(columns).T if columns else np.zeros((len(a), 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times the rotations that make its columns orthogonal, columns by falling norm.

    A sweep meets every pair of columns once, in rounds of disjoint pairs that are rotated together."""
    g = factor.copy()
    n = g.shape[1]
    ring = list(range(n + n % 2))
    tiny = np.finfo(float).eps * max(1, len(g))
    for _ in range(sweeps if n > 1 else 0):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(p, q) for p, q in zip(ring[:half], reversed(ring[half:])) if p < n and q < n]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs).T
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            size = np.sqrt(aa * bb)
            off = np.abs(ab) > tiny * size
            worst = max(worst, (np.abs(ab[off]) / size[off]).max(initial=0.0))
            zeta = (bb - aa) / np.where(off, 2 * ab, 1.0)
            t = np.where(off, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = c * a - c * t * b, c * t * a + c * b
        if worst == 0.0:
            break
    return g[:, np.argsort(-(g * g).sum(axis=0), kind="stable")]


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of stored or narrow ``rows`` (vec, all of one length); None for an empty table."""
    width = common_length(rows)
    rows = rows.where(F.size("vec") == width)
    n, sums = exact_sums(rows, width)
    if not n:
        return None
    whole, rest = Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0).centre()
    scatter = summed_products(rows, width, lambda x: (x - whole).astype(np.float64)) - n * np.outer(rest, rest)
    g = one_sided_jacobi(pivoted_cholesky(scatter))
    norm = np.sqrt((g * g).sum(axis=0))
    vectors = g / norm
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(norm))] < 0, -1.0, 1.0) if len(norm) else 1.0
    return Whitening(n, sums, vectors, norm * norm / n, float(np.trace(scatter)) / n)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over the dimensions of (n * x - S) ** 2."""
    total = np.array([float(s) for s in sums])
    far = float(np.abs(x.astype(np.float64) * n - total).max(initial=0.0)) * 1.0001 + 1
    if max(float(np.abs(x).max(initial=0)) * n, np.abs(total).max(initial=0.0)) < 2.0 ** 62 and far * far * max(1, len(sums)) < 2.0 ** 62:
        d = x * n - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x)
    return [e if e < 1 << 63 else None for e in exact]


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: ``k`` rows per usable row."""
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable_rows(df, id_col, vec_col)
    model = fit(rows)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    k = min(k, model.components.shape[1])
    rows = rows.where(F.size("vec") == len(model.sums))
    whole, rest = model.centre()
    onto = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - whole) - rest) @ onto

    covariance = summed_products(rows, k, project) / model.n if k else np.zeros((0, 0))
    error = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    explained = model.eigenvalues[:k] / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_values(batch, 1)
            many = len(x) * k
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(many, model.n, np.int64)),
                pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(project(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "vec").mapInArrow(run, schema)


def q_whitening(spark, sf_dir) -> DataFrame:
    from quire.session import table

    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
