"""Embedding whitening with components from spectral divide and conquer.

Vectors become integers on a fixed grid.  Three passes over the table gather what the fit needs, each a
sum per task that Spark adds up: the exact sums of the dimensions, the exact products of the vectors
centred at the integers next to the means, and at the end the products of the whitened vectors, from
which the error is measured.  Sums of integers do not depend on the order of tasks or on retries.

The components come from the covariance, a matrix as large as the vectors are long.  The polar factor of
the covariance less a shift (QDWH iteration) is the sign of its eigenvalues, so it gives the projectors
to the invariant subspaces above and below the shift.  Bases of both split the matrix in two, and so on
down to single components.  The whitening matrix goes to every task with the function that applies it.
"""

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Grid values beyond this are not whole numbers of a double any more.
GRID_LIMIT = 1 << 52


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley iterations."""
    m = len(a)
    x, low = a / (np.linalg.norm(a) or 1.0), 1e-16
    eye = np.eye(m)
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        weight = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
            y = (b / c) * x + (weight - b / c) / np.sqrt(c) * (q[:m] @ q[m:].T)
        else:
            factor = np.linalg.cholesky(eye + c * (x.T @ x))
            y = (b / c) * x + (weight - b / c) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        y = (y + y.T) / 2
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        moved = np.linalg.norm(y - x)
        x = y
        if moved <= 1e-14 * np.sqrt(m) or low == 1.0 and moved <= 1e-9:
            break
    return x


def _split(a: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """Orthogonal basis whose first k columns span the eigenvectors above some shift; None if all values are one."""
    m, diagonal = len(a), np.sort(np.diag(a))
    middle = float(np.median(diagonal))
    spread = float(np.linalg.norm(a - np.trace(a) / m * np.eye(m)))
    if spread <= 4e-16 * m * scale:
        return None
    # A shift next to an eigenvalue gives no clean projector; another one close by does.
    for attempt in range(24):
        shift = middle + spread / m * (0 if not attempt else rng.uniform(-1, 1) * min(1.0, attempt / 8))
        p = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
        k = round(float(np.trace(p)))
        if not 0 < k < m or np.linalg.norm(p @ p - p) > 1e-10 * m:
            continue
        basis = np.linalg.qr(p @ rng.standard_normal((m, k)))[0]
        for _ in range(3):
            whole = np.linalg.qr(p @ basis, mode="complete")[0]
            basis = whole[:, :k]
            if np.linalg.norm(whole[:, k:].T @ a @ basis) <= 1e-15 * m * scale:
                return whole, k
        if np.linalg.norm(whole[:, k:].T @ a @ basis) <= 1e-13 * m * scale:
            return whole, k
    return None


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    m = len(a)
    a = (a + a.T) / 2
    scale, rng = float(np.linalg.norm(a)), np.random.default_rng(0)
    vectors, open_ = np.zeros((m, 0)), [np.eye(m)]
    while open_:
        basis = open_.pop()
        found = _split(basis.T @ a @ basis, scale, rng) if basis.shape[1] > 1 else None
        if found is None:
            vectors = np.hstack([vectors, basis])
        else:
            whole, k = found
            open_ += [basis @ whole[:, k:], basis @ whole[:, :k]]
    if m:
        vectors = vectors @ (1.5 * np.eye(m) - 0.5 * vectors.T @ vectors)
        vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _gram(d: np.ndarray) -> np.ndarray:
    """Exact d.T @ d of integers: floating products of as many rows as stay below 2**53, else whole numbers."""
    top = int(np.abs(d).max(initial=0)) + 1
    if top * top >= 1 << 53:
        wide = d.astype(object)
        return wide.T @ wide
    rows = max(1, (1 << 53) // (top * top))
    total = np.zeros((d.shape[1],) * 2, object)
    for i in range(0, len(d), rows):
        part = d[i: i + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


@dataclass(frozen=True)
class Fit:
    """What whitening needs: the row count, the sums, and the components with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of grid integers, centred, projected on the components and divided by their deviations."""
        d, rest = self._centred(x)
        return (d - rest / self.n) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)**2 per row, exact; null where it passes 64 bits."""
        d, rest = self._centred(x)
        narrow = (int(np.abs(d).max(initial=0)) + 1) * max(int(np.abs(d).max(initial=0)) + 1, self.n) * max(1, x.shape[1]) < 1 << 62
        d, rest = (d, rest) if narrow else (d.astype(object), rest.astype(object))
        square, cross, own = (d * d).sum(axis=1), (d * rest).sum(axis=1), sum(int(r) ** 2 for r in rest)
        found = [self.n ** 2 * int(s) - 2 * self.n * int(c) + own for s, c in zip(square, cross)]
        return [v if v < 1 << 63 else None for v in found]

    def _centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the floor of the means, and what is left of the sums."""
        floor = np.array([s // self.n for s in self.sums], np.int64)
        return x - floor, np.array([s % self.n for s in self.sums], np.int64)


@dataclass(frozen=True)
class Whitening:
    """Whitens vectors on the grid floor(``scale`` * c) + ``offset`` along their first ``top`` components.

    Vectors that are null or hold null, NaN or infinite entries return no rows, nor do those with entries
    of which the grid value passes 2**52.  All vectors fitted have one length, the one that most have (of
    equally many the longer); others return no rows.  Components without variance (below 1e-13 of the
    largest) cannot be whitened and are left out, so tables of few or equal vectors have fewer than ``top``, an
    empty table or one vector none.  Repeated vectors weigh repeatedly.  Null ids stay; other columns
    are ignored, whatever their names.  The driver holds a few matrices as wide as a vector.
    """

    top: int = 32
    scale: int = 64
    offset: int = 1_000_000
    id: str = "vec_id"
    vector: str = "embedding"

    def rows(self, table: DataFrame) -> DataFrame:
        """(id, v) of the vectors that remain, as long as most of them."""
        kept = table.select(F.col(self.id).alias("id"), F.col(self.vector).cast("array<double>").alias("v")).where(self._usable(F.col("v")))
        sizes = kept.groupBy(F.size("v").alias("k")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("k"))
        most = sizes.first()
        return kept.where(F.size("v") == (most["k"] if most else 0))

    def _usable(self, v: Column) -> Column:
        inside = lambda c: F.coalesce(F.abs(c) < float(GRID_LIMIT // self.scale), F.lit(False))
        return v.isNotNull() & (F.size(v) > 0) & F.forall(v, inside)

    def grid(self, vectors: pa.Array) -> np.ndarray:
        flat = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
        return np.floor(self.scale * flat).astype(np.int64) + self.offset

    def fit(self, rows: DataFrame) -> Fit | None:
        """Components of the rows' covariance; None without any variance."""
        rows = _few(rows.select("v"))
        n, sums = self._sums(rows)
        if not n:
            return None
        floor = np.array([s // n for s in sums], np.int64)
        rest = [s % n for s in sums]
        products = self._products(rows, floor)
        scatter = np.array([[products[min(i, j), max(i, j)] * n - rest[i] * rest[j] for j in range(len(sums))] for i in range(len(sums))],
                           object)
        covariance = np.array([[float(Decimal(int(v)) / (n * n)) for v in row] for row in scatter])
        values, vectors = components(covariance)
        trace = float(np.trace(covariance))
        keep = values[: self.top] > max(0.0, 1e-13 * float(values[0]))
        if not keep.any():
            return None
        return Fit(n, tuple(sums), values[: self.top][keep], vectors[:, : self.top][:, keep], trace)

    def _sums(self, rows: DataFrame) -> tuple[int, list[int]]:
        def add(batches):
            n, total = 0, None
            for batch in batches:
                x = self.grid(batch.column(0))
                part = x.astype(object).sum(axis=0) if len(x) and np.abs(x).max() > 1 << 40 else x.sum(axis=0)
                n, total = n + len(x), part.astype(object) if total is None else total + part
            if total is not None and n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)),
                     pa.array([n] * len(total), pa.int64())], ["i", "s", "n"])

        found = rows.mapInArrow(add, "i int, s decimal(38,0), n long").groupBy("i").agg(
            F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
        return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])

    def _products(self, rows: DataFrame, floor: np.ndarray) -> dict[tuple[int, int], int]:
        def multiply(batches):
            total = None
            for batch in batches:
                part = _gram(self.grid(batch.column(0)) - floor)
                total = part if total is None else total + part
            if total is not None:
                at = np.triu_indices(len(floor))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()),
                     pa.array([Decimal(int(t)) for t in total[at]], pa.decimal128(38, 0))], ["i", "j", "p"])

        found = rows.mapInArrow(multiply, "i int, j int, p decimal(38,0)").groupBy("i", "j").agg(
            F.sum("p").cast("decimal(38,0)").alias("p"))
        return {(r["i"], r["j"]): int(r["p"]) for r in found.collect()}

    def identity_error(self, rows: DataFrame, fit: Fit) -> float:
        """Largest entry by which the covariance of the whitened rows differs from the identity."""
        k = len(fit.values)

        def multiply(batches):
            total = np.zeros((k + 1, k + 1))
            for batch in batches:
                w = fit.whitened(self.grid(batch.column(0)))
                w = np.hstack([w, np.ones((len(w), 1))])
                total += w.T @ w
            i, j = np.triu_indices(k + 1)
            yield pd.DataFrame({"i": i, "j": j, "p": total[i, j]}).pipe(pa.RecordBatch.from_pandas, preserve_index=False)

        found = _few(rows.select("v")).mapInArrow(multiply, "i long, j long, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
        total = {(r["i"], r["j"]): r["p"] / fit.n for r in found.collect()}
        return max(abs(total[i, j] - total[i, k] * total[j, k] - (i == j)) for i in range(k) for j in range(i, k))

    def transform(self, table: DataFrame) -> DataFrame:
        """id, component, n, deviation, whitened, explained and identity_error per vector and component."""
        rows = self.rows(table)
        kind = rows.schema["id"].dataType.simpleString()
        out = (f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
        fit = self.fit(rows)
        if fit is None:
            return table.sparkSession.createDataFrame([], out).withColumnRenamed("id", self.id)
        error, k = self.identity_error(rows, fit), len(fit.values)

        def whiten(batches):
            for batch in batches:
                x = self.grid(batch.column(1))
                count = len(x)
                each = np.repeat(np.arange(count), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                     pa.array(np.full(count * k, fit.n)), pa.array(fit.deviations(x), pa.int64()).take(pa.array(each)),
                     pa.array(fit.whitened(x).ravel()), pa.array(np.tile(fit.explained, count)), pa.array(np.full(count * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return rows.mapInArrow(whiten, out).withColumnRenamed("id", self.id)


def _few(rows: DataFrame) -> DataFrame:
    """Fewer, longer tasks: each ends with one matrix, so there should be as many as cores, not as files."""
    return rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)
