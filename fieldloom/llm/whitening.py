"""Whitening of embeddings by LOBPCG over covariance products that partitions compute from their own rows.

No covariance matrix exists anywhere: an iteration sends a block of directions to the partitions, each multiplies it
with its centred rows (twice, from both sides), and the sums, dimensions by directions, come back. Rayleigh-Ritz on the
iterates, their residuals and the previous directions gives the next block. What is returned is certified by a fresh
product: the residual of every component that whitens is under TOLERANCE times the largest eigenvalue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 32
#: Directions beyond the wanted ones: they make the last of these converge.
GUARD = 8
TOLERANCE = 1e-12
#: Components of less variance than this share of the largest are noise of rounding and can't be whitened.
FLOOR = 1e-11
MOST_ITERATIONS = 500
#: Bytes of a block of directions that may be sent to each task.
MOST_BYTES = 1 << 27
#: Partial sums are added in this many groups a dimension before they are added to one.
LANES = 16


def usable_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is not null, not empty and holds neither nulls nor NaN nor infinities."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    return df.where((F.size(vector) > 0) & F.forall(vector, finite))


def grid_values(vector: pa.Array) -> np.ndarray:
    """floor(64 * c) + 1000000 of each entry, a row a vector. All vectors have one length."""
    entries = pc.cast(vector.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    return (np.floor(64.0 * entries) + 1_000_000).astype(np.int64).reshape(len(vector), -1)


@dataclass(frozen=True)
class Centre:
    """The number of rows and the sums of their values by dimension."""

    n: int
    sums: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact as long as n times a value fits 63 bits."""
        return self.n * x - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return self.scaled(x) / self.n


def _row_sums(partial: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (i, lane, v) by i: within a lane first, so that no task gathers the partials of all tasks."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.stack([v.values.to_numpy() for v in chunk]).sum(axis=0) for chunk in table.column("v").chunks if len(chunk))
        return pa.table([table.column("i").slice(0, 1), pa.array([total], pa.list_(pa.float64()))], ["i", "v"])

    lanes = partial.groupBy("i", "lane").applyInArrow(add, "i int, v array<double>")
    return {r.i: np.array(r.v) for r in lanes.groupBy("i").applyInArrow(add, "i int, v array<double>").toLocalIterator()}


class Embeddings:
    """Vectors of one length with their centre, and products with their covariance."""

    def __init__(self, df: DataFrame, vector: str = "embedding"):
        vectors = usable_vectors(df, vector)
        lengths = vectors.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
        self.size = lengths[0]["size"] if lengths else 0
        self.vector, self.rows = vector, vectors.where(F.size(vector) == self.size)
        self.vectors = self.rows.select(F.col(vector).alias("vector"))
        self.centre = self._centre()

    def _centre(self) -> Centre:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, None
            for b in batches:
                if len(b):
                    x = grid_values(b.column("vector"))
                    n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(total), pa.int64()), pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["n", "i", "s"])

        sums = self.vectors.mapInArrow(run, "n long, i int, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
        return Centre(sums[0].n if sums else 0, np.array([r.s for r in sums], np.int64))

    def product(self, block: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance (divisor n) times a block of directions, and the covariance's trace: one job."""
        if block.nbytes > MOST_BYTES:
            raise ValueError("take fewer components at a time: a block of directions is sent to each task")
        shared = self.vectors.sparkSession.sparkContext.broadcast((self.centre, np.ascontiguousarray(block)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, w = shared.value
            total, trace, lane = None, 0.0, 0
            for b in batches:
                if len(b):
                    c = centre.centred(grid_values(b.column("vector")))
                    part = c.T @ (c @ w)
                    total, trace = part if total is None else total + part, trace + float(np.einsum("ij,ij->", c, c))
                    lane = int(abs(part).sum()) % LANES
            if total is not None:
                rows = np.hstack((total, np.zeros((len(total), 1))))
                rows[0, -1] = trace
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array([lane] * len(rows), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], ["i", "lane", "v"])

        sums = _row_sums(self.vectors.mapInArrow(run, "i int, lane int, v array<double>"))
        shared.destroy()
        out = np.stack([sums[i] for i in range(self.size)]) / self.centre.n
        return out[:, :-1], float(out[0, -1])


@dataclass
class Components:
    """Unit eigenvectors as columns, by falling eigenvalue, with the trace and the largest residual."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float

    def enough(self) -> np.ndarray:
        """Which components have variance to whiten."""
        return self.values > FLOOR * self.values.max(initial=0.0)

    def whitening(self) -> np.ndarray:
        """A column a component; one without variance has zeros."""
        return np.where(self.enough(), self.vectors / np.sqrt(np.where(self.enough(), self.values, 1.0)), 0.0)


def _added(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns that extend an orthonormal basis to the span of block, too. Columns that add nothing go."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-8]
    return block[:, : basis.shape[0] - basis.shape[1]]


def lobpcg(product: Callable[[np.ndarray], tuple[np.ndarray, float]], size: int, most: int, tolerance: float = TOLERANCE, seed: int = 0) -> Components:
    """The most largest eigenpairs of a symmetric operator. Raises ArithmeticError if they can't be certified."""
    most = min(most, size)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(size, most + GUARD))))[0]
    ax, trace = product(x)
    p = ap = np.zeros((size, 0))
    fresh = True
    for _ in range(MOST_ITERATIONS):
        theta, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        theta, x, ax = theta[::-1], x @ turn[:, ::-1], ax @ turn[:, ::-1]
        residual = ax - x * theta
        sizes = np.linalg.norm(residual, axis=0)
        top = max(float(theta[0]), 0.0)
        open_ = sizes > tolerance * top
        if not open_[:most].any():
            if fresh:
                return Components(np.maximum(theta[:most], 0.0), x[:, :most], trace, float(sizes[:most].max(initial=0.0)))
            x = np.linalg.qr(x)[0]  # certify what the recurrences say by a product of its own
            (ax, trace), p, ap, fresh = product(x), np.zeros((size, 0)), np.zeros((size, 0)), True
            continue
        r = _added(np.hstack((x, p)), residual[:, open_])
        if not r.shape[1] and not p.shape[1]:
            if fresh:
                raise ArithmeticError(f"residuals stay at {sizes[:most].max():.2g}, above {tolerance * top:.2g}")
            x = np.linalg.qr(x)[0]
            (ax, trace), fresh = product(x), True
            continue
        ar = product(r)[0] if r.shape[1] else np.zeros((size, 0))
        s, a = np.hstack((x, p, r)), np.hstack((ax, ap, ar))
        gram = s.T @ a
        _, ritz = np.linalg.eigh((gram + gram.T) / 2)
        m = x.shape[1]
        first = ritz[:, ::-1][:, :m]
        back = first.copy()
        back[:m] = 0.0
        back = _added(first, back)[:, :m]
        x, ax, p, ap, fresh = s @ first, a @ first, s @ back, a @ back, False
    raise ArithmeticError(f"no convergence in {MOST_ITERATIONS} iterations")


@dataclass
class Whitening:
    """A fitted whitening: centre, components and how far the covariance of what it gives is from the identity."""

    embeddings: Embeddings
    components: Components
    identity_error: float

    @classmethod
    def fit(cls, df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
        e = Embeddings(df, vector)
        if not e.centre.n:
            return cls(e, Components(np.zeros(0), np.zeros((0, 0)), 0.0, 0.0), 0.0)
        c = lobpcg(e.product, e.size, components)
        w = c.whitening()[:, c.enough()]
        got = w.T @ e.product(w)[0] if w.size else np.zeros((0, 0))
        return cls(e, c, float(np.abs(got - np.eye(len(got))).max(initial=0.0)))

    def apply(self, keep: str = "vec_id") -> DataFrame:
        """keep and, for each component of each row: component, n, deviation, whitened, explained, identity_error.

        A component without variance has null as whitened, 0 as explained and no part in identity_error. deviation is
        null where it doesn't fit 63 bits. Rows that usable_vectors() leaves out, and those whose vector has another
        length than most (the longer, if two are as frequent), have no rows. Equal rows and ids are all kept.
        """
        centre, c, error = self.embeddings.centre, self.components, self.identity_error
        matrix, enough, explained = c.whitening(), c.enough(), np.where(c.enough(), c.values / (c.trace or 1.0), 0.0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x = grid_values(b.column("vector"))
                scaled, rows, many = centre.scaled(x), len(x), len(enough)
                fits = np.einsum("ij,ij->i", scaled.astype(np.float64), scaled.astype(np.float64)) < 2.0**62.9
                deviation = pa.array(np.einsum("ij,ij->i", scaled, scaled), mask=~fits)
                white = pa.array((centre.centred(x) @ matrix).ravel(), mask=np.tile(~enough, rows))
                place = pa.array(np.repeat(np.arange(rows), many))
                columns = [b.column("_keep").take(place), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows)), pa.array(np.full(rows * many, centre.n)), deviation.take(place), white]
                columns += [pa.array(np.tile(explained, rows)), pa.array(np.full(rows * many, error))]
                yield pa.RecordBatch.from_arrays(columns, [keep, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        rows = self.embeddings.rows
        kind, rows = rows.schema[keep].dataType.simpleString(), rows.select(F.col(keep).alias("_keep"), F.col(self.embeddings.vector).alias("vector"))
        return rows.mapInArrow(run, f"{keep} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding along its first 32 components, as Whitening.apply() defines them."""
    return Whitening.fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).apply()
