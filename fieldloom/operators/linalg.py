"""Gram matrices, moments, empirical orthogonal functions, projection and canonical correlation.

Wide data meet in small matrices: partitions reduce their rows to partial products in blocked matrix multiplications
(float64 sums), only these are shuffled, and the eigenproblem of the small side is solved on the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .staging import Staged, beside


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    x = batch.column(column)
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1) if len(x) else np.zeros((0, 0))


def _partial_products(column: str, centre_free: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _rows(b, column)
            if not len(x):
                continue
            if centre_free:
                x = np.hstack((np.ones((len(x), 1)), x))
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _summed_rows(partial: DataFrame) -> DataFrame:
    """(i, row) summed by i: a task gathers one row of every partition's matrix."""

    def add(table: pa.Table) -> pa.Table:
        return pa.table([table.column("i").slice(0, 1), _list(_total(table.column("row")))], ["i", "row"])

    return partial.groupBy("i").applyInArrow(add, "i int, row array<double>")


def _summed(partial: DataFrame) -> DataFrame:
    return _summed_rows(partial).select("i", F.posexplode("row").alias("j", "value"))


#: Days of a block of the Gram matrix at most: a pair of blocks is a product of 32 MB, and the more days a block has, the
#: fewer times each field is sent.
MOST_DAYS = 2048
#: Bytes of a block of days that is read again for each block that it meets.
BLOCK_BYTES = 1 << 23
#: Days of a block whose products are written at a time.
SLAB_DAYS = 64


def gram_blocks(days: int, cores: int) -> int:
    """Blocks into which so many days go: enough pairs to keep the cores busy, none of too many days."""
    return max(1, -(-days // MOST_DAYS), min(-(-days // 256), int(np.ceil(np.sqrt(6 * cores)))))


def tiles(df: DataFrame, key: str, column: str, blocks: int, pixels: int) -> DataFrame:
    """(d, p, keys, x) of df(key, column): the values of one of so many blocks of keys (any whole numbers) and of so many pixels
    as one matrix, row by row.

    A field of any width becomes matrices of bounded size; only its own slices are shuffled.
    """
    starts = F.sequence(F.lit(0), F.floor((F.size(column) - 1) / pixels).cast("int"))
    parts = df.where(F.col(key).isNotNull() & (F.size(column) > 0)).select(F.col(key).alias("k"), F.col(column).alias("x"), F.explode(starts).alias("p"))
    parts = parts.select(F.pmod(F.xxhash64("k"), F.lit(blocks)).alias("d"), "p", F.struct("k", F.slice("x", F.col("p") * pixels + 1, F.lit(pixels)).alias("x")).alias("r"))
    rows = parts.groupBy("d", "p").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return rows.select("d", "p", F.col("r.k").alias("keys"), F.flatten("r.x").alias("x"))


def _matrix(batch: pa.RecordBatch, at: int, keys: str, values: str) -> tuple[np.ndarray, np.ndarray]:
    k, x = (batch.column(c).slice(at, 1).flatten().to_numpy(zero_copy_only=False) for c in (keys, values))
    return k, x.astype(np.float64).reshape(len(k), -1)


def _list(x: np.ndarray) -> pa.Array:
    """One list item with the values of x."""
    return pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel()))


def _total(column: pa.ChunkedArray) -> np.ndarray:
    """The sum of lists of equal length."""
    return sum(v.values.to_numpy() for v in column)


def _cells(i: np.ndarray, j: np.ndarray, total: np.ndarray, mirrored: bool = False) -> Iterator[pa.RecordBatch]:
    """(i, j, value) of a product of blocks of days, some days at a time."""
    for a in range(0, len(i), SLAB_DAYS):
        part = total[a : a + SLAB_DAYS]
        x, y, v = np.repeat(i[a : a + SLAB_DAYS], len(j)), np.tile(j, len(part)), part.ravel()
        for one, two in ((x, y), (y, x))[: 1 + mirrored]:
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(v)], ["i", "j", "value"])


def gram(t: DataFrame, blocks: int, days: int, pixels: int) -> DataFrame:
    """(i, j, value) of the Gram matrix of all keys of tiles() of so many blocks; fields have so many pixels.

    Fields of few pixels are written once to the shared folder, a block a row, and each task reads the two blocks of a pair
    there, so that nothing is shuffled for pairs. Blocks too large for one row are sent to their pairs (gram_tiles).
    """
    if -(-days // blocks) * pixels * 8 > BLOCK_BYTES:
        return gram_tiles(t, blocks)
    rows = t.repartitionByRange(blocks, "d").groupBy("d").agg(F.sort_array(F.collect_list(F.struct("p", "keys", "x"))).alias("a")).select("a")

    def block(batch: pa.RecordBatch, at: int, column: str) -> tuple[np.ndarray, np.ndarray]:
        _, keys, x = batch.column(column).slice(at, 1).flatten().flatten()
        k = keys[0].values.to_numpy()
        return k, np.hstack([v.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(k), -1) for v in x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                (i, x), (j, y) = block(batch, at, "a"), block(batch, at, "b")
                yield from _cells(i, j, x @ y.T)

    return beside(Staged(rows, "days").df, blocks).mapInArrow(run, "i long, j long, value double")


def gram_tiles(t: DataFrame, blocks: int) -> DataFrame:
    """(i, j, value) of the Gram matrix of all keys of tiles() of so many blocks.

    A tile is sent to each pair of blocks that it is in. A pair's tiles come one after another by range of pixels, so that a task
    adds up the pair's product, whose size is that of two blocks, and only tiles are shuffled. The other triangle is mirrored.
    """
    pairs = blocks * (blocks + 1) // 2
    sent = t.select(F.col("d").cast("long").alias("d"), F.col("p").cast("long").alias("p"), "keys", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("e"))
    sent = sent.select(F.least("d", "e").alias("ad"), F.greatest("d", "e").alias("bd"), "p", "d", "keys", "x")
    sent = sent.repartition(min(pairs, 4096), "ad", "bd").sortWithinPartitions("ad", "bd", "p", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = at = first = done = None
        for batch in batches:
            for n in range(len(batch)):
                a, b, p, d = (batch.column(c)[n].as_py() for c in ("ad", "bd", "p", "d"))
                if (a, b) != pair:
                    if done is not None:
                        yield from _cells(*done, pair[0] != pair[1])
                    pair, at, done = (a, b), None, None
                tile = _matrix(batch, n, "keys", "x")
                if d == a:
                    at, first = p, tile
                if d == b and at == p:  # a range of pixels that only one of the blocks has counts for nothing
                    (i, x), (j, y) = first, tile
                    if done is None:
                        done = i, j, x @ y.T
                    else:
                        done[2][:] += x @ y.T
        if done is not None:
            yield from _cells(*done, pair[0] != pair[1])

    return sent.mapInArrow(run, "i long, j long, value double")


#: Bytes of a matrix that may come to the driver or be sent to the tasks.
MOST_BYTES = 1 << 28


def _checked(size: int) -> None:
    if size * size * 8 > MOST_BYTES:
        raise ValueError(f"a matrix of {size} by {size} is too large for one place; use gram_tiles")


def moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and covariance (n - 1) of an array column, from one pass. The matrix, of checked size, goes to
    the driver."""
    _checked(df.agg(F.max(F.size(column))).first()[0] or 0)
    rows = {r.i: np.array(r.row) for r in _summed_rows(df.select(column).mapInArrow(_partial_products(column, True), "i int, row array<double>")).toLocalIterator()}
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    s = np.stack([rows[i] for i in range(len(rows))])
    n = int(round(s[0, 0]))
    mean = s[0, 1:] / n
    return n, mean, (s[1:, 1:] - n * np.outer(mean, mean)) / max(1, n - 1)


def covariance_cells(df: DataFrame, column: str, block: int = 1024) -> DataFrame:
    """(i, j, value): the covariance (n - 1) of an array column, as a distributed table. Nothing of it comes to the driver.

    Partitions multiply their centred rows a pair of blocks of columns at a time, so that a task holds its own sums of one
    matrix at most, and each row of blocks is summed by itself.
    """
    size = df.agg(F.max(F.size(column))).first()[0] or 0
    sums = df.select(F.posexplode(column).alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"), F.count("v").alias("n")).toArrow()
    mean, n = np.zeros(size), max(sums.column("n").to_pylist(), default=0)
    mean[sums.column("j").to_numpy()] = sums.column("m").to_numpy()
    blocks = [(a, b) for a in range(0, size, block) for b in range(0, size, block)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = _rows(batch, column) - mean
            for a, b in blocks:
                part = x[:, a : a + block].T @ x[:, b : b + block]
                total[a, b] = total[a, b] + part if (a, b) in total else part
        for (a, b), part in total.items():
            at = pa.array(np.arange(a, a + len(part)), pa.int32())
            yield pa.RecordBatch.from_arrays([at, pa.array([b] * len(part), pa.int32()), pa.array(list(part), pa.list_(pa.float64()))], ["i", "b", "row"])

    def add(table: pa.Table) -> pa.Table:
        total = _total(table.column("row")) / max(1, n - 1)
        i, first = table.column("i")[0].as_py(), table.column("b")[0].as_py()
        return pa.table([pa.array(np.full(len(total), i, np.int32)), pa.array(np.arange(first, first + len(total), dtype=np.int32)), pa.array(total)], ["i", "j", "value"])

    return df.select(column).mapInArrow(multiply, "i int, b int, row array<double>").groupBy("i", "b").applyInArrow(add, "i int, j int, value double")


def moments_by(df: DataFrame, by: str, column: str) -> dict:
    """For each of a few groups: number of rows, mean and mean of the outer products of an array column."""
    _checked(df.agg(F.max(F.size(column))).first()[0] or 0)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            x = _rows(b, column)
            groups = np.array(b.column(by).to_pylist())
            for g in np.unique(groups).tolist():
                part = np.hstack((np.ones((int((groups == g).sum()), 1)), x[groups == g]))
                total[g] = total[g] + part.T @ part if g in total else part.T @ part
        for g, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(m), arrow), pa.array(np.arange(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], [by, "i", "row"])

    kind, arrow = df.schema[by].dataType.simpleString(), to_arrow_type(df.schema[by].dataType)
    sums = df.select(by, column).mapInArrow(multiply, f"{by} {kind}, i int, row array<double>")

    def add(table: pa.Table) -> pa.Table:
        return pa.table([table.column(by).slice(0, 1), table.column("i").slice(0, 1), _list(_total(table.column("row")))], [by, "i", "row"])

    rows: dict = {}
    for r in sums.groupBy(by, "i").applyInArrow(add, f"{by} {kind}, i int, row array<double>").toLocalIterator():
        rows.setdefault(r[by], {})[r.i] = np.array(r.row)
    out: dict = {}
    for g in sorted(rows):
        m = np.stack([rows[g][i] for i in range(len(rows[g]))])
        out[g] = int(round(m[0, 0])), m[0, 1:] / m[0, 0], m[1:, 1:] / m[0, 0]
    return out


@dataclass
class Eigen:
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def temporal_modes(g: np.ndarray, most: int) -> Eigen:
    """Eigenpairs of a Gram matrix, largest first, negatives set to 0. The trace is that of all modes."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(values)[::-1][:most]
    return Eigen(np.maximum(values[order], 0.0), vectors[:, order], float(np.trace(g)))


def rotation(e: Eigen) -> np.ndarray:
    """Weights that turn days into orthonormal modes: vectors over singular values, zero for null modes."""
    s = np.sqrt(e.values)
    return np.where(s > 1e-10 * s.max(initial=0.0), e.vectors / np.where(s > 0, s, 1.0), 0.0)


def apply_matrix(df: DataFrame, column: str, matrix: np.ndarray, out: str, keep: list[str], offset: np.ndarray | None = None) -> DataFrame:
    """keep and out = (column - offset) @ matrix, batch by batch. The matrix (of checked size) goes to the tasks."""
    if matrix.nbytes > MOST_BYTES:
        raise ValueError("split the matrix by columns: more than 256 MB would be sent to each task")
    shared = df.sparkSession.sparkContext.broadcast((np.ascontiguousarray(matrix, np.float64), offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, o = shared.value
        for b in batches:
            x = _rows(b, "_in")
            if len(x):
                y = (x if o is None else x - o) @ m
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(list(y), pa.list_(pa.float64()))], [*keep, out])

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, F.col(column).alias("_in")).mapInArrow(run, f"{fields}, {out} array<double>")


@dataclass
class Basis:
    modes: np.ndarray  # one orthonormal row a mode
    mean: np.ndarray
    eigen: Eigen

    def explained(self) -> np.ndarray:
        return self.eigen.values / self.eigen.trace

    def orthonormality_error(self) -> float:
        return float(np.abs(self.modes @ self.modes.T - np.eye(len(self.modes))).max())


def fit_basis(fields: DataFrame, column: str, sqrt_w: np.ndarray, most: int) -> Basis:
    """Weighted modes of fields (a row a day) of few pixels, from the pixel covariance summed over partitions.

    Where pixels are many, strips.fit_wide_basis gives the same modes without a matrix of pixels or of days.
    """
    n, mean, cov = moments(fields, column)
    e = temporal_modes(cov * (n - 1) * np.outer(sqrt_w, sqrt_w), most)
    return Basis(e.vectors.T, mean, e)


def mode_products(modes: DataFrame) -> DataFrame:
    """(a, b, value): inner products of modes(mode, pixel, value), one partial matrix a partition. An orthonormal set has ones
    and zeros."""
    count = modes.agg(F.max("mode")).first()[0]
    count = 0 if count is None else count + 1
    rows = modes.groupBy("pixel").agg(F.sort_array(F.collect_list(F.struct("mode", "value"))).alias("m")).select(F.col("m.value").alias("v"))
    return _summed(rows.where(F.size("v") == count).mapInArrow(_partial_products("v", False), "i int, row array<double>")).select(F.col("i").alias("a"), F.col("j").alias("b"), "value")


@dataclass
class Factor:
    """A covariance as axes and the deviation along each, so that whitening and its reverse are two thin matrices."""

    axes: np.ndarray  # a column an axis
    deviation: np.ndarray
    lost: int  # axes without enough variance

    @classmethod
    def of(cls, covariance: np.ndarray, ridge: float = 0.0, floor: float = 1e-12) -> Factor:
        """The axes whose variance is over floor times the largest. Raises ValueError if none has any."""
        left, variance, _ = np.linalg.svd((covariance + covariance.T) / 2, hermitian=True)
        sign = np.sign(np.einsum("ij,ij->j", left, (covariance + covariance.T) / 2 @ left))  # singular values have lost theirs
        variance = variance * sign + ridge
        top = variance.max(initial=0.0)
        if not 0 < top < np.inf:
            raise ValueError("a covariance without variance")
        enough = variance > floor * top
        return cls(left[:, enough], variance[enough] ** 0.5, len(variance) - int(enough.sum()))

    def whitening(self) -> np.ndarray:
        return self.axes / self.deviation

    def colouring(self) -> np.ndarray:
        return (self.axes * self.deviation).T


@dataclass
class Canonical:
    """A truncated regression as its factors: x to canonical variates, their correlations, and variates to y."""

    into: np.ndarray
    rho: np.ndarray
    out: np.ndarray
    rank: int
    x_mean: np.ndarray
    y_mean: np.ndarray

    @property
    def b(self) -> np.ndarray:
        r = self.rank
        return self.into[:, :r] @ np.diag(self.rho[:r].clip(0)) @ self.out[:r]

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep and y_hat = (x - mean) @ b + mean."""
        out = apply_matrix(df, "x", self.b, "y_hat", keep, self.x_mean)
        mean = F.array(*[F.lit(float(v)) for v in self.y_mean])
        return out.withColumn("y_hat", F.zip_with("y_hat", mean, lambda a, m: a + m))


class ScoreMoments:
    """Moments of scores (x then y), from which regressions of any size are fitted without another pass."""

    def __init__(self, z: DataFrame, width: int = 32):
        _, self.mean, self.cov = moments(z, "xy")
        self.width = width
        self._factor = functools.lru_cache(maxsize=None)(lambda begin, size, ridge: Factor.of(self.cov[begin : begin + size, begin : begin + size], ridge))
        self._pair = functools.lru_cache(maxsize=None)(self._variates)

    def _variates(self, kx: int, ky: int, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = self._factor(0, kx, ridge), self._factor(self.width, ky, ridge)
        across = x.whitening().T @ self.cov[:kx, self.width : self.width + ky] @ y.whitening()
        left, rho, right = np.linalg.svd(across, full_matrices=False)
        return x.whitening() @ left, rho, right @ y.colouring()

    def canonical(self, kx: int, ky: int, rank: int, ridge: float = 0.0) -> Canonical:
        """The regression of the first ky scores of y on the first kx of x, over the leading canonical pairs."""
        return Canonical(*self._pair(kx, ky, ridge), rank, self.mean[:kx], self.mean[self.width : self.width + ky])


def grid_search(z: DataFrame, val: DataFrame, settings: list[tuple[int, int, int]], width: int = 32) -> list[dict]:
    """Validation error of each (kx, ky, rank), from the validation moments alone: no pass over data for a setting.

    A setting that fails keeps its row, with the failure as its status.
    """
    fit = ScoreMoments(z, width)
    n, mean, cov = moments(val, "xy")
    second = cov * (n - 1) + n * np.outer(mean, mean)
    rows = []
    for kx, ky, rank in settings:
        row = {"kx": kx, "ky": ky, "rank": rank, "mse": None, "status": "ok"}
        try:
            m = fit.canonical(kx, ky, rank)
            b = np.zeros((width, width))
            b[:kx, :ky] = m.b
            a = np.zeros(width)
            a[:ky] = m.y_mean - m.x_mean @ m.b
            xx, xy, yy = second[:width, :width], second[:width, width:], np.trace(second[width:, width:])
            sx, sy = n * mean[:width], n * mean[width:]
            pred2 = np.trace(b.T @ xx @ b) + 2 * sx @ b @ a + n * a @ a
            cross = np.trace(b.T @ xy) + a @ sy
            row["mse"] = float(max(0.0, yy + pred2 - 2 * cross) / (n * width))
        except (ValueError, np.linalg.LinAlgError) as e:
            row["status"] = f"failed: {e}"
        rows.append(row)
    return rows


def shrunk_factor(n: int, covariance: np.ndarray, fourth: float, floor: float = 1e-12) -> tuple[float, Factor]:
    """Share and factor of the covariance shrunk towards a multiple of the identity (Ledoit and Wolf).

    Shrinking moves the variances along the axes towards their mean, so the share follows from these alone and from
    fourth, the sum over rows of |z|**4. Variances under floor times the largest are raised to that.
    """
    variance, axes = np.linalg.eigh(covariance)
    spread = float(np.var(variance) * len(variance))
    noise = (fourth - (n - 2) * float(variance @ variance)) / n**2
    share = float(np.clip(noise / spread, 0.0, 1.0)) if spread else 1.0
    variance = variance + share * (variance.mean() - variance)
    return share, Factor(axes, np.sqrt(variance.clip(floor * variance.max())), 0)


def dct_basis(k: int, p: int) -> np.ndarray:
    """k orthonormal cosine modes over p pixels."""
    i = np.arange(p) + 0.5
    e = np.sqrt(2.0 / p) * np.cos(np.pi * np.arange(k)[:, None] * i[None, :] / p)
    e[0] = np.sqrt(1.0 / p)
    return e
