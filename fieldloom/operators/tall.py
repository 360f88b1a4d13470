"""Canonical correlation of many scores over many days, where no matrix of scores by scores fits one place.

Days lie in chunks of bounded bytes, each with all its scores. The scores of x are orthonormalised a block of columns at a
time: a tree of triangular factors gives the block's own factor, one pass its products with the columns to its right, one
pass takes these out of them. What the driver holds is one panel (a block by the columns to its right); the panels lie in
the shared folder, and weights follow from them by solving triangular systems block by block. The scores of y are one
panel. Correlations of any leading scores of x and y come from the same factors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import MOST_BYTES
from .staging import Staged

#: Bytes of a chunk of days, and of a panel: a block of columns by all columns.
CHUNK_BYTES, PANEL_BYTES = 1 << 25, 1 << 25
BLOCK = 512
#: Bytes of the pieces in which panels are summed.
PIECE_BYTES = 1 << 16
#: Factors that one task of the tree joins, about.
FAN = 8
#: A column whose rest, once the columns before it are taken out, is under this share of it is left out.
DEPENDENT = 1e-10
#: A block of a larger condition is orthonormalised once more.
CONDITION = 1e4


def _list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def _matrix(batch: pa.RecordBatch, column: str, at: int, columns: int) -> np.ndarray:
    return batch.column(column).slice(at, 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)


def solve_right(w: np.ndarray, r: np.ndarray, base: int = 48) -> np.ndarray:
    """w @ inverse(r) of an upper triangular r, half by half."""
    n = len(r)
    if n <= base:
        return np.linalg.solve(r.T, w.T).T if n else w
    h = n // 2
    left = solve_right(w[:, :h], r[:h, :h], base)
    return np.hstack((left, solve_right(w[:, h:] - left @ r[:h, h:], r[h:, h:], base)))


def solve_upper(r: np.ndarray, b: np.ndarray, base: int = 48) -> np.ndarray:
    """inverse(r) @ b of an upper triangular r, half by half."""
    n = len(r)
    if n <= base:
        return np.linalg.solve(r, b) if n else b
    h = n // 2
    low = solve_upper(r[h:, h:], b[h:], base)
    return np.vstack((solve_upper(r[:h, :h], b[:h] - r[:h, h:] @ low, base), low))


def triangular_factor(rows: DataFrame, columns: int) -> np.ndarray:
    """The triangular factor of all rows of df(v), matrices of so many columns, by a tree: tasks join FAN factors or so, and
    none holds more than two. Empty tables give zeros."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(len(batch)):
                m = _matrix(batch, "v", at, columns)
                r = np.linalg.qr(m if r is None else np.vstack((r, m)), "r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([_list(r)], ["v"])

    level, tasks = rows.mapInArrow(join, "v array<double>"), rows.sparkSession.sparkContext.defaultParallelism
    while tasks > 1:
        tasks = -(-tasks // FAN)
        level = level.repartition(tasks).mapInArrow(join, "v array<double>")
    got = [np.array(x.v).reshape(-1, columns) for x in level.collect()]
    r = np.linalg.qr(np.vstack(got), "r") if got else np.zeros((0, columns))
    return np.vstack((r, np.zeros((columns - len(r), columns))))


def independent(r: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a triangular factor that those before them don't give, and the factor of these alone."""
    kept: list[int] = []
    basis = np.zeros((len(r), 0))
    for k in range(r.shape[1]):
        rest = r[:, k]
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        size = np.linalg.norm(rest)
        if size > DEPENDENT * norms[k]:
            kept.append(k)
            basis = np.hstack((basis, (rest / size)[:, None]))
    chosen = np.array(kept, int)
    return chosen, np.linalg.qr(r[:, chosen], "r") if len(chosen) else np.zeros((0, 0))


@dataclass
class _Turn:
    """What makes a block orthonormal: its columns that count, and one or two triangular factors to solve by."""

    chosen: np.ndarray
    factors: list[np.ndarray]

    def apply(self, w: np.ndarray) -> np.ndarray:
        w = w[:, self.chosen]
        for r in self.factors:
            w = solve_right(w, r)
        return w

    @property
    def whole(self) -> np.ndarray:
        out = np.eye(len(self.chosen))
        for r in self.factors:
            out = r @ out
        return out


class TallCanonical:
    """Factors of df(x, y) from which canonical correlations and weights of leading scores follow.

    df has one row a day, x and y arrays of equal lengths on all rows; the order of rows doesn't matter. ridge is added to
    the variances (divisor n - 1) of both sides. Columns that others before them give have no weight.
    """

    def __init__(self, df: DataFrame, ridge: float = 0.0, block: int = BLOCK):
        self.spark = df.sparkSession
        kinds = df.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.min(F.size("y")), F.max(F.size("y"))).first()
        self.n, self.kx, self.ky = kinds[0], kinds[2] or 0, kinds[4] or 0
        if not self.n or kinds[1] != self.kx or kinds[3] != self.ky or not self.kx or not self.ky:
            raise ValueError(f"{self.n} rows of {kinds[1]} to {self.kx} and {kinds[3]} to {self.ky} scores: rows of equal sizes are needed")
        if 8 * self.ky**2 > PANEL_BYTES:
            raise ValueError("y has too many scores for one panel: let it be the smaller side")
        self.block = max(1, min(block, PANEL_BYTES // (8 * (self.kx + self.ky))))
        self.mean = self._means(df)
        self.panels: list[tuple[Staged, np.ndarray, _Turn]] = []
        self._factor(df, ridge)

    def _means(self, df: DataFrame) -> np.ndarray:
        n, columns = self.n, self.kx + self.ky

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(columns)
            for b in batches:
                if len(b):
                    total += _matrix_rows(b, self_kx, columns - self_kx).sum(axis=0)
            for k in range(0, columns, 1024):
                yield pa.RecordBatch.from_arrays([pa.array([k // 1024], pa.int32()), _list(total[k : k + 1024])], ["piece", "v"])

        self_kx = self.kx
        return self._collect(_sums(df.select("x", "y").mapInArrow(run, "piece int, v array<double>")), 1, columns, 1024)[0] / n

    @staticmethod
    def _collect(panel: DataFrame, rows: int, columns: int, piece: int) -> np.ndarray:
        out = np.zeros((rows, columns))
        for r in panel.toLocalIterator():
            v = np.array(r.v).reshape(rows, -1)
            out[:, r.piece * piece : r.piece * piece + v.shape[1]] = v
        return out

    def _chunks(self, df: DataFrame, ridge: float) -> tuple[DataFrame, np.ndarray]:
        """(v, r): centred days by all scores, x first, and the factor of y's columns. And each column's length."""
        kx, ky, mean = self.kx, self.ky, self.mean
        most = max(1, CHUNK_BYTES // (8 * (kx + ky)))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for b in batches:
                for first in range(0, len(b), most):
                    held.append(_matrix_rows(b.slice(first, most), kx, ky) - mean)
                    if sum(map(len, held)) >= most:
                        yield whole(held)
                        held = []
            if held:
                yield whole(held)

        def whole(held: list[np.ndarray]) -> pa.RecordBatch:
            m = np.vstack(held)
            return pa.RecordBatch.from_arrays([_list(m), _list(np.linalg.qr(m[:, kx:], "r")), _list((m * m).sum(axis=0))], ["v", "r", "s"])

        chunks = df.select("x", "y").mapInArrow(cut, "v array<double>, r array<double>, s array<double>")
        if ridge:
            size, rows = float(np.sqrt(ridge * (self.n - 1))), max(1, min(most, 256))

            def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for first in b.column("id").to_pylist():
                        at = np.arange(first * rows, min((first + 1) * rows, kx + ky))
                        m = np.zeros((len(at), kx + ky))
                        m[np.arange(len(at)), at] = size
                        yield whole([m])

            chunks = chunks.union(self.spark.range(-(-(kx + ky) // rows)).mapInArrow(more, "v array<double>, r array<double>, s array<double>"))
        staged = Staged(chunks, "tall-chunks")
        self._live = staged
        squares = staged.df.select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).toArrow()
        norms = np.zeros(kx + ky)
        norms[squares.column("k").to_numpy()] = np.sqrt(squares.column("s").to_numpy())
        return staged.df.select("v", "r"), norms

    def _turn(self, chunks: DataFrame, r: np.ndarray, norms: np.ndarray, width: int, at: Callable[[np.ndarray], np.ndarray]) -> _Turn:
        """From a block's triangular factor, and from another of what it leaves where the block is ill-conditioned."""
        chosen, factor = independent(r, norms)
        turn = _Turn(chosen, [factor])
        if len(chosen) and np.linalg.cond(factor) > CONDITION:

            def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for k in range(len(b)):
                        yield pa.RecordBatch.from_arrays([_list(np.linalg.qr(turn.apply(at(_matrix(b, "v", k, width))), "r"))], ["v"])

            second = triangular_factor(chunks.select("v").mapInArrow(again, "v array<double>"), len(chosen))
            turn = _Turn(chosen, [factor, second])
        return turn

    def _factor(self, df: DataFrame, ridge: float) -> None:
        kx, ky = self.kx, self.ky
        chunks, norms = self._chunks(df, ridge)
        of_y = triangular_factor(chunks.select(F.col("r").alias("v")), ky)
        self.y = self._turn(chunks, of_y, norms[kx:], kx + ky, lambda m: m[:, kx:])
        self.qy, self.colour = len(self.y.chosen), self.y.apply(of_y).T @ of_y
        chunks = self._next(chunks, kx + ky, min(self.block, kx), lambda m, y=self.y: np.hstack((m[:, :kx], y.apply(m[:, kx:]))))
        first = 0
        while first < kx:
            c, rest = min(self.block, kx - first), kx - first
            width = rest + self.qy
            turn = self._turn(chunks, triangular_factor(chunks.select(F.col("r").alias("v")), c), norms[first : first + c], width, lambda m, c=c: m[:, :c])
            panel = self._products(chunks, turn, c, width)
            kept = Staged(self.spark.createDataFrame(pa.table([_list(panel)], ["v"])), "tall-panel")
            self.panels.append((kept, first + turn.chosen, turn))
            first += c
            if first < kx:
                rest -= c

                def update(m: np.ndarray, turn: _Turn = turn, panel: np.ndarray = panel, c: int = c, rest: int = rest) -> np.ndarray:
                    return np.hstack((m[:, c : c + rest] - turn.apply(m[:, :c]) @ panel[:, :rest], m[:, c + rest :]))

                chunks = self._next(chunks, width, min(self.block, rest), update)
        self._live.drop()

    def _next(self, chunks: DataFrame, width: int, ahead: int, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """Chunks after a change, with the factor of their first columns, in place of those before."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(len(b)):
                    m = change(_matrix(b, "v", k, width))
                    yield pa.RecordBatch.from_arrays([_list(m), _list(np.linalg.qr(m[:, :ahead], "r"))], ["v", "r"])

        before, self._live = self._live, Staged(chunks.select("v").mapInArrow(run, "v array<double>, r array<double>"), "tall-chunks")
        before.drop()
        return self._live.df

    def _products(self, chunks: DataFrame, turn: _Turn, c: int, width: int) -> np.ndarray:
        """The orthonormal block against all columns to its right: one panel, summed in pieces of columns."""
        size = len(turn.chosen)
        piece = max(1, PIECE_BYTES // (8 * max(1, size)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for k in range(len(b)):
                    m = _matrix(b, "v", k, width)
                    part = turn.apply(m[:, :c]).T @ m[:, c:]
                    total = part if total is None else total + part
            for k in range(0, width - c if total is not None else 0, piece):
                yield pa.RecordBatch.from_arrays([pa.array([k // piece], pa.int32()), _list(total[:, k : k + piece])], ["piece", "v"])

        if not size:
            return np.zeros((0, width - c))
        return self._collect(_sums(chunks.select("v").mapInArrow(run, "piece int, v array<double>")), size, width - c, piece)

    def drop(self) -> None:
        """Delete the panels."""
        for staged, *_ in self.panels:
            staged.drop()

    def _panel(self, j: int) -> np.ndarray:
        staged, chosen, _ = self.panels[j]
        return np.array(staged.df.first().v).reshape(len(chosen), -1) if len(chosen) else np.zeros((0, 0))

    def _across(self, j: int, panel: np.ndarray, kx: int, ky: int) -> np.ndarray:
        """Rows of x's orthonormal block against the leading columns of y's."""
        rows = int((self.panels[j][1] < kx).sum())
        return panel[:rows, panel.shape[1] - self.qy :][:, : int((self.y.chosen < ky).sum())] if rows else np.zeros((0, int((self.y.chosen < ky).sum())))

    def pair(self, kx: int | None = None, ky: int | None = None, rank: int | None = None) -> TallPair:
        """Correlations and weights of the leading kx scores of x and ky of y, over the leading canonical pairs."""
        return self.pairs([(kx or self.kx, ky or self.ky, rank)])[0]

    def pairs(self, sizes: list[tuple[int, int, int | None]]) -> list[TallPair]:
        """pair() of each (kx, ky, rank): two passes over the panels for all of them, with one panel at a time in the driver's
        memory. Weights are kx by rank."""
        width = {ky: int((self.y.chosen < ky).sum()) for _, ky, _ in sizes}
        factors = [np.zeros((0, width[ky])) for _, ky, _ in sizes]
        for j in range(len(self.panels)):
            panel = self._panel(j)
            for k, (kx, ky, _) in enumerate(sizes):
                factors[k] = np.linalg.qr(np.vstack((factors[k], self._across(j, panel, kx, ky))), "r")
        solved = []
        for r, (kx, _, rank) in zip(factors, sizes, strict=True):
            _, rho, right = np.linalg.svd(r, full_matrices=False)
            rank = min(rank or len(rho), len(rho))
            solved.append((rho, right[:rank], right[:rank].T / np.where(rho[:rank] > 0, rho[:rank], 1.0), np.zeros((kx, rank))))
        later = np.zeros(0, int)
        for j in range(len(self.panels) - 1, -1, -1):
            _, chosen, turn = self.panels[j]
            panel, whole, last = self._panel(j), turn.whole, j * self.block + self._width(j)
            for (kx, ky, _), (_, _, turned, into) in zip(sizes, solved, strict=True):
                rows, after = int((chosen < kx).sum()), later[later < kx]
                if rows:
                    b = self._across(j, panel, kx, ky) @ turned - panel[:rows, after - last] @ into[after]
                    into[chosen[:rows]] = solve_upper(whole[:rows, :rows], b)
            later = np.concatenate((chosen, later))
        scale = np.sqrt(self.n - 1)
        return [
            TallPair(into * scale, rho, right @ self.colour[: width[ky], :ky] / scale, len(right), self.mean[:kx], self.mean[self.kx : self.kx + ky])
            for (kx, ky, _), (rho, right, _, into) in zip(sizes, solved, strict=True)
        ]

    def _width(self, j: int) -> int:
        first = j * self.block
        return min(self.block, self.kx - first)


def _matrix_rows(b: pa.RecordBatch, kx: int, ky: int) -> np.ndarray:
    x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), k) for c, k in (("x", kx), ("y", ky)))
    return np.hstack((x, y))


def _sums(partial: DataFrame) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        return pa.table([table.column("piece").slice(0, 1), _list(sum(v.values.to_numpy() for v in table.column("v")))], ["piece", "v"])

    return partial.groupBy("piece").applyInArrow(add, "piece int, v array<double>")


@dataclass
class TallPair:
    """A truncated regression as thin factors: x to canonical variates of unit variance, their correlations, variates to y."""

    into: np.ndarray
    rho: np.ndarray
    out: np.ndarray
    rank: int
    x_mean: np.ndarray
    y_mean: np.ndarray

    def _bytes(self) -> int:
        return self.into.nbytes + self.out.nbytes

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep and y_hat: the means of y and what the leading scores of df(x) say of them. No shuffle; the thin factors, of
        checked size, go to the tasks."""
        if self._bytes() > MOST_BYTES:
            raise ValueError("take fewer canonical pairs: the weights are sent to each task")
        kx, shared = len(self.x_mean), df.sparkSession.sparkContext.broadcast((self.into, self.rho[: self.rank, None] * self.out, self.x_mean, self.y_mean))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            into, out, x_mean, y_mean = shared.value
            for b in batches:
                if len(b):
                    x = b.column("_x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
                    y = (x[:, :kx] - x_mean) @ into @ out + y_mean
                    yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(list(y), pa.list_(pa.float64()))], [*keep, "y_hat"])

        fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
        return df.select(*keep, F.col("x").alias("_x")).mapInArrow(run, f"{fields}, y_hat array<double>")


def rank_errors(val: DataFrame, pairs: list[TallPair]) -> list[np.ndarray]:
    """For each regression, the mean squared error over val(x, y) when it keeps 1, 2, ... canonical pairs.

    Scores of y beyond those that a regression predicts count as predicted to be 0. One pass for all: a task sends
    products of canonical variates, rank by rank.
    """
    if sum(p._bytes() for p in pairs) > MOST_BYTES:
        raise ValueError("compare fewer regressions at a time: their weights are sent to each task")
    shared = val.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list = [None] * len(shared.value)
        for b in batches:
            if not len(b):
                continue
            x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1) for c in ("x", "y"))
            for k, p in enumerate(shared.value):
                z = (x[:, : len(p.x_mean)] - p.x_mean) @ p.into
                e = y.copy()
                e[:, : len(p.y_mean)] -= p.y_mean
                part = np.vstack((z.T @ z, (z * (e[:, : len(p.y_mean)] @ p.out.T)).sum(axis=0), np.full(z.shape[1], (e * e).sum()), np.full(z.shape[1], float(e.size))))
                sums[k] = part if sums[k] is None else sums[k] + part
        for k, part in enumerate(sums):
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), _list(part)], ["piece", "v"])

    sums = {r.piece: np.array(r.v).reshape(-1, pairs[r.piece].rank) for r in _sums(val.select("x", "y").mapInArrow(run, "piece int, v array<double>")).toLocalIterator()}
    out = []
    for k, p in enumerate(pairs):
        if k not in sums:
            out.append(np.full(p.rank, np.nan))
            continue
        *zz, crossed, total, values = sums[k]
        rho = p.rho[: p.rank]
        answers = np.array(zz) * np.outer(rho, rho) * (p.out @ p.out.T)
        squares = np.cumsum(np.cumsum(answers, axis=0), axis=1).diagonal()
        out.append(np.maximum(0.0, total + squares - 2 * np.cumsum(rho * crossed)) / values)
    return out
