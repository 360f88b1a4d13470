"""Histograms, exact quantiles, ranks, windows of series, and distances between samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .staging import Staged, beside


def uniform_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """floor((x - lo) / width), with x = hi in the last bin; -1 below the range and bins above it."""
    k = F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins))
    k = F.when(x == hi, bins - 1).otherwise(k)
    return F.when(k < 0, -1).when(k >= bins, bins).otherwise(k).cast("int")


def edge_bin(x: Column, edges: list[float]) -> Column:
    """Bins between ascending edges, the last one closed; -1 below the first edge, len(edges) - 1 above the last."""
    at_or_below = sum((x >= F.lit(e)).cast("int") for e in edges)
    return F.when(x == edges[-1], len(edges) - 2).otherwise(at_or_below - 1)


def weighted_histogram(df: DataFrame, by: list[str], bin_: Column, weight: Column | str = "w") -> DataFrame:
    return df.groupBy(*by, bin_.alias("bin")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def density(hist: DataFrame, by: list[str], bins: int, width: float, coarse: int = 1) -> DataFrame:
    """Coarse bins with their density (their integral is 1), and the shares of weight below and above the range."""
    inside = (F.col("bin") >= 0) & (F.col("bin") < bins)
    total = hist.groupBy(*by).agg(F.sum(F.when(inside, F.col("weight"))).alias("inside"), F.sum("weight").alias("whole"), F.coalesce(F.sum(F.when(F.col("bin") < 0, F.col("weight"))), F.lit(0.0)).alias("under"), F.coalesce(F.sum(F.when(F.col("bin") >= bins, F.col("weight"))), F.lit(0.0)).alias("over"))
    wide = hist.where(inside).groupBy(*by, F.floor(F.col("bin") / coarse).cast("int").alias("bin")).agg(F.sum("weight").alias("weight"))
    out = wide.join(total, by)
    return out.withColumns({"density": F.col("weight") / (F.col("inside") * (width * coarse)), "fraction": F.col("weight") / F.col("inside"), "under_share": F.col("under") / F.col("whole"), "over_share": F.col("over") / F.col("whole")})


#: Rows of a range of values that one task puts in order, about.
RANGE_ROWS = 200_000


def _ranged(df: DataFrame, x: str, rows: int) -> DataFrame:
    """df, whose values of x are distinct within a group, with _b: ranges of values in order, of about so many rows. The rows are
    written to the shared folder first, as they are counted, split, summed and ordered: what they come from is read once."""
    df = Staged(df, "ranged").df
    ranges = -(-df.count() // rows)
    if ranges < 2:
        return df.withColumn("_b", F.lit(0))
    splits = np.unique(df.approxQuantile(x, [k / ranges for k in range(1, ranges)], 0.25 / ranges))

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, values.to_numpy(), "right").astype(np.int32))

    return df.withColumn("_b", place(F.col(x).cast("double")))


def _before(df: DataFrame, by: list[str], x: str, total: Column) -> DataFrame:
    """(by, _b, _t, _p, _x, _all) of _ranged() rows: each range's total, that of the ranges before it, the largest value before
    it (null before the first), and the group's total. A window here holds one row a range."""
    ranges = df.groupBy(*by, "_b").agg(total.alias("_t"), F.max(x).alias("_m"))
    run = Window.partitionBy(*by).orderBy("_b")
    return ranges.select(*by, "_b", "_t", (F.sum("_t").over(run) - F.col("_t")).alias("_p"), F.lag("_m").over(run).alias("_x"), F.sum("_t").over(Window.partitionBy(*by)).alias("_all"))


def weighted_quantiles(df: DataFrame, by: list[str], x: str, tie: str, q: float, weight: str = "w", rows: int = RANGE_ROWS) -> DataFrame:
    """The q-quantile of x by interpolation on the cumulative weight share; below the first share, the least value.

    Of any number of rows: equal values are one, ranges of values are summed, and only the range that holds the share is
    put in order. Of equal values the one of least tie comes first, which decides where interpolation ends.
    """
    g = _ranged(df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.sum(weight).alias("_w"), F.min_by(weight, tie).alias("_f")), x, rows)
    reach = F.lit(q - 1e-15)
    sums = _before(g, by, x, F.sum("_w"))
    hit = sums.where(((F.col("_p") + F.col("_t")) / F.col("_all") >= reach) & (F.col("_x").isNull() | (F.col("_p") / F.col("_all") < reach)))
    first = hit.groupBy(*by).agg(F.min(F.struct("_b", "_p", "_x", "_all")).alias("h")).select(*by, "h.*")
    run = Window.partitionBy(*by).orderBy(x)
    ordered = g.join(first, [*by, "_b"]).withColumn("_c", (F.col("_p") + F.sum("_w").over(run.rowsBetween(Window.unboundedPreceding, 0))) / F.col("_all"))
    ordered = ordered.withColumns({"_px": F.coalesce(F.lag(x).over(run), F.col("_x")), "_pc": F.coalesce(F.lag("_c").over(run), F.when(F.col("_x").isNotNull(), F.col("_p") / F.col("_all")))})
    until = F.col("_pc") + F.col("_f") / F.col("_all")
    at = F.when(F.col("_pc").isNull() | (until < reach), F.col(x)).otherwise(F.col("_px") + (F.lit(q) - F.col("_pc")) / (until - F.col("_pc")) * (F.col(x) - F.col("_px")))
    found = ordered.where((F.col("_c") >= reach) & (F.col("_pc").isNull() | (F.col("_pc") < reach)))
    return found.select(*by, at.alias("quantile"))


def average_ranks(df: DataFrame, by: list[str], x: str, name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df with the rank of x within by, from 1, ties sharing their mean; null where x is null.

    Equal values are counted once, ranges of values are put in order side by side, and what lies before a range is added.
    """
    g = _ranged(df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n")), x, rows)
    run = Window.partitionBy(*by, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    placed = g.join(_before(g, by, x, F.sum("_n")).select(*by, "_b", "_p"), [*by, "_b"])
    ranks = placed.select(*by, x, (F.col("_p") + F.sum("_n").over(run) - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, [*by, x], "left")


def boxcar(by: list[str], order: str, x: Column, width: int) -> Column:
    """Centred running mean of so many rows; null where the window is cut off."""
    half = width // 2
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    return F.when(F.count("*").over(w) == width, F.avg(x).over(w))


def autocorrelation(df: DataFrame, by: list[str], order: str, x: str, segment: int = 4096) -> DataFrame:
    """Biased autocorrelation (by, lag, acf) for all lags from 0 to the last place minus the first, by power spectra.

    Places are whole numbers; those without a row count for nothing. A series is cut into segments; segments that are d
    apart are multiplied as spectra, summed over all such pairs, and turned back once for each d. A task holds two
    spectra, however long the series is.
    """
    mean = df.groupBy(*by).agg(F.avg(x).alias("_mean"), F.min(order).alias("_first"), F.max(order).alias("_last"))
    rows = df.join(F.broadcast(mean), by).select(*by, F.floor((F.col(order) - F.col("_first")) / segment).cast("int").alias("a"), ((F.col(order) - F.col("_first")) % segment).cast("int").alias("o"), (F.col(x) - F.col("_mean")).alias("y"), (F.col("_last") - F.col("_first")).cast("long").alias("end"))
    keys = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by]

    def spectrum(table: pa.Table) -> pa.Table:
        y = np.zeros(2 * segment)
        y[table.column("o").to_numpy()] = table.column("y").to_numpy()
        f = np.fft.rfft(y)
        return pa.table([*(table.column(c).slice(0, 1) for c in (*by, "a", "end")), *(pa.array([v], pa.list_(pa.float64())) for v in (f.real, f.imag))], [*by, "a", "end", "re", "im"])

    s = rows.groupBy(*by, "a").applyInArrow(spectrum, ", ".join([*keys, "a int", "end long", "re array<double>", "im array<double>"]))
    left = s.select(*by, "end", F.col("re").alias("r0"), F.col("im").alias("i0"), F.col("a").alias("a0"), F.explode(F.sequence(F.col("a"), F.floor(F.col("end") / segment).cast("int"))).alias("a"))
    pairs = left.join(s.drop("end"), [*by, "a"]).withColumn("d", F.col("a") - F.col("a0"))

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(segment + 1, complex)
        for r0, i0, re, im in zip(*(table.column(c) for c in ("r0", "i0", "re", "im")), strict=True):
            total += (r0.values.to_numpy() - 1j * i0.values.to_numpy()) * (re.values.to_numpy() + 1j * im.values.to_numpy())
        c, d, end = np.fft.irfft(total), table.column("d")[0].as_py(), table.column("end")[0].as_py()
        lag = np.concatenate((np.arange(segment), np.arange(-segment, 0))) + d * segment
        keep = (lag >= 0) & (lag <= end)
        one = lambda k: pa.array([table.column(k)[0].as_py()] * int(keep.sum()), table.schema.field(k).type)
        return pa.table([*map(one, by), pa.array(lag[keep]), pa.array(c[keep])], [*by, "lag", "c"])

    sums = pairs.select(*by, "d", "end", "r0", "i0", "re", "im").groupBy(*by, "d").applyInArrow(summed, ", ".join([*keys, "lag long", "c double"]))
    c = sums.groupBy(*by, "lag").agg(F.sum("c").alias("c"))
    return c.join(F.broadcast(c.where("lag = 0").select(*by, F.col("c").alias("_c0"))), by).select(*by, "lag", (F.col("c") / F.col("_c0")).alias("acf"))


def integrated_time(acf: DataFrame, by: list[str], factor: float = 5.0, fixed: int = 60, rows: int = RANGE_ROWS) -> DataFrame:
    """(by, tau, window, fixed): 1 + 2 * the sum of the autocorrelation up to the first lag that is at least factor times it so
    far (the last lag if none is), and the same sum up to a fixed lag. Ranges of lags are summed side by side."""
    g = acf.where("lag >= 1").withColumn("_b", F.floor(F.col("lag") / rows).cast("int"))
    run = Window.partitionBy(*by, "_b").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    sums = _before(g, by, "lag", F.sum("acf")).select(*by, "_b", "_p")
    last = g.groupBy(*by).agg(F.max("lag").alias("last"), F.sum(F.when(F.col("lag") <= fixed, F.col("acf"))).alias("_fixed"))
    tau = g.join(F.broadcast(sums), [*by, "_b"]).withColumn("tau", 1 + 2 * (F.col("_p") + F.sum("acf").over(run))).join(F.broadcast(last), by)
    ends = tau.where((F.col("lag") >= factor * F.col("tau")) | (F.col("lag") == F.col("last")))
    first = ends.groupBy(*by, "_fixed").agg(F.min(F.struct("lag", "tau")).alias("e"))
    return first.select(*by, F.col("e.tau").alias("tau"), F.col("e.lag").alias("window"), (1 + 2 * F.col("_fixed")).alias("fixed"))


def percentile_of(value: Column, sample: str) -> list[Column]:
    """100 * share below + 50 / n * share equal * 2 of the finite sample values."""
    s = F.col(sample)
    return F.lit(100.0) * F.avg((s < value).cast("double")) + F.lit(50.0) / F.greatest(F.count(s), F.lit(1)) * F.avg((s == value).cast("double")) * 2


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """(b, ids, x): about so many rows of df(id, x) as one matrix, row by row."""
    count = max(1, -(-df.count() // rows))
    packed = df.groupBy(F.pmod(F.xxhash64("id"), F.lit(count)).alias("b")).agg(F.collect_list(F.struct("id", "x")).alias("r"))
    return packed.select("b", F.col("r.id").alias("ids"), F.flatten("r.x").alias("x"))


def nearest_distances(queries: DataFrame, refs: DataFrame, ks: tuple[int, ...], most_queries: int = 4096) -> DataFrame:
    """(id, k, distance) to the k-th nearest of refs(id, x) for every query(id, x); ids may be of any type.

    Blocks of queries meet blocks of references in matrix products on the executors. A task keeps the nearest max(ks)
    of the references that a block of queries has met there, and only these are shuffled. Distances kept are computed
    from differences, so that near ones lose no digits.
    """
    keep = max(ks)
    kind = queries.schema["id"].dataType
    arrow = to_arrow_type(kind)
    left = _blocks(queries, most_queries).select("b", "ids", F.col("x").alias("q"))
    right = _blocks(refs, most_queries).select(F.col("x").alias("r"), F.size("ids").alias("n"))

    def matrix(batch: pa.RecordBatch, name: str, at: int, rows: int) -> np.ndarray:
        return batch.column(name).slice(at, 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)

    def nearer(best: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        about = (q**2).sum(1)[:, None] + (r**2).sum(1) - 2 * q @ r.T
        n = min(keep, len(r))
        at = np.argpartition(about, n - 1, 1)[:, :n]
        exact = np.stack([((q - r[at[:, k]]) ** 2).sum(1) for k in range(n)], 1)
        return np.sort(np.concatenate((best, exact), 1), 1)[:, :keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ids = q = best = None

        def done() -> pa.RecordBatch:
            at = np.argwhere(np.isfinite(best))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at[:, 0])), pa.array(np.sqrt(best[at[:, 0], at[:, 1]]))], ["id", "d"])

        for batch in batches:
            for n in range(len(batch)):
                b = batch.column("b")[n].as_py()
                if b != block:
                    if block is not None:
                        yield done()
                    block, ids = b, pa.array(batch.column("ids")[n].as_py(), arrow)
                    q = matrix(batch, "q", n, len(ids))
                    best = np.full((len(ids), keep), np.inf)
                r = matrix(batch, "r", n, batch.column("n")[n].as_py())
                for a in range(0, len(r), 1024):
                    best = nearer(best, q, r[a : a + 1024])
        if block is not None:
            yield done()

    found = left.crossJoin(right).mapInArrow(run, f"id {kind.simpleString()}, d double")
    place = F.row_number().over(Window.partitionBy("id").orderBy("d"))
    return found.withColumn("k", place).where(F.col("k").isin(*ks)).select("id", "k", F.col("d").alias("distance"))


#: Rows of either block whose distances are looked at together: few, so that they stay in a processor's cache.
PART_ROWS = 256
#: Rows or classes of rows whose labels are made at a time.
LABELLED = 512
#: Squared distances below this share of the squared lengths are taken from the entries' differences, as products round them.
CLOSE = 1e-3


def _squares(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Squared distances of rows by one product; of close rows, and where values aren't finite, by differences."""
    with np.errstate(invalid="ignore", over="ignore"):
        one, two = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
        d2 = q @ r.T
        d2 *= -2
        d2 += one[:, None]
        d2 += two
        if not d2.min(initial=np.inf) >= CLOSE * (one.max(initial=0.0) + two.max(initial=0.0)):
            rows, columns = np.nonzero(~(d2 >= CLOSE * (one[:, None] + two)))
            for k in range(0, len(rows), 4096):
                a, b = rows[k : k + 4096], columns[k : k + 4096]
                d2[a, b] = ((q[a] - r[b]) ** 2).sum(1)
    return d2


class _Sums:
    """Sums by keys, whole numbers that lie close together."""

    def __init__(self):
        self.low, self.sums, self.seen = 0, np.zeros(0), np.zeros(0, bool)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if not len(keys):
            return
        low, high = min(self.low, int(keys.min())), max(self.low + len(self.sums), int(keys.max()) + 1)
        if high - low > len(self.sums):
            room = self.low - low, high - self.low - len(self.sums)
            self.low, self.sums, self.seen = low, np.pad(self.sums, room), np.pad(self.seen, room)
        self.sums += np.bincount(keys - self.low, values, len(self.sums))
        self.seen[keys - self.low] = True

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.seen)
        return at + self.low, self.sums[at]


def _slices(n: int, size: int) -> list[slice]:
    return [slice(k, k + size) for k in range(0, n, size)]


def _met_blocks(sample: DataFrame, meet: Callable, rows: int, alike: Column | None = None) -> dict[int, float]:
    """Sums by key over pairs of blocks of rows of sample(id, g, x): one job that shuffles only keys with their sums.

    Blocks of about so many rows, ordered by class (default: id) and id, are written once and read again for each block that
    they meet. meet(one, two) gets each unordered pair of blocks (a block with itself is the same object), each as classes,
    ids, groups and matrix, and gives keys and what to add. A task adds up its pairs.
    """
    n = sample.count()
    count = max(1, -(-n // rows), min(-(-n // PART_ROWS), int(np.ceil(np.sqrt(2 * sample.sparkSession.sparkContext.defaultParallelism)))))
    packed = sample.select((F.col("id") if alike is None else alike).cast("long").alias("c"), "id", "g", "x").withColumn("b", F.pmod(F.xxhash64("c"), F.lit(count)).cast("int"))
    packed = packed.repartitionByRange(count, "b").groupBy("b").agg(F.sort_array(F.collect_list(F.struct("c", "id", "g", "x"))).alias("r"))
    packed = packed.select(F.struct("b", F.col("r.c").alias("c"), F.col("r.id").alias("id"), F.col("r.g").alias("g"), F.flatten("r.x").alias("x")).alias("a"))

    def block(batch: pa.RecordBatch, at: int, column: str) -> tuple[int, tuple[np.ndarray, ...]]:
        b, *lists = batch.column(column).slice(at, 1).flatten()
        c, i, g, x = (v.flatten().to_numpy(zero_copy_only=False) for v in lists)
        return b[0].as_py(), (c, i, g, x.reshape(len(i), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums()
        for batch in batches:
            for at in range(len(batch)):
                (a, one), (b, two) = block(batch, at, "a"), block(batch, at, "b")
                total.add(*meet(one, one if a == b else two))
        keys, sums = total.rows()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.float64())], ["k", "v"])

    ahead = F.pmod(F.col("b.b") - F.col("a.b"), F.lit(count)) * 2  # each block meets the half of the others that follow it in a ring
    once = (ahead < count) | ((ahead == count) & (F.col("a.b") < F.col("b.b")))
    with Staged(packed, "rows") as staged:
        sums = beside(staged.df, count).where(once).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    return dict(zip(sums.column("k").to_pylist(), sums.column("v").to_pylist(), strict=True))


def _over_pairs(sample: DataFrame, visit: Callable, rows: int = 4096) -> dict[int, float]:
    """Sums by key over all ordered pairs of rows of sample(id, g, x), pairs of a row with itself among them: one job.

    visit(d2, i, gi, j, gj) gives keys and what to add to them for a square of PART_ROWS by PART_ROWS squared distances at
    most. It must not depend on the order of a pair: a square off the diagonal is visited once and counts for both orders.
    """

    def meet(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        total = _Sums()
        (_, i, gi, q), (_, j, gj, r) = one, two
        for a in _slices(len(i), PART_ROWS):
            for b in _slices(len(j), PART_ROWS):
                if one is not two or a.start <= b.start:
                    keys, values = visit(_squares(q[a], r[b]), i[a], gi[a], j[b], gj[b])
                    total.add(keys, values * (1 if one is two and a == b else 2))
        return total.rows()

    return _met_blocks(sample, meet, rows)


def median_distance(sample: DataFrame) -> float | None:
    """The exact median distance of unordered pairs (i < j) of sample(id, g, x).

    Four passes find the 64 bits of the middle values, 16 at a time, from counts: no pair is kept.
    """

    def counts(prefixes: list[int], shift: int) -> dict[int, float]:
        def visit(d2, i, gi, j, gj):
            if same := np.array_equal(i, j):
                d2 = d2[i[:, None] < j]
            elif np.isin(i, j).any():
                d2 = d2[i[:, None] != j]
            bits = np.sqrt(d2).ravel().view(np.int64)
            found = [np.bincount((bits[bits >> shift >> 16 == p] if shift < 48 else bits) >> shift & 0xFFFF) for p in prefixes]
            keys = [np.flatnonzero(f) for f in found]
            return np.concatenate([k + (n << 16) for n, k in enumerate(keys)]), np.concatenate([f[k] for f, k in zip(found, keys, strict=True)]) * (1.0 + same)

        return {k: v / 2 for k, v in _over_pairs(sample, visit).items()}

    at = counts([0], 48)
    n = int(sum(at.values()))
    if not n:
        return None
    middle = []
    for rank in ((n - 1) // 2, n // 2):
        middle.append([0, rank])
    for shift in (48, 32, 16, 0):
        prefixes = sorted({p for p, _ in middle})
        at = at if shift == 48 else counts(prefixes, shift)
        for m in middle:
            place = prefixes.index(m[0])
            k = 0
            for k in sorted(k for k in at if k >> 16 == place):  # where processors round a product differently, the last one may hold the rank
                if m[1] < at[k]:
                    break
                m[1] -= int(at[k])
            m[0] = m[0] << 16 | k & 0xFFFF
    return float(np.array([m[0] for m in middle]).view(np.float64).mean())


def energy_and_kernel(sample: DataFrame, bandwidth: float | None) -> tuple[float | None, float | None]:
    """Energy distance and squared kernel discrepancy between groups 0 and 1 of sample(id, g, x), diagonals included."""
    s2 = 2 * bandwidth * bandwidth if bandwidth else np.nan

    def visit(d2, i, gi, j, gj):
        d, k = np.sqrt(d2), np.exp(-d2 / s2)
        cells = [np.ix_(gi == u, gj == v) for u in (0, 1) for v in (0, 1)]
        found = np.array([f for c in cells for f in (d[c].size, d[c].sum(), k[c].sum())]).reshape(2, 2, 3)
        return np.arange(12), (found + found.transpose(1, 0, 2)).ravel() / 2

    at = _over_pairs(sample, visit)
    if not all(at.get(3 * c) for c in range(4)):
        return None, None
    d, k = ([at[3 * c + f] / at[3 * c] for c in range(4)] for f in (1, 2))
    return 2 * d[1] - d[0] - d[3], (None if np.isnan(s2) else k[0] + k[3] - 2 * k[1])


def relabelled_statistics(sample: DataFrame, bandwidth: float | None, labels: Callable[[np.ndarray, np.ndarray], np.ndarray], alike: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Energy distances and squared kernel discrepancies of sample(id, g, x) under many labellings: one job.

    labels(ids, g) has a column of 0 and 1 a labelling. Rows of equal alike (a whole number) have equal labels under each of
    them: distances are added up by these classes, and labels meet the sums. Sums over a labelling's ones follow from one
    product of a block of sums with the labels, those over the others from row sums; NaN where one side is empty or without a
    bandwidth.
    """
    s2 = 2 * bandwidth * bandwidth if bandwidth else np.nan
    each_row = alike is None

    def meet(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        def classes(c: np.ndarray) -> np.ndarray:
            return np.arange(len(c)) if each_row else np.cumsum(np.r_[0, c[1:] != c[:-1]])

        (c, i, gi, q), (e, j, gj, r), same = one, two, one is two
        c, e = classes(c), classes(e)
        whole = np.zeros((2, c[-1] + 1, e[-1] + 1))
        for a in _slices(len(i), PART_ROWS):
            for b in _slices(len(j), PART_ROWS):
                if same and a.start > b.start:
                    continue
                d2 = _squares(q[a], r[b])
                ca, eb = c[a], e[b]
                at = slice(ca[0], ca[-1] + 1), slice(eb[0], eb[-1] + 1)
                begin = [np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) for k in (ca, eb)]
                k = d2 / -s2
                for total, part in zip(whole, (np.sqrt(d2, out=d2), np.exp(k, out=k)), strict=True):
                    part = np.add.reduceat(np.add.reduceat(part, begin[0], 0), begin[1], 1)
                    total[at] += part
                    if same and a != b:
                        total[at[::-1]] += part.T
        parts, sizes = 0.0, [np.bincount(k).astype(np.float64) for k in (c, e)]
        for a in _slices(len(sizes[0]), LABELLED):
            at = np.searchsorted(c, np.arange(len(sizes[0]))[a])
            l1 = labels(i[at], gi[at]).astype(np.float64)
            for b in _slices(len(sizes[1]), LABELLED):
                at = np.searchsorted(e, np.arange(len(sizes[1]))[b])
                l2 = labels(j[at], gj[at]).astype(np.float64)
                found = []
                for m in (*whole[:, a, b], np.outer(sizes[0][a], sizes[1][b])):
                    x11, x1 = np.einsum("ij,ij->j", l1, m @ l2), m.sum(axis=1) @ l1
                    x = np.full(l1.shape[1], m.sum())
                    found += [x11, x1, x] if same else [2 * x11, x1 + m.sum(axis=0) @ l2, 2 * x]
                parts = parts + np.concatenate(found)
        return np.arange(len(parts)), parts

    at = _met_blocks(sample, meet, 4096, alike)
    sums = np.array([at[k] for k in range(len(at))]).reshape(3, 3, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        (dx, d_one, d_two), (kx, k_one, k_two), (nx, n_one, n_two) = ((x1 - x11, x11, x - 2 * x1 + x11) for x11, x1, x in sums)
        both = (n_one > 0.5) & (n_two > 0.5)
        return tuple(np.where(both, s, np.nan) for s in (2 * dx / nx - d_one / n_one - d_two / n_two, k_one / n_one + k_two / n_two - 2 * kx / nx))


#: Cells of one round, and how many distinct values may be fetched in the end.
ROUND_CELLS, LAST_VALUES = 4096, 4096


def order_statistics(df: DataFrame, x: str, ranks: Callable[[int], list[int]]) -> dict[int, float]:
    """The values of some ranks (from 0) among the values of a double column but null and NaN, exact, for any number of rows.
    ranks(n) names them when the number of values is known; those that no value has are left out.

    The values are written once. A round is one aggregate for all ranks: it counts values in cells of equal width between
    the bounds of each rank, or by value where few are left, and goes on in the cells that hold the ranks. The driver sees
    a few thousand counts a rank and round, and no task holds more than these.
    """
    with Staged(df.select(F.col(x).cast("double").alias("v")).where("v is not null and not isnan(v)"), "values") as staged:
        v = F.col("v")
        low, high, n = staged.df.agg(F.min("v"), F.max("v"), F.count("*")).first()
        open_, out = {r: (low, high, 0, n) for r in ranks(n) if 0 <= r < n}, {}
        while open_:
            bounds = sorted(set(open_.values()))
            which, cell = F.lit(None).cast("int"), F.lit(None).cast("double")
            for k, (lo, hi, _, held) in enumerate(bounds):
                width = (hi - lo) / ROUND_CELLS
                if held <= LAST_VALUES or width == 0.0:
                    place = v
                elif np.isfinite(width):
                    place = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(ROUND_CELLS - 1)).cast("double")
                else:  # infinite values, or a range beyond a double's: their signs first
                    place = F.when(v < 0, 0).otherwise(1) + F.when(F.abs(v) == np.inf, F.signum(v) * 2).otherwise(F.lit(0.0))
                inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
                which, cell = F.when(inside, k).otherwise(which), F.when(inside, place).otherwise(cell)
            found = staged.df.select("v", which.alias("k"), cell.alias("cell")).where("k is not null").groupBy("k", "cell").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
            cells: dict[int, list] = {}
            for r in sorted(found, key=lambda r: r.cell):
                cells.setdefault(r.k, []).append(r)
            for rank, held_in in list(open_.items()):
                below = held_in[2]
                for r in cells[bounds.index(held_in)]:
                    if rank < below + r.c:
                        break
                    below += r.c
                if r.a == r.b:
                    out[rank] = r.a
                    del open_[rank]
                else:
                    open_[rank] = (r.a, r.b, below, r.c)
    return out


def exact_quantile(df: DataFrame, x: str, q: float) -> float | None:
    """The q-quantile by linear interpolation between order statistics; null and NaN don't count, without values: None."""
    place = lambda n: q * (n - 1)
    size = 0

    def ranks(n: int) -> list[int]:
        nonlocal size
        size = n
        return [int(place(n)), min(int(place(n)) + 1, n - 1)] if n else []

    found = order_statistics(df, x, ranks)
    if not size:
        return None
    a, b = (found[k] for k in ranks(size))
    return a if a == b else a + (place(size) - int(place(size))) * (b - a)
