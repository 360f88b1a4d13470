"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds: runs of five words, or a whole item of fewer. For each pair
that shares one, running Karp-Rabin greedy string tiling marks the longest match between unmarked words first, then
shorter ones, down to the seed's length: the longest length at which both sides still have a window of equal hash is
searched for, all its matches are marked, and the search goes on below it. Tiles don't overlap, so passages that were
reordered still add up. Words are compared as such, not by hash. A document is contaminated if its tiles cover enough
of an item.

A benchmark of up to 8 MB is sent to the tasks as an index of sorted seeds, and the documents are only mapped. A larger
one is joined by shuffling: of the documents' seeds only those go out that pass a bitmap of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Stage, documents, fresh, join_rows, join_summary, texts, widen
from .hashing import U64, Words, mix, text_slices

SEED = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Bytes of a benchmark that may be sent to the tasks.
BLOCK_BYTES = 8 << 20
#: Bits of the map of a larger benchmark's seeds.
MAP_BITS = 27
SLICE = 1 << 21


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return out


class _Side:
    """One of the two sequences: which words are free, and hashes of its windows."""

    def __init__(self, ids: np.ndarray, free: np.ndarray):
        self.ids, self.free, self.known = ids, free, {1: mix(ids.astype(np.uint64) + U64(1))}

    def hashes(self, n: int) -> np.ndarray:
        """Hashes of all windows of n words, from those of the greatest power of two below."""
        half = 1 << (n.bit_length() - 1)
        size = 1
        while size < half:
            if 2 * size not in self.known:
                h = self.known[size]
                self.known[2 * size] = mix(h[:-size] * U64(0x9E3779B97F4A7C15) + h[size:])
            size *= 2
        h = self.known[half]
        return h if half == n else mix((h[: len(self.ids) - n + 1] * U64(0xD1B54A32D192ED03)) ^ h[n - half :])

    def open(self, n: int) -> np.ndarray:
        """Starts of n free words."""
        taken = np.r_[0, np.cumsum(~self.free)]
        return np.flatnonzero(taken[n:] == taken[:-n])


def tiles(doc: np.ndarray, item: np.ndarray, seed: int = SEED, free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling of two arrays of numbers that stand for words: (start in doc, start in item, length), longest first.

    Of equally long matches the one that starts first in the item, then in the document, is marked. free: the words of
    doc that can match at all. Time is near linear in both lengths for each length of tile; pairs of places are not listed.
    """
    d, i = _Side(doc, np.ones(len(doc), bool) if free is None else free.copy()), _Side(item, np.ones(len(item), bool))

    def common(n: int) -> np.ndarray:
        """Starts in the item of free windows of n words that the document has too."""
        at, other = i.open(n), d.open(n)
        return at[np.isin(i.hashes(n)[at], d.hashes(n)[other])] if len(at) and len(other) else at[:0]

    out: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while most >= seed and len(common(seed)):
        low, high = seed, most
        if len(common(high)):
            low = high
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)) else (low, middle - 1)
        most = low
        at, other = common(most), d.open(most)
        h = d.hashes(most)[other]
        order = np.argsort(h, kind="stable")
        h, other = h[order], other[order].tolist()
        mine = i.hashes(most)[at]
        begin, end = np.searchsorted(h, mine).tolist(), np.searchsorted(h, mine, "right").tolist()
        next_: dict[int, int] = {}  # the first place of each window in the document that may still be free
        for j, a, b in zip(at.tolist(), begin, end, strict=True):
            if not i.free[j : j + most].all():
                continue
            k = next_.get(a, a)
            while k < b and not d.free[other[k] : other[k] + most].all():
                k += 1
            next_[a] = k
            if k < b:
                p = other[k]
                if not np.array_equal(doc[p : p + most], item[j : j + most]):  # unlike windows of one hash
                    continue
                d.free[p : p + most] = i.free[j : j + most] = False
                out.append((p, j, most))
        most -= 1
    return out


class Item:
    """The words of one benchmark item, numbered."""

    def __init__(self, text: str):
        w = Words([text.encode()], lower=True)
        self.hash = w.hash
        words = [w.data[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        self.number = {x: k for k, x in enumerate(dict.fromkeys(words))}
        self.ids = np.array([self.number[x] for x in words], np.int64)
        self.seed = min(SEED, len(words))
        self.seeds = np.unique(window_hashes(w.hash, self.seed)) if words else np.zeros(0, np.uint64)

    def match(self, w: Words, t: int, least: float = 0.0) -> tuple[int, int, int] | None:
        """Tiles, words covered and the longest tile of text t, or None if it has none or can't cover the share."""
        a, b = int(w.first[t]), int(w.first[t + 1])
        if b - a < self.seed or not self.seed:
            return None
        shared = np.flatnonzero(np.isin(window_hashes(w.hash[a:b], self.seed), self.seeds))
        if not len(shared):
            return None
        edge = np.zeros(b - a + 1, np.int64)
        np.add.at(edge, shared, 1)
        np.add.at(edge, shared + self.seed, -1)
        inside = np.cumsum(edge[:-1]) > 0  # all matches lie within
        if inside.sum() < least * len(self.ids):
            return None
        # a word outside is kept at each end of a run, so that runs don't grow together
        near = np.flatnonzero(inside | np.r_[inside[1:], False])
        starts, ends = w.start[a:b][near].tolist(), w.end[a:b][near].tolist()
        ids = np.array([self.number.get(w.data[x:y].tobytes(), -1) if y else -1 for x, y in zip(starts, ends, strict=True)], np.int64)
        found = tiles(ids, self.ids, self.seed, inside[near] & (ids >= 0))
        return (len(found), sum(x[2] for x in found), max(x[2] for x in found)) if found else None


class BenchmarkIndex:
    """Items and their sorted seeds."""

    def __init__(self, ids: list, item_texts: list[str]):
        self.ids, self.items = ids, [Item(t) for t in item_texts]
        self.by_size = {}
        for size in sorted({x.seed for x in self.items if x.seed}):
            own = [k for k, x in enumerate(self.items) if x.seed == size]
            seed = np.concatenate([self.items[k].seeds for k in own])
            owner = np.repeat(own, [len(self.items[k].seeds) for k in own])
            at = np.argsort(seed, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[seed >> U64(44)] = True
            self.by_size[size] = seed[at], owner[at], bits

    def candidates(self, w: Words) -> set[tuple[int, int]]:
        """(text, item) that share a seed."""
        found: set[tuple[int, int]] = set()
        for size, (seed, owner, bits) in self.by_size.items():
            h = window_hashes(w.hash, size)
            at = np.flatnonzero(bits[h >> U64(44)])
            h = h[at]
            lo, hi = np.searchsorted(seed, h), np.searchsorted(seed, h, "right")
            hit = hi > lo
            at, lo, hi = at[hit], lo[hit], hi[hit]
            text = np.searchsorted(w.first, at, "right") - 1
            inside = at + size <= w.first[text + 1]
            pairs = np.unique(np.stack((text[inside], lo[inside], hi[inside]), 1), axis=0)
            for t, a, b in pairs.tolist():
                found.update((t, k) for k in owner[a:b].tolist())
        return found

    def matches(self, w: Words, least: float = 0.0) -> Iterator[tuple[int, int, int, int, int]]:
        """text, item, tiles, words covered, longest tile."""
        for t, k in sorted(self.candidates(w)):
            found = self.items[k].match(w, t, least)
            if found:
                yield t, k, *found


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null and item_id is not null").select("item_id", "text")


def _index(items: DataFrame) -> BenchmarkIndex | None:
    """The index of a benchmark that may be sent to the tasks, else None."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BLOCK_BYTES:
        return None
    rows = items.collect()
    return BenchmarkIndex([r.item_id for r in rows], [r.text for r in rows])


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit for each value of the leading bits of the seeds: at most 2**MAP_BITS bits come to the driver."""
    bit = F.shiftrightunsigned("seed", 64 - MAP_BITS)
    words = seeds.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in words.toLocalIterator():
        out[r.word] = r.bits
    return out.view(np.uint64)


def _seed_join(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(row, item, n_tiles, n_covered, n_item_words, longest) of docs(row, text) and items(item, text), by shuffling."""

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x = Item(text)
                yield pa.RecordBatch.from_arrays([pa.array(x.seeds.view(np.int64)), pa.array([x.seed] * len(x.seeds), pa.int32()), pa.array([number] * len(x.seeds), pa.int64())], ["seed", "size", "item"])

    seeds = Stage(items.mapInArrow(item_seeds, "seed long, size int, item long"), "tiling-seeds").df
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # five at most
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part, ts in text_slices(batch, "text", SLICE):
                w = Words(ts, lower=True)
                rows = np.array(part.column("row").to_pylist(), np.int64)
                for size in sizes:
                    h = window_hashes(w.hash, size)
                    bit = h >> U64(64 - MAP_BITS)
                    at = np.flatnonzero((bits[bit >> U64(6)] >> (bit & U64(63))) & U64(1))
                    text = np.searchsorted(w.first, at, "right") - 1
                    at, text = at[at + size <= w.first[text + 1]], text[at + size <= w.first[text + 1]]
                    x = np.unique(np.stack((h[at].view(np.int64), rows[text]), 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(np.full(len(x), size), pa.int32()), pa.array(x[:, 1])], ["seed", "size", "row"])

    mine = docs.mapInArrow(doc_seeds, "seed long, size int, row long")
    pairs = join_rows(mine, seeds, ["seed", "size"]).select("row", "item").distinct()
    both = join_summary(pairs, items.withColumnRenamed("text", "said"), "item")
    both = join_summary(both, docs.select("row", "text"), "row").select("row", "item", "text", "said")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, item, text, said in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x = Item(said)
                found = x.match(Words([text.encode()], lower=True), 0, least)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row, item, found[0], found[1], len(x.ids), found[2]), [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], ["row", "item", *_FIGURES])

    return both.mapInArrow(tile, "row long, item long, n_tiles int, n_covered int, n_item_words int, longest int")


_FIGURES = ["n_tiles", "n_covered", "n_item_words", "longest"]


def tile_matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.0) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_covered, n_item_words, longest) of each row of docs and item that share a seed.

    least: pairs that can't cover this share of the item may be left out. Null and empty texts and items match nothing;
    an empty benchmark matches nothing. Repeated rows and items each have their own result rows.
    """
    docs, items = texts(docs), _items(benchmark)
    index = _index(items)
    if index is None:
        docs = Stage(docs.withColumn("row", F.monotonically_increasing_id()), "tiling-documents").df
        items = Stage(items.withColumn("item", F.monotonically_increasing_id()), "tiling-items").df
        found = _seed_join(docs.select("row", "text"), items.select("item", "text"), least)
        found = join_summary(join_summary(found, docs.select("row", "doc_id"), "row"), items.select("item", "item_id"), "item")
        return found.select("doc_id", "item_id", *_FIGURES)
    kind, item_kind = (x.schema[c].dataType for x, c in ((docs, "doc_id"), (items, "item_id")))
    item_type = to_arrow_type(item_kind)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part, ts in text_slices(batch, "text", SLICE):
                rows = list(index.matches(Words(ts, lower=True), least))
                if rows:
                    t, k, n, covered, longest = zip(*rows, strict=True)
                    figures = [n, covered, [len(index.items[i].ids) for i in k], longest]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(t)), pa.array([index.ids[i] for i in k], item_type), *(pa.array(x, pa.int32()) for x in figures)], ["doc_id", "item_id", *_FIGURES])

    return widen(docs).mapInArrow(run, f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, n_tiles int, n_covered int, n_item_words int, longest int")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """tile_matches whose tiles cover the share of the item, with that share."""
    share = F.col("n_covered") / F.col("n_item_words")
    return tile_matches(docs, benchmark, coverage).withColumn("coverage", share).where(F.col("coverage") >= coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs of which no item is covered to the share, with all their columns."""
    items = _items(benchmark)
    index = _index(items)
    if index is None:
        row = fresh(docs, "row")
        docs = Stage(docs.withColumn(row, F.monotonically_increasing_id()), "tiling-documents").df
        items = Stage(items.withColumn("item", F.monotonically_increasing_id()), "tiling-items").df
        found = _seed_join(docs.select(F.col(row).alias("row"), F.coalesce("text", F.lit("")).alias("text")), items.select("item", "text"), coverage)
        bad = found.where(F.col("n_covered") >= coverage * F.col("n_item_words")).select(F.col("row").alias(row)).distinct()
        return join_rows(docs, bad, row, "left_anti").drop(row)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part, ts in text_slices(batch, "text", SLICE):
                bad = {t for t, k, _, covered, _ in index.matches(Words(ts, lower=True), coverage) if covered >= coverage * len(index.items[k].ids)}
                yield part.filter(pa.array([t not in bad for t in range(len(ts))])) if bad else part

    return widen(docs).mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items that they hold to half or more, in any order. Null and empty texts hold none, repeated
    rows each have their own, long texts are tiled whole, extra columns are left behind."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
