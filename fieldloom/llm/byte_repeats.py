"""Suffix-array dedup over bytes with a logarithmic family of sorted runs.

The suffixes indexed are those at anchors, chosen by content: in every stretch of 128 starts of 400-byte windows the
start with the least hash of its eight bytes. Equal windows choose the same anchor, so no match is missed, and one in
64 suffixes is enough. A slice of texts is a batch: its suffixes, cut at the 272 bytes that all windows of an anchor
share, are sorted (by three leading bytes, then by fingerprint) into its suffix array. In each bucket the batches' arrays
come one after another; each is merge-scanned against the levels that are there, and levels of equal size merge, so
there are never more than log2(batches) of them.

Where a suffix repeats but its whole context (all windows of its anchor) doesn't, the windows are looked at one by one,
by the same family: they are the suffixes that start there, cut at 400 bytes.

SuffixIndex keeps the family between runs: each batch's array is a level in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, documents, join_rows
from .hashing import U64, mix, range_hashes
from .repeats import ASK, MIXED, PAST, SAME, SENT, Method, Replies, Sender, asking, blobs_of, owners, planes, remove_repeats, removing, replies, sorted_repeats, spread, union_spans, unplaned

WINDOW = 400
STARTS = 128
#: Bytes after an anchor that all of its windows hold.
CORE = WINDOW - STARTS
#: Starts whose anchors are looked for together, and windows that are hashed and sent together.
PART = 1 << 18
_LEAD = U64((1 << 24) - 1)


class SuffixFamily:
    """Sorted suffix arrays whose sizes double from level to level.

    add() scans a batch against every level, takes in the suffixes that none has, and merges levels of equal rank.
    A suffix that a batch finds in the family is reported on both sides.
    """

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # rank, sorted keys, their first occurrences

    def add(self, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys: distinct and sorted, ids: their occurrences. Returns the ids found here before, and their partners."""
        mine, found, partners = np.zeros(len(keys), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, level, occurrence in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[at] == keys
            mine |= hit
            found.append(ids[hit])
            partners.append(occurrence[at[hit]])
        if not mine.all():
            self.levels.append((0, keys[~mine], ids[~mine]))
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            (_, a, x), (rank, b, y) = self.levels.pop(), self.levels.pop()
            key = np.concatenate((b, a))
            order = np.argsort(key, kind="stable")  # two sorted runs: a merge
            self.levels.append((rank + 1, key[order], np.concatenate((y, x))[order]))
        return np.concatenate(found), np.concatenate(partners)


def family_repeats(runs: list[tuple[np.ndarray, np.ndarray]], settled: np.ndarray, past: np.ndarray, mode: int) -> tuple[np.ndarray, np.ndarray]:
    """sorted_repeats by the family, for keys whose occurrences repeat; mixed contexts are left to sorting."""
    if mode == MIXED:
        return sorted_repeats(runs, settled, past, mode)
    keys, checks = (np.concatenate([r[k] for r in runs]) for k in (0, 1))
    family, start = SuffixFamily(), 0
    hit, lead, odd = settled.copy(), np.zeros(len(keys), bool), [np.zeros(0, np.uint64)]
    for key, _ in runs:
        again, partners = family.add(*_sorted_once(key, start))
        same = checks[again] == checks[partners]
        hit[again[same]] = hit[partners[same]] = True
        odd.append(keys[again[~same]])
        start += len(key)
    known = np.unique(keys[settled])  # also where the one who knows came after
    if len(known):
        hit |= known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
    doubt = np.isin(keys, np.unique(np.concatenate(odd)))
    if doubt.any():  # unlike suffixes with one key
        hit[doubt] = sorted_repeats([(keys[doubt], checks[doubt])], settled[doubt], past[doubt], mode)[0]
    asked = np.flatnonzero(hit & ~settled & ~past)
    pair = keys[asked] * U64(0x9E3779B97F4A7C15) ^ checks[asked]
    lead[asked[np.unique(pair, return_index=True)[1]]] = True
    return hit, lead


def _sorted_once(key: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """A run's keys in order, each once, with their places among all occurrences."""
    unique, at = np.unique(key, return_index=True)
    return unique, at + start


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _anchors(d: np.ndarray) -> np.ndarray:
    """For each start but the last, the anchor among it and the next 127: the leftmost of least hash."""
    x = d[:-1].astype(np.uint64) | (d[1:].astype(np.uint64) << U64(8))
    x = x[:-2] | (x[2:] << U64(16))
    x = x[:-4] | (x[4:] << U64(32))
    # the low bits hold the place, so that the leftmost of equals is least
    return (_least_of((mix(x) & ~_LEAD) | np.arange(len(x), dtype=np.uint64), STARTS) & _LEAD).astype(np.int64)


class Runs:
    """Anchors of several texts, each with the range of window starts that choose it.

    Starts are looked at part by part, so that a long text needs little beyond its own bytes.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.r_[0, np.cumsum(sizes)]
        found = [np.zeros((4, 0), np.int64)]
        for t in np.flatnonzero(sizes >= WINDOW).tolist():
            last = self.begin[t + 1] - WINDOW  # the last start of a window
            for a in range(self.begin[t], last + 1, PART):
                b = min(a + PART, last + 1)
                anchor = _anchors(self.data[a : b + STARTS - 1 + 7]) + a
                cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                found.append(np.stack((anchor[cut], a + cut, a + np.r_[cut[1:], len(anchor)] - 1, np.full(len(cut), t))))
        self.anchor, self.lo, self.hi, self.text = np.concatenate(found, 1)
        if len(self.anchor):  # an anchor's range may go on in the next part
            first = np.r_[True, (self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1])]
            cut = np.flatnonzero(first)
            self.hi = self.hi[np.r_[cut[1:], len(first)] - 1]
            self.anchor, self.lo, self.text = self.anchor[cut], self.lo[cut], self.text[cut]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of suffixes and of contexts, which tell where the anchor is as well."""
        core = range_hashes(self.data, self.anchor, self.anchor + CORE)
        return core, range_hashes(self.data, self.lo, self.hi + WINDOW) ^ mix((self.anchor - self.lo).astype(np.uint64))

    def suffix_keys(self, at: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        """Three leading bytes, then 40 bits of the fingerprint: the order of the suffix arrays."""
        lead = [self.data[at + k].astype(np.uint64) << U64(56 - 8 * k) for k in range(3)]
        return lead[0] | lead[1] | lead[2] | (fingerprint >> U64(24))


class SuffixArrays(Method):
    find = staticmethod(family_repeats)
    keys_per_byte = 0.035
    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def keys(self, sender: Sender, texts_: list[bytes]) -> Iterator[None]:
        r = Runs(texts_)
        core, context = r.hashes()
        second = range_hashes(r.data, r.lo, r.hi + WINDOW, 1)
        ref = (r.anchor - r.begin[r.text]).astype(np.uint64)
        sender.send(SAME, r.suffix_keys(r.anchor, context), (second >> U64(32)).astype(np.uint32), r.text, ref)
        sender.send(MIXED, core, ((context ^ second) & U64(0xFFFFFFFF)).astype(np.uint32), r.text, ref)
        yield

    def windows(self, sender: Sender, texts_: list[bytes], replies: list[Replies]) -> Iterator[None]:
        mixed = [k for k, x in enumerate(replies) if len(x.mixed)]
        r = Runs([texts_[k] for k in mixed])
        wanted = np.zeros(len(r.anchor), bool)
        place = r.anchor - r.begin[r.text]
        cut = np.searchsorted(r.text, np.arange(len(mixed) + 1))
        for k, t in enumerate(mixed):  # contexts that repeat are known; one leads for all of them
            a, b = cut[k], cut[k + 1]
            x, p = replies[t], place[a:b]
            wanted[a:b] = np.isin(p, x.mixed) & (~np.isin(p, x.same) | np.isin(p, x.leads))
        lo, size = r.lo[wanted], (r.hi - r.lo + 1)[wanted]
        ends = np.cumsum(size)
        a = 0
        while a < len(lo):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART, "right")))
            n = size[a:b]
            at = np.repeat(lo[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            text = np.searchsorted(r.begin, at, "right") - 1
            check = (range_hashes(r.data, at, at + WINDOW, 1) >> U64(32)).astype(np.uint32)
            sender.send(SAME, r.suffix_keys(at, range_hashes(r.data, at, at + WINDOW)), check, np.array(mixed)[text], (at - r.begin[text]).astype(np.uint64))
            yield
            a = b

    def remove(self, text: bytes, copied: bool, first: Replies, second: Replies) -> tuple:
        n = len(text)
        if copied and n >= WINDOW:
            return n, n, 1, hashlib.sha256(b"").hexdigest()
        if not len(first.same) and not len(second.same):
            return n, 0, 0, hashlib.sha256(text).hexdigest()
        a, b = second.same, second.same + WINDOW
        if len(first.same):
            r = Runs([text])
            whole = np.isin(r.anchor, first.same)
            a, b = np.r_[a, r.lo[whole]], np.r_[b, r.hi[whole] + WINDOW]
        a, b = union_spans(a, b)
        kept = hashlib.sha256()
        for x, y in zip([0, *b.tolist()], [*a.tolist(), n], strict=True):
            kept.update(text[x:y])
        return n, int((b - a).sum()), len(a), kept.hexdigest()


class SuffixIndex:
    """The family between runs: a folder with one level of sorted keys for each batch or merge of batches.

    add() looks for what the texts of a new batch share with each other and with all batches before. Of those it reads
    the levels, and the kept texts of single documents whose passages the new batch shares in part; never the batches
    themselves. Levels of equal rank merge, so that a key is rewritten log2(batches) times. The number of buckets is
    fixed when the index is made; a bucket's keys are worked on in one task.
    """

    LEVEL = "bucket int, mode int, docs binary, refs binary, keys binary, checks binary"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets, self.method = spark, path, buckets, SuffixArrays()

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def levels(self) -> list[tuple[int, int]]:
        """(number, rank) of each level, oldest first. A level whose writing was not ended doesn't count."""
        path, files = self._files()
        if not files.exists(path):
            return []
        done = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("level-")]
        names = [p.getName() for p in done if files.exists(self._child(p, "_SUCCESS"))]
        return sorted((int(a), int(b)) for _, a, b in (n.split("-") for n in names))

    def _child(self, path, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)

    def _texts(self, levels: list[tuple[int, int]]) -> DataFrame:
        """blob and text of all batches that have their level."""
        last = max((n for n, _ in levels), default=-1)
        folders = [f"{self.path}/texts-{n}" for n in range(last + 1)]
        kind = "blob binary, text string"
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def add(self, docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Every row of the batch with what is removed from it, as remove_repeats gives it; what is removed from
        earlier batches is not judged again. A text that an earlier batch holds counts as copied."""
        levels, method, n = self.levels(), self.method, self.buckets
        number = max((x for x, _ in levels), default=-1) + 1
        old = self._texts(levels)
        level = lambda x: self.spark.read.schema(self.LEVEL).parquet(f"{self.path}/level-{x[0]}-{x[1]}")
        seen = old.select("blob").withColumn("seen", F.lit(1))
        blobs = Stage(join_rows(blobs_of(docs), seen, "blob", "left").withColumn("copies", F.col("copies") + F.coalesce("seen", F.lit(0))), "suffix-batch")
        new = blobs.df.where("seen is null").select("blob", "text")
        asked = Stage(new.mapInArrow(asking(method, n, False, True), SENT), "suffix-asked")
        past = [level(x).select("bucket", "mode", F.lit(PAST).alias("kind"), "docs", F.lit(None).cast("binary").alias("counts"), "refs", "keys", "checks") for x in levels]
        first = asked.df
        for p in past:
            first = first.unionByName(p)
        first = Stage(replies(first, n, method.find, "replies"), "suffix-first")
        known = join_rows(new, first.df, "blob").union(join_rows(old, first.df, "blob"))
        second = replies(known.mapInArrow(asking(method, n, True), SENT), n, method.find, "more")
        told = join_rows(join_rows(blobs.df.select("blob", "text", "copies"), first.df, "blob", "left"), second, "blob", "left")
        out = Stage(spread(docs, told.mapInArrow(removing(method), f"blob binary, {method.result}"), columns), "suffix-result")
        new.write.mode("overwrite").parquet(f"{self.path}/texts-{number}")
        merged, rank = [], 0
        for x in reversed(levels):
            if x[1] > rank:
                break
            merged.append(x)
            rank = x[1] + 1
        rows = asked.df.where(F.col("kind") == ASK).select("bucket", "mode", F.lit(True).alias("new"), "docs", "counts", "refs", "keys", "checks")
        for x in levels:
            rows = rows.unionByName(level(x).select("bucket", "mode", F.lit(x in merged).alias("new"), "docs", F.lit(None).cast("binary").alias("counts"), "refs", "keys", "checks"))
        rows.groupBy("bucket", "mode").applyInArrow(merge_levels, self.LEVEL).write.mode("overwrite").parquet(f"{self.path}/level-{number}-{rank}")
        path, files = self._files()
        for x in merged:
            files.delete(self._child(path, f"level-{x[0]}-{x[1]}"), True)
        for s in (blobs, asked, first):
            s.drop()
        return out.df


def merge_levels(table: pa.Table) -> pa.Table:
    """One bucket's new level: the keys of the rows marked new, in order, each once with one owner, that no other level has."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["new"], r["docs"], r["keys"]))
    size = [len(r["keys"]) // 8 for r in rows]
    key, check = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("keys", np.uint64), ("checks", np.uint32)))
    ref = np.concatenate([unplaned(r["refs"], np.uint64) for r in rows])
    doc = np.concatenate([owners(r["docs"], r["counts"]) for r in rows])
    kept = np.repeat([not r["new"] for r in rows], size)
    order = np.lexsort((~kept, check, key))
    k, c = key[order], check[order]
    first = order[np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])][: len(order)]]
    mine = first[~kept[first]]
    one = lambda x, t: pa.array([x], t)
    packed = [doc[mine].tobytes(), planes(ref[mine]), key[mine].tobytes(), check[mine].tobytes()]
    return pa.table([one(rows[0]["bucket"], pa.int32()), one(rows[0]["mode"], pa.int32()), *(one(x, pa.binary()) for x in packed)], ["bucket", "mode", "docs", "refs", "keys", "checks"])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its bytes, those removed, their runs and the digest of the rest. Null, empty and short texts
    lose nothing; repeated rows of 400 bytes or more lose all; extra columns are left behind."""
    return remove_repeats(documents(spark, sf_dir), SuffixArrays())


ORACLE = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, unnest(range(1, len(h) // 2 - 398)) AS i, h FROM d WHERE len(h) >= 800),
s AS (SELECT rid, i, md5(substr(h, 2 * i - 1, 800)) AS win FROM p),
k AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY win) AS n FROM s) WHERE n > 1),
g AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM k),
e AS (SELECT rid, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM g),
sp AS (SELECT rid, run, min(i) AS a, max(i) + 400 AS b FROM e GROUP BY ALL),
q AS (SELECT rid, run, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 1) AS prev FROM sp),
t AS (SELECT q.rid, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * prev - 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) - 1) AS kept FROM q JOIN d USING (rid) GROUP BY q.rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (rid)"""
