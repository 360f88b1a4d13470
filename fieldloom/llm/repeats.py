"""Finding keys that occur twice or more among all documents, without pairs and without hot groups.

Both substring operators ask the same question of different keys (anchors, contexts, windows): which of mine occur
elsewhere? A map task sends each distinct key of a slice of texts once to the key's bucket, packed in a few binary
rows; occurrences that already repeat within the slice need no answer and are passed on as known. So a key that
fills a third of the corpus reaches its bucket once a slice. Buckets hold a bounded number of keys, as their number
follows the input's size.

Keys of earlier batches, kept with their owners, take part as rows of a kind of their own (PAST).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob_key, fresh, join_rows, join_summary, texts
from .hashing import U64, mix, text_slices

SLICE = 1 << 20
BUCKET_KEYS = 1_500_000
#: Packed rows are handed on when they have so many bytes.
FLUSH = 1 << 25
#: Kinds of rows: a key asked for, a key that its sender knows to repeat, occurrences known to repeat, and a key of an earlier batch.
ASK, KNOWN, TOLD, PAST = 0, 1, 2, 3
#: Modes: does the key occur twice (SAME); do two different checks occur with the key (MIXED).
SAME, MIXED = 0, 1
SENT = "bucket int, mode int, kind int, docs binary, counts binary, refs binary, keys binary, checks binary"
SENT_NAMES = ["bucket", "mode", "kind", "docs", "counts", "refs", "keys", "checks"]
ANSWER = "home int, mode int, docs binary, counts binary, refs binary, leads binary"
REPLY = "blob binary, same binary, mixed binary, leads binary"


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes first: leading zeros then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def unplaned(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel() if data else np.zeros(0, kind)


def owners(docs: bytes, counts: bytes | None) -> np.ndarray:
    """The owner (16 bytes) of each key; without counts each key has its own."""
    each = np.frombuffer(docs, np.uint8).reshape(-1, 16)
    return each if counts is None else np.repeat(each, np.frombuffer(counts, np.uint32), axis=0)


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.r_[np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), len(sorted_values)]


def _groups(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    k, c = key[order], check[order]
    same = k[1:] == k[:-1]
    if (same & (c[1:] != c[:-1])).any():
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        same = k[1:] == k[:-1]
    return order, np.r_[np.flatnonzero(np.r_[True, ~same | (c[1:] != c[:-1])]), len(k)] if len(k) else np.zeros(1, np.int64)


class Sender:
    """Rows that ask for the keys of one slice of texts. every: each distinct key and check is asked for, for an index to keep."""

    def __init__(self, blobs: list[bytes], buckets: int, every: bool = False):
        self.blobs, self.buckets, self.every = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 16), buckets, every
        self.rows: list[tuple] = []
        self.size = 0

    def _by_bucket(self, mode: int, kind: int, bucket, doc, ref, key, check) -> None:
        order = np.lexsort((doc, bucket)) if kind != KNOWN else np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cut = _cuts(bucket)
        for a, b in zip(cut, cut[1:], strict=False):
            part = order[a:b]
            docs = counts = refs = b""
            if kind != KNOWN:
                d = doc[part]
                at = _cuts(d)
                docs, counts, refs = self.blobs[d[at[:-1]]].tobytes(), np.diff(at).astype(np.uint32).tobytes(), planes(ref[part])
            keys, checks = (b"", b"") if kind == TOLD else (key[part].tobytes(), check[part].tobytes())
            self.rows.append((int(bucket[a]), mode, kind, docs, counts, refs, keys, checks))
            self.size += len(docs) + len(counts) + len(refs) + len(keys) + len(checks)

    def send(self, mode: int, key: np.ndarray, check: np.ndarray, doc: np.ndarray, ref: np.ndarray) -> None:
        """key (uint64) and check (uint32) of each occurrence; ref (uint64) comes back with the answer."""
        if not len(key):
            return
        order, cut = _groups(key, check)
        first, size = order[cut[:-1]], np.diff(cut)
        bucket = ((mix(key) >> U64(32)) * U64(self.buckets) >> U64(32)).astype(np.int64)
        if mode == SAME:
            # a repeated key's first occurrence is asked for as well, for it may have to lead
            asked, known, told = first, first[size > 1], order[np.repeat(size > 1, size)]
        else:  # one occurrence for each check; checks that differ within the slice settle it
            keys = key[first]
            at = _cuts(keys)
            many = np.repeat(np.diff(at) > 1, np.diff(at))
            told, asked, known = first[many], first if self.every else first[~many], first[at[:-1]][np.diff(at) > 1]
        self._by_bucket(mode, ASK, bucket[asked], doc[asked], ref[asked], key[asked], check[asked])
        self._by_bucket(mode, KNOWN, bucket[known], None, None, key[known], check[known])
        if len(told):
            home = self.blobs[doc[told]][:, :4].copy().view(np.uint32).ravel().astype(np.int64) % self.buckets
            self._by_bucket(mode, TOLD, home, doc[told], ref[told], key, check)

    def batch(self) -> pa.RecordBatch:
        """The rows so far, which are then let go."""
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        rows, self.rows, self.size = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], SENT_NAMES)


def _binary(values: np.ndarray, width: int, counts: np.ndarray) -> pa.Array:
    """A binary array whose items are counts[k] values of so many bytes."""
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def sorted_repeats(runs: list[tuple[np.ndarray, np.ndarray]], settled: np.ndarray, past: np.ndarray, mode: int) -> tuple[np.ndarray, np.ndarray]:
    """For the keys of all runs together: which repeat (or are mixed), and which is the first of its kind.

    Keys that only the past has are none of these.
    """
    key, check = (np.concatenate([r[k] for r in runs]) for k in (0, 1))
    order, cut = _groups(key, check)
    hit, lead = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if mode == SAME:
        size = np.diff(cut)
        new = np.add.reduceat((~past[order]).astype(np.int64), cut[:-1]) > 0
        dup = new & ((size > 1) | (np.add.reduceat(settled[order].astype(np.int64), cut[:-1]) > 0))
        hit[order] = np.repeat(dup, size)
        asks = np.where(settled[order] | past[order], len(key), order)
        best = np.minimum.reduceat(asks, cut[:-1])
        lead[best[dup & (best < len(key))]] = True
    else:
        at = _cuts(key[order])
        kinds = np.diff(np.searchsorted(cut[:-1], at))
        mixed = (kinds > 1) | (np.add.reduceat(settled[order].astype(np.int64), at[:-1]) > 0)
        mixed &= np.add.reduceat((~past[order]).astype(np.int64), at[:-1]) > 0
        hit[order] = np.repeat(mixed, np.diff(at))
    return hit, lead


def _homes(docs: np.ndarray, homes: int) -> np.ndarray:
    """Where the answers to a text are gathered: by its content address."""
    return docs[:, :4].copy().view(np.uint32).ravel().astype(np.int64) % homes


def answer(homes: int, find: Callable = sorted_repeats) -> Callable[[pa.Table], pa.Table]:
    """The function of a bucket's group: packed rows, one a home, for the occurrences whose key repeats."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        rows = table.to_pylist()
        for mode in (SAME, MIXED):
            # any order of arrival gives one answer; the levels of earlier batches come first
            mine = sorted((r for r in rows if r["mode"] == mode), key=lambda r: (r["kind"] != PAST, r["docs"], r["keys"]))
            asks = [r for r in mine if r["kind"] != TOLD]
            docs, refs, leads = [np.zeros((0, 16), np.uint8)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for r in mine:
                if r["kind"] == TOLD:
                    docs.append(owners(r["docs"], r["counts"]))
                    refs.append(unplaned(r["refs"], np.uint64))
                    leads.append(np.zeros(len(refs[-1]), bool))
            if asks:
                runs = [(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["checks"], np.uint32)) for r in asks]
                settled, past = (np.repeat([r["kind"] == k for r in asks], [len(r[0]) for r in runs]) for k in (KNOWN, PAST))
                hit, lead = find(runs, settled, past, mode)
                owned = hit[~settled]
                docs.append(np.concatenate([owners(r["docs"], r["counts"]) for r in asks])[owned])
                refs.append(np.concatenate([unplaned(r["refs"], np.uint64) for r in asks if r["kind"] != KNOWN] or refs)[owned])
                leads.append(lead[~settled][owned])
            doc, ref, led = np.concatenate(docs), np.concatenate(refs), np.concatenate(leads)
            home = _homes(doc, homes)
            order = np.argsort(home, kind="stable")
            cut = _cuts(home[order])
            for a, b in zip(cut, cut[1:], strict=False):
                part = order[a:b]
                at = _cuts(doc[part].view("V16").ravel())
                out.append((int(home[part[0]]), mode, doc[part[at[:-1]]].tobytes(), np.diff(at).astype(np.uint32).tobytes(), planes(ref[part]), led[part].tobytes()))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["home", "mode", "docs", "counts", "refs", "leads"])

    return run


def gather(table: pa.Table) -> pa.Table:
    """The function of a home's group: one row a text, with the places whose keys repeat, are mixed, or lead."""
    rows = table.to_pylist()
    doc = np.concatenate([owners(r["docs"], r["counts"]) for r in rows])
    ref = np.concatenate([unplaned(r["refs"], np.uint64) for r in rows])
    led = np.concatenate([np.frombuffer(r["leads"], bool) for r in rows])
    mixed = np.repeat([r["mode"] == MIXED for r in rows], [len(r["leads"]) for r in rows])
    name, owner = _distinct(doc)
    columns = []
    for which in (~mixed, mixed, led):
        o, r = owner[which], ref[which]
        order = np.lexsort((r, o))
        o, r = o[order], r[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (r[1:] != r[:-1])
        columns.append(_binary(r[new], 8, np.bincount(o[new], minlength=len(name))))
    return pa.table([_binary(name, 16, np.ones(len(name), np.int64)), *columns], ["blob", "same", "mixed", "leads"])


def union_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that ranges cover; ranges that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.r_[at[1:], len(start)] - 1] if len(at) else end


def _distinct(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 16-byte rows and the row of each."""
    pair = np.ascontiguousarray(doc).view(np.uint64)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    p = pair[order]
    new = np.r_[True, (p[1:] != p[:-1]).any(1)]
    owner = np.empty(len(doc), np.int64)
    owner[order] = np.cumsum(new) - 1
    return np.ascontiguousarray(doc[order[new]]), owner


class Replies:
    """The answers to the keys of one text."""

    __slots__ = ("same", "mixed", "leads")

    def __init__(self, same: bytes | None, mixed: bytes | None, leads: bytes | None):
        self.same, self.mixed, self.leads = (np.frombuffer(x or b"", np.int64) for x in (same, mixed, leads))

    @classmethod
    def column(cls, batch: pa.RecordBatch, name: str) -> list[Replies]:
        none = {"same": None, "mixed": None, "leads": None}
        return [cls(**(x or none)) for x in batch.column(name).to_pylist()]


class Method:
    """What the two operators bring: keys of a slice, windows to be judged, and the removal."""

    find: Callable = staticmethod(sorted_repeats)
    keys_per_byte = 0.05
    result = ""

    def keys(self, sender: Sender, texts_: list[bytes]) -> Iterator[None]:
        raise NotImplementedError

    def windows(self, sender: Sender, texts_: list[bytes], replies: list[Replies]) -> Iterator[None]:
        """Like keys, sends and yields now and then, so that what is sent can be handed on."""
        raise NotImplementedError

    def remove(self, text: bytes, copied: bool, first: Replies, second: Replies) -> tuple:
        raise NotImplementedError


def asking(method: Method, buckets: int, windows: bool, every: bool = False):
    """The map pass that sends the keys of texts, or the windows that the replies leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if windows:
                batch = batch.filter(batch.column("text").is_valid())
            for part, ts in text_slices(batch, "text", SLICE):
                sender = Sender(part.column("blob").to_pylist(), buckets, every)
                for _ in method.windows(sender, ts, Replies.column(part, "replies")) if windows else method.keys(sender, ts):
                    if sender.size > FLUSH:
                        yield sender.batch()
                if sender.rows:
                    yield sender.batch()

    return run


def removing(method: Method):
    """The map pass that turns texts and answers into the method's result."""
    names = ["blob", *(x.split()[0] for x in method.result.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ts in text_slices(batch, "text", SLICE):
                copied = [n > 1 for n in part.column("copies").to_pylist()]
                rows = [method.remove(*x) for x in zip(ts, copied, Replies.column(part, "replies"), Replies.column(part, "more"), strict=True)]
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("blob"), *columns], names)

    return run


def replies(asked: DataFrame, buckets: int, find: Callable, name: str) -> DataFrame:
    """(blob, struct of answers) from the rows of a map pass; both exchanges carry packed rows."""
    answers = asked.groupBy("bucket").applyInArrow(answer(buckets, find), ANSWER)
    return answers.groupBy("home").applyInArrow(gather, REPLY).select("blob", F.struct("same", "mixed", "leads").alias(name))


def blobs_of(docs: DataFrame) -> DataFrame:
    """blob (content address), text and copies of each distinct text. Null texts count as empty."""
    return texts(docs).select(blob_key(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def spread(docs: DataFrame, done: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every row of docs (columns, doc_id unless given) with what done(blob, ...) says of its text."""
    address = fresh(docs, "address")
    paths = docs.select(*(columns or ["doc_id"]), blob_key(F.coalesce("text", F.lit(""))).alias(address))
    return join_summary(paths, done.withColumnRenamed("blob", address), address).drop(address)


def remove_repeats(docs: DataFrame, method: Method, columns: list[str] | None = None) -> DataFrame:
    """Every row of docs (columns, doc_id unless given) with the method's result for its text.

    Equal texts are judged once, with their number of copies. The exchange that brings them together serves all
    three passes. Null texts count as empty; rows that repeat each have their own result row; an empty table has none.
    Long texts are worked on stretch by stretch and whole: a task holds a few bytes for each byte of its longest text.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size * method.keys_per_byte) // BUCKET_KEYS))
    blobs = blobs_of(docs)
    first = replies(blobs.mapInArrow(asking(method, buckets, False), SENT), buckets, method.find, "replies")
    with_first = join_rows(blobs, first, "blob", "left")
    # a filter would turn the join into an inner one with another scan below, and the exchange could not be shared
    asked = with_first.withColumn("text", F.when(F.col("replies").isNotNull(), F.col("text")))
    second = replies(asked.mapInArrow(asking(method, buckets, True), SENT), buckets, method.find, "more")
    done = join_rows(with_first, second, "blob", "left").mapInArrow(removing(method), f"blob binary, {method.result}")
    return spread(docs, done, columns)
