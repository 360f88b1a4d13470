"""Substring dedup over words by difference-cover anchors.

Positions of a text whose remainder modulo 21 is in a perfect difference set are anchors. For any two positions there is
a shift of less than 21 that takes both to anchors, so two equal windows of 35 words share an aligned anchor whose 15
words lie within both. Only anchors are hashed and exchanged (5 of 21 positions). Windows around an anchor that repeats
are then extended to all 35 words, by hashing them whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .hashing import U64, Words, range_hashes, word_bounds
from .repeats import SAME, Method, Replies, Sender, remove_repeats, union_spans

WINDOW = 35
PERIOD = 21
#: Every difference modulo 21 occurs once among these.
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
#: Windows that are hashed and sent together.
PART = 1 << 19
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def cover_starts(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words at which anchors begin, in texts that have a whole window, and their texts."""
    count = np.diff(w.first)
    owner = w.owner()
    inside = np.arange(len(w)) - w.first[owner]
    at = np.flatnonzero(_IN_COVER[inside % PERIOD] & (inside + ANCHOR <= count[owner]) & (count[owner] >= WINDOW))
    return at, owner[at]


class DifferenceCover(Method):
    keys_per_byte = 0.05
    result = "n_words long, n_removed long, kept_sha256 string"

    def keys(self, sender: Sender, texts_: list[bytes]) -> Iterator[None]:
        w = Words(texts_)
        at, owner = cover_starts(w)
        h = range_hashes(w.hash, at, at + ANCHOR)
        sender.send(SAME, h, np.zeros(len(at), np.uint32), owner, (at - w.first[owner]).astype(np.uint64))
        yield

    def windows(self, sender: Sender, texts_: list[bytes], replies: list[Replies]) -> Iterator[None]:
        w = Words(texts_)
        count = np.diff(w.first)
        edge = np.zeros(len(w) + 1, np.int32)
        for k, r in enumerate(replies):
            lo = np.maximum(r.same - (PERIOD - 1), 0)
            hi = np.minimum(r.same, count[k] - WINDOW)
            good = hi >= lo
            np.add.at(edge, w.first[k] + lo[good], 1)
            np.add.at(edge, w.first[k] + hi[good] + 1, -1)
        every = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        second = w.second_hash() if len(every) else w.hash  # the check shares nothing with the key, down to its words
        for a in range(0, len(every), PART):
            at = every[a : a + PART]
            owner = np.searchsorted(w.first, at, "right") - 1
            check = (range_hashes(second, at, at + WINDOW, 1) >> U64(32)).astype(np.uint32)
            sender.send(SAME, range_hashes(w.hash, at, at + WINDOW), check, owner, (at - w.first[owner]).astype(np.uint64))
            yield

    def remove(self, text: bytes, copied: bool, first: Replies, second: Replies) -> tuple:
        data = np.frombuffer(text + b" ", np.uint8)
        start, end = word_bounds(data)
        n = len(start)
        if copied and n >= WINDOW:
            return n, n, hashlib.sha256(b"").hexdigest()
        a, b = union_spans(second.same, second.same + WINDOW)
        # bytes of kept words and the one space after each, or nothing
        edge = np.zeros(len(data) + 1, np.int8)
        edge[start] = 1
        edge[end + 1] -= 1  # the space after a word, which is one byte before the next word at most
        gone = np.zeros(n + 1, np.int8)
        np.add.at(gone, a, 1)
        np.add.at(gone, b, -1)
        gone = np.cumsum(gone[:-1], dtype=np.int8) > 0
        edge[start[gone]] -= 1
        edge[end[gone] + 1] += 1
        kept = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
        kept = np.where((kept == 32) | ((kept >= 9) & (kept <= 13)), np.uint8(32), kept).tobytes()
        return n, int(gone.sum()), hashlib.sha256(kept[:-1]).hexdigest()


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, those removed and the digest of the rest. Null, empty and short texts lose nothing
    unless they hold a window; repeated rows with a window lose all; extra columns are left behind."""
    return remove_repeats(documents(spark, sf_dir), DifferenceCover())


ORACLE = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
s AS (SELECT *, count(*) OVER a AS n, string_agg(word, ' ') OVER a AS win FROM x WINDOW a AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
k AS (SELECT rid, i, word, n = 35 AND count(*) OVER (PARTITION BY n = 35, win) > 1 AS dup FROM s),
r AS (SELECT rid, i, word, bool_or(dup) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM k),
a AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (rid)"""
