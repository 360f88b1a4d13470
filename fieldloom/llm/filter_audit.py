"""Filter interaction audit: what each filter removes in every order of the filters.

Each text's statistics are counted over its Arrow buffer: a table gives every byte its classes, prefix sums at the
texts' borders give counts, and sorted hashes of a text's words, compared byte by byte where they are equal, give its
distinct words. What a row fails is a mask of five bits, so all orders follow from a count by part and mask.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import SPACE_BYTES, BufferWords, flat_texts, row_slices
from .common import Stage, blob_key, documents, join_summary, widen

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 3
#: Bytes of text that are counted together, and bytes that one prefix sum covers.
SLICE, STRETCH = 1 << 22, 1 << 20

_SPACE, _CAPITAL, _SYMBOL, _POINT = 1, 2, 4, 8
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[SPACE_BYTES] |= _SPACE
_CLASSES[ord("A") : ord("Z") + 1] |= _CAPITAL
_CLASSES[list(SYMBOLS)] |= _SYMBOL
_CLASSES[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT


@dataclass
class Statistics:
    """One number a text."""

    words: np.ndarray
    distinct: np.ndarray
    capitals: np.ndarray
    symbols: np.ndarray
    points: np.ndarray

    def fails(self) -> np.ndarray:
        """Bit k for the k-th of the filters that look at one text alone."""
        tests = (
            self.words < LEAST_WORDS,
            100 * self.distinct < LEAST_DISTINCT_PERCENT * self.words,
            100 * self.capitals > MOST_CAPITALS_PERCENT * self.points,
            self.symbols > 0,
        )
        return sum(t.astype(np.int32) << k for k, t in enumerate(tests))


def _distinct(words: BufferWords, texts: int) -> np.ndarray:
    """Distinct words of each text. Where two words share a hash only, that text's words are compared themselves."""
    order = np.lexsort((words.hash, words.text))
    a, b = order[:-1], order[1:]
    pairs = np.flatnonzero((words.text[a] == words.text[b]) & (words.hash[a] == words.hash[b]))
    a, b = a[pairs], b[pairs]
    same = words.same(a, b)
    out = np.bincount(words.text, minlength=texts) - np.bincount(words.text[a[same]], minlength=texts)
    for t in np.unique(words.text[a[~same]]).tolist():
        out[t] = len({words.bytes(k) for k in range(*np.searchsorted(words.text, (t, t + 1)))})
    return out


def statistics(column: pa.Array) -> Statistics:
    """Counts of each text of a column without nulls."""
    data, at = flat_texts(column)
    texts, classes = len(at) - 1, _CLASSES[data]
    counts = {c: np.zeros(texts, np.int64) for c in (_CAPITAL, _SYMBOL, _POINT)}
    for lo in range(0, len(data), STRETCH):
        part = classes[lo : lo + STRETCH]
        first, last = np.searchsorted(at, (lo, lo + len(part)), "right")
        first, last = max(0, first - 1), min(texts, last)
        border = np.clip(at[first : last + 1], lo, lo + len(part)) - lo
        for c, total in counts.items():
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum((part & c) > 0)))
            total[first:last] += np.diff(sums[border])
    words = BufferWords(data, (classes & _SPACE) > 0, at)
    return Statistics(np.bincount(words.text, minlength=texts), _distinct(words, texts), counts[_CAPITAL], counts[_SYMBOL], counts[_POINT])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE bytes at a time, with the mask of what each text fails in place of the text."""
    for some in row_slices(batches, "text", SLICE):
        fails = pa.array(statistics(some.column("text")).fails().astype(np.int32))
        yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("part"), some.column("content"), fails], ["doc_id", "part", "content", "fails"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): rows by lang (null: empty) and mask, and how many of them labels call good or toxic.

    A null text is an empty one. A text that some row of a smaller id has too fails E; a row without an id fails it
    never and makes no other row fail it. Equal texts are told by 128 bits of SHA-256. An id that labels hold more than
    once is good or toxic if one of its rows says so; rows without an id are neither. Extra columns are left behind; empty tables give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = widen(docs).select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), blob_key(text).alias("content"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = Stage(rows.mapInArrow(_marked, f"doc_id {kind}, part string, content binary, fails int"), "filter-marks")
    copies = marks.df.groupBy("content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("content", "first")
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic")).where("good = 1 OR toxic = 1")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    rows = join_summary(marks.df, copies, "content", "left").select("doc_id", "part", F.when(late, F.col("fails") + 16).otherwise(F.col("fails")).alias("fails"))
    rows = join_summary(rows, judged, "doc_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    counts = Stage(rows.groupBy("part", "fails").agg(F.count("*").alias("n"), *sums), "filter-counts")
    marks.drop()
    return counts.df


def _of_cells(amount: str, test: Column) -> Column:
    """Sum of amount over a part's cells that pass the test, which is a function of a cell."""
    return F.aggregate("cells", F.lit(0).cast("long"), lambda total, c: total + F.when(test(c), c[amount]).otherwise(F.lit(0).cast("long")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step, zeros included, from the masks of mask_counts(), which has the
    cases of odd rows. A part's at most 32 masks are one array, so each part is 600 rows made of one."""
    cells = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))
    rows = cells.select("part", "cells", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = [F.locate(f, F.col("filter_order")) for f in FILTERS]
    bit, before = (sum((F.when(test(p), 1 << k).otherwise(0) for k, p in enumerate(place)), F.lit(0)) for test in (lambda p: p == F.col("step"), lambda p: p < F.col("step")))
    rows = rows.select("*", bit.alias("bit"), before.alias("before"))
    has = lambda c, b: c["fails"].bitwiseAND(F.col(b)) != 0
    removed = lambda c: has(c, "bit") & ~has(c, "before")
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda total, c: total + F.when(has(c, "bit"), c["n"] * F.expr("120L") / F.bit_count(c["fails"])).otherwise(F.lit(0)).cast("long"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        _of_cells("n", lambda c: ~has(c, "before") & ~has(c, "bit")).alias("kept"),
        _of_cells("n", removed).alias("removed"),
        _of_cells("n", lambda c: has(c, "bit") & has(c, "before")).alias("redundant"),
        _of_cells("n", lambda c: c["fails"] == F.col("bit")).alias("unique_fails"),
        _of_cells("good", removed).alias("good_lost"),
        _of_cells("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, order and step over all documents, as audit() defines them."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate("abcde"))
_TESTS = ", ".join(f"{c} AS {n}" for n, c in zip("abcd", (f"len(w) < {LEAST_WORDS}", f"100 * len(list_distinct(w)) < {LEAST_DISTINCT_PERCENT} * len(w)", f"100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS_PERCENT} * length(t)", "regexp_matches(t, '[#$%&*|]')"), strict=True))
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
m AS (SELECT doc_id, part, e, {_TESTS} FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, {_BITS} AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, CAST(1 << (ascii(filter_order[step]) - 65) AS INT) AS bit, CAST(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS INT) AS b FROM o, range(1, 6) r(step))
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce(sum({a}) FILTER (WHERE {t}), 0) AS BIGINT) AS {n}" for n, a, t in (("kept", "n", "fails & (bit | coalesce(b, 0)) = 0"), ("removed", "n", "fails & bit > 0 AND fails & coalesce(b, 0) = 0"), ("redundant", "n", "fails & bit > 0 AND fails & coalesce(b, 0) > 0"), ("unique_fails", "n", "fails = bit"), ("good_lost", "good", "fails & bit > 0 AND fails & coalesce(b, 0) = 0"), ("toxic_lost", "toxic", "fails & bit > 0 AND fails & coalesce(b, 0) = 0"), ("shapley", "n * 120 // greatest(1, bit_count(fails))", "fails & bit > 0")))}
FROM c, s GROUP BY part, filter_order, step"""
