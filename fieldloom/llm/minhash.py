"""Near-duplicate detection: MinHash, banding, signature verification, exact confirmation, components.

Documents with the same shingle set are one class; only classes are compared. A class's signature has the minima
of many universal hash functions over its shingles, and classes that agree in a whole band share a bucket.
No bucket is expanded into all its pairs:

1. every member is compared with its bucket's least member, and what is linked is put in components;
2. members of buckets that still hold several components are compared with the bucket's most central member;
3. in buckets that even then hold several components, pairs across components are found by prefix, place and size filtering:
   two sets as alike as the threshold share one of the rarest shingles of each, with enough shingles after it.

So a large group of near copies costs a few comparisons a member, and no link between bucket mates is lost.
A pair at the threshold shares a bucket with probability 1 - (1 - 0.8**5)**32 > 0.999996.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, Stage, blob_key, documents, fresh, join_rows, join_summary, texts, widen
from .components import connected_components
from .hashing import U64, Words, digest16, mix, text_slices

BANDS, ROWS = 32, 5
#: A pair whose signatures agree less than the threshold by this much is not confirmed on full sets (8 deviations).
MARGIN = 0.25
SLICE = 1 << 20
#: Sizes of one class of sets are within this factor.
SIZE_STEP = 1.04
_R = np.random.default_rng(19970101)
_A = _R.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
_B = _R.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(ts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin.

    A text of fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    w = Words(ts, lower=True)
    count = np.diff(w.first)
    per = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(ts)), per)
    at = w.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):  # the sequence's length counts too, so that a short text differs from a shingle
        there = at + j < w.first[owner + 1]
        word = w.hash[np.minimum(at + j, max(len(w) - 1, 0))] if len(at) else h
        h = np.where(there, mix(h * U64(0x9E3779B97F4A7C15) + word + U64(1)), h)
    ends = np.cumsum(per)
    for a, b in zip((ends - per).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(ts) + 1))


def signatures(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minima of every hash function over each non-empty set: uint32 (sets, functions). Empty sets are all ones."""
    out = np.full((len(start) - 1, len(_A)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(start))
    x = (h >> U64(32)) ^ (h & U64(0xFFFFFFFF))
    group, total = 0, 0
    for end in range(1, len(full) + 1):  # so many sets at a time as fit a processor's cache
        total += start[full[end - 1] + 1] - start[full[end - 1]]
        if total < 1 << 15 and end < len(full):
            continue
        sets = full[group:end]
        lo, hi = start[sets[0]], start[sets[-1] + 1]
        part, cut = x[lo:hi], start[sets] - lo
        for f in range(len(_A)):
            out[sets, f] = np.minimum.reduceat((part * _A[f] + _B[f]) >> U64(32), cut)
        group, total = end, 0
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), np.uint64)
    h += np.arange(BANDS, dtype=np.uint64) << U64(40)
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        h = mix(h * U64(0x9E3779B97F4A7C15) + s[:, :, r])
    return h.view(np.int64)


def _lists(flat: np.ndarray, start: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat, kind))


def _sketch(k: int, with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ts in text_slices(batch, "text", SLICE):
                h, start = shingle_sets(ts, k)
                n = np.diff(start)
                sig = signatures(h, start)
                if with_sets:
                    flat = np.arange(0, sig.size + 1, sig.shape[1])
                    yield pa.RecordBatch.from_arrays([part.column("rep"), _lists(sig.view(np.int32).ravel(), flat, pa.int32()), _lists(h.view(np.int64), start, pa.int64())], ["rep", "sig", "shingles"])
                else:
                    bands = band_keys(sig)
                    key = pa.array([digest16(h[a:b].tobytes()) if b > a else None for a, b in zip(start, start[1:], strict=False)], pa.binary())
                    flat = np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("blob"), pa.array(n.astype(np.int64)), key, _lists(bands[n > 0].ravel(), flat, pa.int64())], ["doc_id", "blob", "n_shingles", "set_key", "bands"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have percent of their union in common or more. Signatures are compared first."""
    of = lambda side: sets.select(F.col("rep").alias(side), F.col("sig").alias(f"s{side}"), F.col("shingles").alias(f"x{side}"))
    both = join_rows(join_rows(pairs, of("a"), "a"), of("b"), "b")
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    inter = F.size(F.array_intersect("xa", "xb"))
    alike = both.where(agree >= (percent / 100 - MARGIN) * BANDS * ROWS)
    out = alike.select("a", "b", F.size("xa").alias("na"), F.size("xb").alias("nb"), inter.alias("inter"))
    return out.where(100 * F.col("inter") >= percent * (F.col("na") + F.col("nb") - F.col("inter"))).select("a", "b")


def _labelled(rows: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """rows(band, rep, ...) with comp, where the band still holds several components."""
    known = comps.select(F.col("a").alias("rep"), F.col("b").alias("comp"))
    rows = scratch.write(join_rows(rows, known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "minhash-labelled")
    mixed = rows.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    return join_summary(rows, mixed, "band")


def _prefixes(apart: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(rep, n, place, shingle, held): the first n - ceil(n * percent / 100) + 1 shingles of each member of apart.

    Shingles are ordered by how many of these members hold them, then by hash.
    """
    owned = join_rows(apart.select("rep").distinct(), sets.select("rep", "shingles"), "rep")
    shingles = owned.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = shingles.groupBy("shingle").agg(F.count("*").alias("held"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("held", "shingle"))
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    return scratch.write(join_summary(shingles, shared, "shingle").withColumn("place", place).where(F.col("place") <= first), "minhash-prefixes")


def _central_pairs(apart: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each member of another component with its bucket's most central one: that with the fewest shingles of its own."""
    own = prefixes.groupBy("rep").agg(F.count_if(F.col("held") == 1).alias("own"))
    rows = join_rows(apart, own, "rep")
    hubs = rows.groupBy("band").agg(F.min(F.struct("own", "rep", "comp")).alias("hub"))
    mates = join_summary(rows, hubs, "band").where(F.col("comp") != F.col("hub.comp"))
    return mates.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / float(np.log(SIZE_STEP))).cast("int")


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """rows(n, place, ...) once for each class of sizes (mine, other) that a partner may have for which the place isn't too late:
    even the least partner of the class asks for more shingles from there on than are left."""
    n, share = F.col("n"), percent / 100
    # a class beyond both ends, as logarithms are rounded
    classes = F.sequence(_size_class(F.floor(n * share)) - 1, _size_class(F.ceil(n / share)) + 1)
    out = rows.withColumn("mine", _size_class(n)).withColumn("other", F.explode(classes))
    least = F.greatest(F.floor(F.exp(F.col("other") * float(np.log(SIZE_STEP)))) - 1, F.ceil(n * share) - 1)
    return out.where((100 + percent) * (1 + n - F.col("place")) >= percent * (n + least))


def _prefix_pairs(apart: DataFrame, prefixes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) across components among the members of apart(band, rep, comp) that can reach percent.

    Sets that reach it have a first common shingle within both prefixes, and from there on as many shingles left as
    they must share. Members meet by shingle and classes of their sizes, and each only at places that leave enough for the
    other's class, so that pages of one template which share too little don't meet at all. One side is enough to come
    from outside a bucket's largest component, so that a large group isn't held against itself.
    """
    apart = scratch.write(apart, "minhash-apart")
    main = apart.groupBy("band", "comp").count().groupBy("band").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    outer = join_summary(apart, main, "band").where("comp <> main").select("rep").distinct()
    rows = scratch.write(_met(join_rows(prefixes.where("held > 1"), apart.select("rep", "comp").distinct(), "rep"), percent), "minhash-met")
    x, y = join_rows(rows, outer, "rep").alias("x"), rows.alias("y")
    left = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = (100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n"))
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.mine") == F.col("y.other")) & (F.col("x.other") == F.col("y.mine"))
    pairs = join_rows(x, y, met & (F.col("x.comp") != F.col("y.comp")) & enough)
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _joined(comps: Stage, confirmed: DataFrame) -> Stage:
    """The components when the near pairs of confirmed are added."""
    out = connected_components(comps.df.union(confirmed))
    comps.drop()
    return out


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, blob (content address), n_shingles, component_id, kept and first of every row of docs.

    Two texts are linked if they share percent of their distinct k-word shingles or more (words are lower-cased
    in A-Z). Null and empty texts and texts without words are linked with nothing. A component is named by its least
    id; kept says that a row has that id. Rows with a null id are linked like others and take their component's name,
    which is null where no row of it has an id; then they are kept. An id may stand for several texts: each is linked on
    its own. first says that a row has the text that stands for its component, which is that of the least id (of several
    texts of this id, the one of the least content address), so that one text of each component is first.
    """
    docs, scratch = texts(docs), Scratch()
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.withColumn("blob", blob_key(F.col("text")))
    sketch = Stage(widen(keyed).mapInArrow(_sketch(k, False), f"doc_id {kind}, blob binary, n_shingles long, set_key binary, bands array<long>"), "minhash-sketch")
    lead = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "blob")
    classes = sketch.df.where("set_key is not null").groupBy("set_key").agg(F.min(lead).alias("lead"), F.first("bands").alias("bands"))
    classes = Stage(classes.withColumn("rep", F.monotonically_increasing_id()), "minhash-classes").df  # numbers hold once they are written
    rows = classes.select("rep", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = scratch.write(join_summary(rows, hubs, "band"), "minhash-buckets")

    wanted = join_rows(members.select("rep").distinct(), classes.select("rep", F.col("lead.doc_id").alias("_id"), F.col("lead.blob").alias("_blob")), "rep")
    found = join_rows(keyed, wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("blob") == F.col("_blob")))
    sets = found.select("rep", "text").mapInArrow(_sketch(k, True), "rep long, sig array<int>, shingles array<long>").dropDuplicates(["rep"])
    sets = scratch.write(sets, "minhash-sets")

    first = members.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    comps = connected_components(_confirm(first, sets, percent))

    buckets = members.select("band", "rep")
    apart = scratch.write(_labelled(buckets, comps.df, scratch).select("band", "rep", "comp"), "minhash-apart")
    if not apart.isEmpty():
        prefixes = _prefixes(apart, sets, percent, scratch)
        comps = _joined(comps, _confirm(_central_pairs(apart, prefixes), sets, percent))
        apart = scratch.write(_labelled(buckets, comps.df, scratch).select("band", "rep", "comp"), "minhash-apart")
        if not apart.isEmpty():
            comps = _joined(comps, _confirm(_prefix_pairs(apart, prefixes, percent, scratch), sets, percent))
    scratch.clear()

    label = join_rows(classes, comps.df.select(F.col("a").alias("rep"), F.col("b").alias("comp")), "rep", "left").select("set_key", "lead", F.coalesce("comp", "rep").alias("comp"))
    leads = label.groupBy("comp").agg(F.min("lead").alias("head"))
    label = join_summary(label, leads, "comp").select("set_key", "head")
    rows = join_rows(sketch.df.select("doc_id", "blob", "n_shingles", "set_key"), label, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    stands = F.col("set_key").isNull() | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("blob") == F.col("head.blob")))
    rows = rows.select("doc_id", "blob", "n_shingles", component.alias("component_id"), F.coalesce(stands, F.lit(True)).alias("first"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return rows.select("doc_id", "blob", "n_shingles", "component_id", kept.alias("kept"), "first")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose text stands for its component in near_duplicates(), with all their columns; of rows equal in id
    and text, one. Null and empty texts stay."""
    blob, id_, gone = fresh(docs, "blob", "id", "gone")
    out = near_duplicates(docs, k, percent).where(~F.col("first")).select(F.col("doc_id").alias(id_), F.col("blob").alias(gone)).distinct()
    rows = docs.withColumn(blob, blob_key(F.coalesce("text", F.lit(""))))
    rows = join_rows(rows, out, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(blob) == F.col(gone)), "left_anti")
    return rows.dropDuplicates(["doc_id", blob]).drop(blob)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component and whether it stays, as near_duplicates defines them. Long texts are sketched
    whole, extra columns are left behind."""
    return near_duplicates(documents(spark, sf_dir)).drop("blob", "first")


ORACLE = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 80 * (len(sa.s) + len(sb.s) - n)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN c ON c.a = doc_id"""
