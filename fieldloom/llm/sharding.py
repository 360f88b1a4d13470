"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until every splitter is exact.

Rows are ordered by a key (60 bits of the text's MD5, then 60 bits of the id's MD5, then the row's number). For each of
the shards - 1 targets the driver probes 4,096 boundaries within the cell that holds the target byte; one aggregation
over all partitions gives the bytes of these cells, and the next round probes within the one that the target falls into.
A round looks at the rows of at most shards - 1 cells, so the driver never sees more than that many times
4,096 counts. Then rows are exchanged once.

A splitter is set at the nearer edge of the group of equal texts that holds its target byte, so that a group stays
in one shard. Only a group larger than a 64th of a shard is cut: between its ids, and a group of one id between its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, documents, fresh

SHARDS = 40
#: A group of equal texts over a shard's size divided by this may be cut.
GROUP_PART = 64
KEY_BITS, PROBE_BITS = 60, 12
KEYS = ("k1", "k2", "k3")
#: Rows of a window partition that numbers slots, about.
SLOT_ROWS = 20_000


def _md5_key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _key_columns() -> list[Column]:
    """size and the three keys of a row. The third holds only once it is written."""
    text = F.coalesce("text", F.lit(""))
    return [(F.octet_length(text) + 16).cast("long"), _md5_key(text), _md5_key(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.monotonically_increasing_id()]


def sharding_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the keys. A null text counts as no bytes, a null id as an empty one."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    size, *keys = _key_columns()
    return docs.select("doc_id", size.alias("size"), crc, *(k.alias(n) for k, n in zip(keys, KEYS, strict=True)))


@dataclass
class _Target:
    """A splitter in search: the byte it wants, the cell that holds that byte and the bytes before it."""

    want: int  # in bytes times the number of shards
    low: int = 0
    bits: int = KEY_BITS
    before: int = 0
    group: tuple[int, ...] = ()  # the leading keys of the group that is being cut


def _probe(keys: DataFrame, targets: list[_Target]) -> dict[tuple, list]:
    """For each distinct cell that a target is in: (low, bytes, least key, greatest key) of its sub-cells, in order."""
    out: dict[tuple, list] = {}
    for bits, depth in sorted({(t.bits, len(t.group)) for t in targets}):
        cells = sorted({(t.group, t.low) for t in targets if t.bits == bits and len(t.group) == depth})
        column = F.col(KEYS[depth])
        step = max(0, bits - PROBE_BITS)
        inside = F.lit(False)
        for g in sorted({g for g, _ in cells}):
            here = F.lit(True)
            for name, value in zip(KEYS, g, strict=False):
                here = here & (F.col(name) == value)
            if bits < KEY_BITS:
                here = here & F.shiftright(column, bits).isin([x >> bits for y, x in cells if y == g])
            inside = inside | here
        groups = [F.col(n).alias(n) for n in KEYS[:depth]]
        sums = keys.where(inside).groupBy(*groups, F.shiftright(column, step).alias("cell")).agg(F.sum("size").alias("n"), F.min(column).alias("a"), F.max(column).alias("b"))
        for *g, cell, n, a, b in sorted(map(tuple, sums.collect())):
            low = cell << step
            out.setdefault((tuple(g), bits, (low >> bits) << bits), []).append((low, n, a, b, step))
    return out


def find_splitters(keys: DataFrame, shards: int = SHARDS) -> tuple[list[tuple[int, int, int]], int]:
    """The least (k1, k2, k3) of each shard but the first, and the number of rows."""
    total, count = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not count:
        return [], 0
    open_, found = {j: _Target(total * j) for j in range(1, shards)}, {}
    while open_:
        probed = _probe(keys, list(open_.values()))
        for j, t in list(open_.items()):
            before = t.before
            for low, n, a, b, step in probed[t.group, t.bits, t.low]:
                if t.want < (before + n) * shards:
                    break
                before += n
            t.low, t.bits, t.before = low, step, before
            if a != b:
                continue
            if len(t.group) < len(KEYS) - 1 and n * shards * GROUP_PART > total:
                t.group, t.low, t.bits = (*t.group, a), 0, KEY_BITS  # a large group: search on among its rows
                continue
            ahead = 2 * (t.want - before * shards) <= n * shards
            found[j] = ((*t.group, a if ahead else a + 1) + (0, 0))[: len(KEYS)]
            del open_[j]
    return [found[j] for j in range(1, shards)], count


def _shard(splitters: list[tuple[int, int, int]], keys: list[Column]) -> Column:
    """The number of splitters at or below the key, by binary search."""

    def below(at: tuple[int, ...], k: int = 0) -> Column:
        less = keys[k] < at[k]
        return less if k == len(at) - 1 or not any(at[k + 1 :]) else less | ((keys[k] == at[k]) & below(at, k + 1))

    def find(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(splitters[mid]), find(lo, mid)).otherwise(find(mid + 1, hi))

    return find(0, len(splitters)).cast("int")


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Empty tables give no rows. Null texts count as no bytes. Rows that are equal in text and id are told apart by their
    number. A row larger than a shard's share gets one to itself. Slots number a shard's rows from 0. Extra columns
    are left behind.
    """
    keys = Stage(sharding_keys(docs), "sharding-keys").df
    splitters, count = find_splitters(keys, shards)
    lanes = max(1, -(-count // (shards * SLOT_ROWS)))
    rows = keys.withColumn("shard", _shard(splitters, [F.col(k) for k in KEYS])).withColumn("lane", F.pmod("k2", F.lit(lanes)))
    if lanes > 1:  # rows of one text and id that would fill a lane are spread; there are few such groups, as each is large
        hot = keys.groupBy("k1", "k2").count().where(F.col("count") > SLOT_ROWS).drop("count")
        rows = rows.join(hot.withColumn("hot", F.lit(True)), ["k1", "k2"], "left")
        rows = rows.withColumn("lane", F.when(F.col("hot"), F.pmod(F.xxhash64("k3"), F.lit(lanes))).otherwise(F.col("lane")))
    slot = F.row_number().over(Window.partitionBy("shard", "lane").orderBy(*KEYS)).cast("long") - 1
    numbered = rows.withColumn("slot", slot)
    if lanes > 1:
        begins = F.sum("n").over(Window.partitionBy("shard").orderBy("lane")) - F.col("n")
        begin = rows.groupBy("shard", "lane").agg(F.count("*").alias("n")).select("shard", "lane", begins.alias("begin"))
        numbered = numbered.join(begin, ["shard", "lane"]).withColumn("slot", F.col("slot") + F.col("begin"))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents themselves in one folder a shard (shard=0, 1, ...), in key order, with one exchange. Other columns
    stay; one named shard would clash with the folders and is refused. A shard of many rows is written by several tasks."""
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("a column named shard would clash with the folders")
    names = fresh(docs, "size", *KEYS, "lane")
    size, *keys = names[:4]
    staged = Stage(docs.select("*", *(c.alias(n) for c, n in zip(_key_columns(), names, strict=False))), "sharding-rows").df
    splitters, count = find_splitters(staged.select(F.col(size).alias("size"), *(F.col(k).alias(n) for k, n in zip(keys, KEYS, strict=True))), shards)
    lanes = max(1, -(-count // (shards * SLOT_ROWS)))
    rows = staged.withColumn("shard", _shard(splitters, [F.col(k) for k in keys])).withColumn(names[4], F.pmod(F.xxhash64(keys[2]), F.lit(lanes)))
    rows.repartition(shards * lanes, "shard", names[4]).sortWithinPartitions("shard", *keys).drop(*names).write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot, as assign_shards defines them."""
    return assign_shards(documents(spark, sf_dir))


_BIT = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
# Slots are as here unless more than SLOT_ROWS rows are equal in text and id, which only the query spreads over lanes.
# DuckDB has no crc32: t is its table, made by its rule, and the list of a text's bytes is folded over it.
ORACLE = f"""WITH t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: {_BIT}) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
k AS (SELECT rid, doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x // 256, t[xor(x, y) % 256 + 1])), 4294967295) AS crc, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS k1,
 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k2 FROM d, t),
tot AS (SELECT CAST(sum(size) AS HUGEINT) AS total, count(*) AS cnt FROM k),
j AS (SELECT unnest(range(1, {SHARDS})) AS j),
g1 AS (SELECT k1, CAST(sum(size) AS HUGEINT) AS n FROM k GROUP BY k1),
c1 AS (SELECT k1, n, sum(n) OVER (ORDER BY k1) - n AS c FROM g1),
u1 AS (SELECT j.j, c1.*, total FROM j, tot, c1 WHERE c * {SHARDS} <= total * j.j AND total * j.j < (c + n) * {SHARDS}),
g2 AS (SELECT k1, k2, CAST(sum(size) AS HUGEINT) AS n, any_value(size) AS each FROM k GROUP BY k1, k2),
c2 AS (SELECT g2.k1, g2.k2, g2.n, each, c1.c + sum(g2.n) OVER (PARTITION BY g2.k1 ORDER BY g2.k2) - g2.n AS c FROM g2 JOIN c1 USING (k1)),
u2 AS (SELECT u1.j, c2.*, total FROM u1 JOIN c2 USING (k1) WHERE u1.n * {SHARDS * GROUP_PART} > total AND c2.c * {SHARDS} <= total * j AND total * j < (c2.c + c2.n) * {SHARDS}),
u3 AS (SELECT *, (total * j - c * {SHARDS}) // (each * {SHARDS}) AS i FROM u2 WHERE n * {SHARDS * GROUP_PART} > total),
s AS (SELECT j, CASE WHEN 2 * (total * j - c * {SHARDS}) <= n * {SHARDS} THEN k1 ELSE k1 + 1 END AS s1, CAST(0 AS BIGINT) AS s2, CAST(0 AS BIGINT) AS s3 FROM u1 WHERE n * {SHARDS * GROUP_PART} <= total
 UNION ALL SELECT j, k1, CASE WHEN 2 * (total * j - c * {SHARDS}) <= n * {SHARDS} THEN k2 ELSE k2 + 1 END, 0 FROM u2 WHERE n * {SHARDS * GROUP_PART} <= total
 UNION ALL SELECT j, k1, k2, CAST(CASE WHEN 2 * (total * j - (c + i * each) * {SHARDS}) <= each * {SHARDS} THEN i ELSE i + 1 END AS BIGINT) FROM u3),
n AS (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY rid) - 1 AS k3 FROM k),
r AS (SELECT n.*, (SELECT count(*) FROM s WHERE s.s1 < n.k1 OR (s.s1 = n.k1 AND (s.s2 < n.k2 OR (s.s2 = n.k2 AND s.s3 <= n.k3)))) AS shard, k2 % greatest(1, CAST(ceil(cnt / {SHARDS * SLOT_ROWS}.0) AS BIGINT)) AS lane FROM n, tot)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY lane, k1, k2, k3) - 1 AS slot,
 CAST(NULL AS INTEGER) AS grown_shard FROM r"""
