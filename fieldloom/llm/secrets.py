"""Secret scanning with an incremental blob ledger, in DataFrame expressions only.

Every version of every document is addressed by its content. Only pairs of a blob and a rule version
that the ledger has not seen are scanned; findings are kept by blob and joined back to all paths
(document versions) that have this content. A rule that changes gets a new version, so that it alone is
run again.

Positions come without a UDF: the matches of a pattern and the gaps between them alternate, so a running
sum over their lengths gives each match's start in code points.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, blob_key, documents, fresh, join_rows, join_summary, texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret. hints: without one of these strings (in lower case) no match is possible."""

    kind: str
    pattern: str
    hints: tuple[str, ...] = ()
    group: int = 0
    least: int = 0
    version: str = field(init=False)

    def __post_init__(self):
        said = f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}"
        object.__setattr__(self, "version", f"{self.kind}@{hashlib.sha256(said.encode()).hexdigest()[:12]}")


#: The base kinds, in the order of the contract. A run of hexadecimal digits or an access key is as long as
#: it can be, so its least length may stand in the pattern; an assignment that is too short still uses up its text.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "apikey", "api_key"), 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", ("akia",)),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyj",)),
    Rule("url_login", r"[a-z]{3,10}://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/]{6,}@", ("://",)),
)
RULES = BASE + MORE


def _hit(rule: Rule, text: Column, lower: Column) -> Column:
    """True where the rule can match; cheap substring tests come before the regular expression."""
    hints = [F.contains(lower, F.lit(h)) for h in rule.hints]
    can = hints[0] if hints else F.lit(True)
    for h in hints[1:]:
        can = can | h
    return can & text.rlike(rule.pattern)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule_version, kind, rank, start, end) of each match in blobs(blob, text, todo); rank is the rule's place."""
    text, lower = F.col("text"), F.lower("text")
    runs = [
        F.when(
            F.array_contains("todo", rule.version) & _hit(rule, text, lower),
            F.struct(
                F.lit(rank).alias("rank"),
                F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x)).alias("gaps"),
                F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.char_length(x)).alias("sizes"),
                F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.char_length(x)).alias("bodies"),
            ),
        )
        for rank, rule in enumerate(rules)
    ]
    runs = blobs.select("blob", F.explode(F.array_compact(F.array(*runs))).alias("run"))
    matches = runs.select("blob", F.col("run.rank").alias("rank"), F.posexplode(F.arrays_zip("run.gaps", "run.sizes", "run.bodies")).alias("k", "m"))
    upto = Window.partitionBy("blob", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gaps").cast("long") + F.coalesce("m.sizes", F.lit(0))).over(upto)
    least, kind, version = (F.element_at(F.array(*[F.lit(getattr(r, name)) for r in rules]), F.col("rank") + 1) for name in ("least", "kind", "version"))
    found = matches.select("blob", "rank", "m", end.alias("end")).where(F.col("m.sizes").isNotNull() & (F.col("m.bodies") >= least))
    return found.select("blob", version.alias("rule_version"), kind.alias("kind"), "rank", (F.col("end") - F.col("m.sizes")).alias("start"), "end")


SEEN = "blob binary, rule_version string"
FINDINGS = "blob binary, rule_version string, kind string, rank int, start long, end long"


@dataclass
class Ledger:
    """What was scanned and what was found: seen(blob, rule_version) and findings(blob, rule_version, kind, rank, start, end)."""

    seen: DataFrame | None = None
    findings: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ledger:
        """The ledger kept in a folder; an empty one where nothing was kept yet."""
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return cls()
        kept = sorted(s.getPath().getName() for s in files.listStatus(folder))
        kept = [k for k in kept if files.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{k}/seen/_SUCCESS"))]  # written last
        if not kept:
            return cls()
        return cls(*(spark.read.schema(kind).parquet(*[f"{path}/{k}/{name}" for k in kept]) for name, kind in (("seen", SEEN), ("findings", FINDINGS))))


def scan(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, keep: str | None = None) -> Ledger:
    """Scan the contents of docs that the ledger has not seen under the rules' present versions.

    Null texts count as empty. Repeated rows, copies and hot contents cost one scan each. Returns the
    ledger with the new pairs and findings added; the findings are written to the shared folder, so
    later reads don't scan again. Findings of rule versions that are no longer in force stay out.

    keep: a folder to which the new pairs and findings are added, from which Ledger.load reads all of them again.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger()
    versions = [r.version for r in rules]
    blobs = texts(docs).select(blob_key(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    if ledger.seen is None:
        blobs = blobs.withColumn("todo", F.array(*[F.lit(v) for v in versions]))
    else:
        seen = ledger.seen.groupBy("blob").agg(F.collect_set("rule_version").alias("had"))
        rest = F.array_except(F.array(*[F.lit(v) for v in versions]), F.coalesce("had", F.array().cast("array<string>")))
        blobs = join_rows(blobs, seen, "blob", "left").withColumn("todo", rest).where(F.size("todo") > 0).drop("had")
    new = blobs.select("blob", F.explode("todo").alias("rule_version"))
    found = scan_blobs(blobs, rules)
    if keep:
        part = f"{keep}/{time.time_ns():020d}-{uuid.uuid4().hex}"
        found.write.parquet(f"{part}/findings")
        new.write.parquet(f"{part}/seen")
        found, new = spark.read.schema(FINDINGS).parquet(f"{part}/findings"), spark.read.schema(SEEN).parquet(f"{part}/seen")
    if ledger.findings is not None:
        ranks = spark.createDataFrame([(r.version, i) for i, r in enumerate(rules)], "rule_version string, rank int")
        found = found.unionByName(ledger.findings.drop("rank").join(F.broadcast(ranks), "rule_version").select(found.columns))
    seen = new if ledger.seen is None else ledger.seen.select("blob", "rule_version").unionByName(new)
    return Ledger(seen, found if keep else Stage(found, "secret-findings").df)


def _by_blob(ledger: Ledger, blob: str, spans: str) -> DataFrame:
    found = ledger.findings.groupBy(F.col("blob").alias(blob))
    return found.agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias(spans))


def spans_by_path(docs: DataFrame, ledger: Ledger, extra: list[str] | None = None) -> DataFrame:
    """Every row of docs with the findings of its content as an array of (start, rank, end, kind), in that order.

    extra: columns that come along; those named blob or spans give way to the content address and the array.
    """
    kept = [c for c in extra or ["doc_id"] if c.lower() not in ("blob", "spans")]
    paths = docs.select(*kept, blob_key(F.coalesce("text", F.lit(""))).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    found = Stage(_by_blob(ledger, "blob", "spans"), "secret-blobs").df
    return join_rows(paths, found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span (merged where they overlap) replaced by a mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        out = F.when(apart, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_documents(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """docs with every finding in text replaced by a mark, and n_chars made to fit where it changed."""
    blob, spans = fresh(docs, "blob", "spans")
    rows = join_summary(docs.withColumn(blob, blob_key(F.coalesce("text", F.lit("")))), _by_blob(ledger, blob, spans), blob, "left")
    rows = rows.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col(spans))))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(size))
    return rows.select(docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its spans. Null and empty texts have none, repeated rows each have their own, long texts are
    scanned whole, overlapping spans all count, extra columns are left behind."""
    docs = documents(spark, sf_dir)
    rows = spans_by_path(docs, scan(docs))
    of = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long")
    count = {r.kind: of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)}
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return rows.select("doc_id", *count.values(), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql_kind(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]").replace("'", "''")
    return f"""SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, unnest(range(1, len(g) + 1)) AS k, unnest(g) AS gap, unnest(list_resize(m, len(g), NULL)) AS hit,
 unnest(list_resize(b, len(g), NULL)) AS body FROM (SELECT rid, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS b FROM d)"""


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS ({" UNION ALL ".join(_sql_kind(i, r) for i, r in enumerate(RULES))}),
y AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY rid, rank ORDER BY k) AS e FROM x),
z AS (SELECT rid, rank, kind, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM y WHERE hit IS NOT NULL AND length(body) >= least),
a AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
 coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}), '') AS base,
 {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)} FROM z GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""
