"""Quality rules: a learned decision list, in DataFrame expressions only.

Text statistics come from built-in functions. Sequential covering learns from labelled rows: it grows a
conjunction of thresholds by information gain, prunes it on rows held back, keeps it if it is precise enough,
takes the rows it covers out and goes on. Each growth step is one aggregation of counts by (statistic, bin,
label), so the driver sees a few hundred counts and never rows. The list is emitted as one ordered conditional
expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Stage, documents, join_summary, widen

WINDOW = 8
#: Candidate thresholds for each statistic, as quantiles of the labelled rows.
BINS = 32
MAX_RULES = 12
MAX_CONDITIONS = 3
#: A rule must be this precise on the rows it is grown on and on those it is pruned on, and cover so many.
PRECISION = 0.97
LEAST_COVER = 5
FEATURES = ("n_words", "mean_word", "symbol_share", "shout_share", "bang_share", "bar_share", "digit_share", "repeat_share", "line_share", "distinct_share")


def _count(text: Column, chars: str) -> Column:
    """Occurrences of some ASCII characters: plain replacement of each is much cheaper than translate or a pattern."""
    each = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return sum(each[1:], each[0]).cast("long")


def _repeat_words(table: DataFrame) -> DataFrame:
    """Adds n_repeat_words from words: windows are hashed to 64 bits, sorted, and equal neighbours' spans united.

    Hashes of one, two, four and eight words are made from those before. Arrays that lambdas look into are columns of
    their own, so that they are made once. Texts without a repeated window (most) stop at the distinct count.
    """
    table = table.withColumn("_hash", F.when(F.size("words") > WINDOW, F.transform("words", lambda w: F.xxhash64(w))))
    for step in (1, 2, 4):
        size = F.size("_hash") - step
        table = table.withColumn("_hash", F.zip_with(F.slice("_hash", F.lit(1), size), F.slice("_hash", F.lit(step + 1), size), lambda a, b: F.xxhash64(a, b)))
    order = F.array_sort(F.transform("_hash", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    table = table.withColumn("_order", F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), order))
    equal = lambda x, j: (F.get("_order", j - 1)["h"] == x["h"]) | F.coalesce(F.get("_order", j + 1)["h"] == x["h"], F.lit(False))
    first = lambda x, j: F.when(j == 0, F.coalesce(F.get("_order", j + 1)["h"] == x["h"], F.lit(False))).otherwise(equal(x, j))
    starts = F.sort_array(F.transform(F.filter("_order", first), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("n"))
    total = F.aggregate(starts, zero, step, lambda acc: acc["n"])
    return table.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_hash", "_order")


def text_statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, the contract's counts, base_failed and the learner's statistics for every row.

    carry: the whole row comes along as the struct _row.

    Null and empty texts have no words and fail the base rules. Words of a window are compared by 64-bit hash,
    within one text only.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    row = [F.struct("*").alias("_row")] if carry else []
    carried = ["_row"] if carry else []
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row)
    t = t.select(
        "doc_id",
        *carried,
        F.array_remove(F.split(text, SPACES), "").alias("words"),
        lines.alias("lines"),
        (F.char_length(text) - _count(text, " \t\n\x0b\x0c\r")).alias("word_chars"),
        _count(text, "#*$%&|<>").alias("n_symbols"),
        _count(text, "!").alias("_bangs"),
        _count(text, "|").alias("_bars"),
        _count(text, "0123456789").alias("_digits"),
        _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_capitals"),
    )
    t = _repeat_words(t)
    n = F.size("words").cast("long")
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest(n, F.lit(1))
    t = t.select(
        "doc_id",
        *carried,
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("_capitals") / chars).alias("shout_share"),
        (F.col("_bangs") / words).alias("bang_share"),
        (F.col("_bars") / words).alias("bar_share"),
        (F.col("_digits") / chars).alias("digit_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        ((F.size("lines") - F.size(F.array_distinct("lines"))) / F.greatest(F.size("lines"), F.lit(1))).alias("line_share"),
        (F.size(F.array_distinct("words")) / words).alias("distinct_share"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return t.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of going from p0 and n0 covered rows to p and n."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _choices(counts: dict, feature: int, thresholds: list[float]):
    """Counts above and below each threshold of a feature: bin b holds the values over threshold b - 1 and up to b."""
    keys = [("grow", 1), ("grow", 0), ("prune", 1), ("prune", 0)]
    cells = [[counts.get((feature, b, *k), 0) for k in keys] for b in range(len(thresholds) + 1)]
    total, below = [sum(x) for x in zip(*cells, strict=True)], [0] * 4
    for b, t in enumerate(thresholds):
        below = [x + y for x, y in zip(below, cells[b], strict=True)]
        yield False, t, below
        yield True, t, [x - y for x, y in zip(total, below, strict=True)]


def candidate_thresholds(rows: DataFrame, features: tuple[str, ...], bins: int = BINS) -> list[list[float]]:
    """For each feature the values at its k / bins quantiles, to a 128th of their size. Without rows: nothing.

    Values are counted exactly in cells of their leading eight binary digits, so the driver sees some thousand counts
    however many rows there are, and the answer doesn't depend on how they are partitioned. A threshold is the greatest
    value of its cell.
    """
    two = lambda v: F.pow(F.lit(2.0), F.floor(F.log2(v)))
    one = lambda v: F.when(v > 0, F.floor(v / two(v) * 128) * two(v)).otherwise(F.lit(0.0))
    values = rows.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("f", "v"))
    cells = values.groupBy("f", one(F.col("v")).alias("cell")).agg(F.count("*").alias("n"), F.max("v").alias("top")).collect()
    out = []
    for k in range(len(features)):
        mine = sorted((c.cell, c.top, c.n) for c in cells if c.f == k)
        total, upto, found = sum(n for *_, n in mine), 0, set()
        for _, top, n in mine:
            if any(upto * bins < total * q <= (upto + n) * bins for q in range(1, bins)):
                found.add(top)
            upto += n
        out.append(sorted(found))
    return out if cells else []


def learn_rules(labelled: DataFrame, features: tuple[str, ...] = FEATURES) -> list[Rule]:
    """Rules that cover bad rows of labelled(features..., bad 0/1, held boolean), in the order learned.

    All labelled rows count; none are collected. Without rows of both labels there are no rules.
    """
    thresholds = candidate_thresholds(labelled, features)
    if not thresholds:
        return []
    # counting the thresholds below a value gives its bin
    bins = [sum((F.col(f) > F.lit(t)).cast("int") for t in ts) for f, ts in zip(features, thresholds, strict=True)]
    table = Stage(labelled.select("bad", "held", *features, F.array(*bins).alias("bins")), "quality-labelled").df
    rules: list[Rule] = []
    left = table
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        path: list[tuple[int, int, int, int]] = []
        while len(rule) < MAX_CONDITIONS:
            rows = left.where(holds(tuple(rule))).select(F.posexplode("bins").alias("f", "b"), "bad", "held")
            counts = {(r.f, r.b, "prune" if r.held else "grow", r.bad): r["count"] for r in rows.groupBy("f", "b", "held", "bad").count().collect()}
            whole = [sum(v for k, v in counts.items() if k[0] == 0 and k[2:] == x) for x in (("grow", 1), ("grow", 0))]
            best = max(((_gain(c[0], c[1], *whole), -k, up, t, c) for k, f in enumerate(features) for up, t, c in _choices(counts, k, thresholds[k])), default=None)
            if not best or best[0] <= 1e-9:
                break
            rule.append(Condition(features[-best[1]], best[2], best[3]))
            path.append(tuple(best[4]))
            if path[-1][1] == 0:
                break
        # prune: of all heads of the rule the one that does best on the rows held back
        heads = [k for k, (p, n, hp, hn) in enumerate(path) if p >= LEAST_COVER and p >= PRECISION * (p + n) and hp and hp >= PRECISION * (hp + hn)]
        if not heads:
            break
        best_head = max(heads, key=lambda k: ((path[k][2] - path[k][3]) / (path[k][2] + path[k][3]), -k))
        rules.append(tuple(rule[: best_head + 1]))
        left = left.where(~holds(rules[-1]))
    return rules


def decide(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, or 0: the ordered conditional expression of the list."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(holds(rule), k) if out is None else out.when(holds(rule), k)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_verdicts(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """text_statistics with rule (0: none) and kept.

    A label counts if its quality is 0 or 1; of several labels of one id the worst holds. Rows with a null id
    have no label. Without labels the base rules alone decide.
    """
    stats = Stage(text_statistics(widen(docs), carry), "quality-statistics").df
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = join_summary(stats, known, "doc_id").select(*FEATURES, (1 - F.col("quality")).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"))
    stats = stats.withColumn("rule", decide(learn_rules(labelled)))
    return stats.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return quality_verdicts(docs, labels, carry=True).where("kept").select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict. Null and empty texts have no words and fail; repeated rows each have
    their own; long texts are counted whole; extra columns are left behind."""
    verdicts = quality_verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
