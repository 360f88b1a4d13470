"""Filter audit: statistics against plain Python, all orders against brute force."""

import itertools
import random
import re
from collections import Counter

import pyarrow as pa
from fieldloom.llm import buffers, filter_audit

from .hard_cases import HARD, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fails(text: str) -> str:
    words = WORD.findall(text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def some_texts() -> list[str]:
    r = random.Random(3)
    long = "y" * 70
    texts = [prose(k, r.choice([5, 150, 250, 400]), r.choice([20, 150, 4000])) for k in range(40)]
    texts = [t.upper() if k % 5 == 0 else t + " #" if k % 7 == 0 else t for k, t in enumerate(texts)]
    return [*texts, f"{long}a {long}b {long}a " * 80, "é" * 9 + " " + "éééé " * 300, "12345678 12345678 123456789 " * 90, *texts[:9]]


def test_statistics_of_each_text(monkeypatch):
    texts = [t for t in HARD if t is not None] + some_texts()
    for stretch in (filter_audit.STRETCH, 7):
        monkeypatch.setattr(filter_audit, "STRETCH", stretch)
        got = filter_audit.statistics(pa.array(["cut", *texts]).slice(1))
        assert got.words.tolist() == [len(WORD.findall(t)) for t in texts]
        assert got.distinct.tolist() == [len(set(WORD.findall(t))) for t in texts]
        assert got.capitals.tolist() == [len(re.findall("[A-Z]", t)) for t in texts]
        assert got.symbols.tolist() == [len(re.findall(r"[#$%&*|]", t)) for t in texts]
        assert got.points.tolist() == [len(t) for t in texts]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(buffers, "mix", lambda x: x & buffers.np.uint64(1))
    texts = [t for t in HARD if t is not None] + some_texts()
    assert filter_audit.statistics(pa.array(texts)).distinct.tolist() == [len(set(WORD.findall(t))) for t in texts]


def brute(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    """rows: (id, text, lang)."""
    texts: dict = {}
    for i, t, _ in rows:
        texts.setdefault(t or "", []).append(i)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, t, lang in rows:
        ids = [x for x in texts[t or ""] if x is not None]
        fails.append((i, lang or "", plain_fails(t or "") + ("E" if i is not None and ids and min(ids) < i else "")))
    out, shapley = [], Counter()
    for part in {p for _, p, _ in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in fails if f[1] == part]
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[2]]
                left = [f for f in left if name not in f[2]]
                shapley[part, name] += len(gone)
                mine = [f for f in fails if f[1] == part and name in f[2]]
                out.append((part, order, step, len(left), len(gone), len(mine) - len(gone), sum(f[2] == name for f in mine), sum(f[0] in good for f in gone), sum(f[0] in toxic for f in gone)))
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def test_all_orders_equal_brute_force(spark):
    texts = HARD + some_texts() + [None, "", "same"]
    r = random.Random(5)
    ids = [*range(len(texts) - 3), 2, None, None]
    langs = [r.choice(["en", "de", "", None]) for _ in texts]
    docs = frame(spark, texts, ids).drop("lang").withColumn("key", filter_audit.F.lit(1))
    docs = spark.createDataFrame([(*x, langs[k]) for k, x in enumerate(docs.collect())], f"{', '.join(f'{n} {t}' for n, t in docs.dtypes)}, lang string")
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in [*ids[::2], 3, 3, None]]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = brute([(x.doc_id, x.text, x.lang) for x in docs.collect()], labels)
    assert sorted(map(tuple, got.collect())) == want and len(want) % 600 == 0
    empty = filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert empty.collect() == [] and empty.columns == got.columns
    alone = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(alone) == len(want) and sum(x.good_lost + x.toxic_lost for x in alone) == 0
