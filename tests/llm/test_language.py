"""Language identification: forward-backward against brute force, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fieldloom.llm import language

from .hard_cases import HARD, frame

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("products", [language.PRODUCTS, 1])
def test_marginals_are_those_of_all_paths(monkeypatch, products):
    monkeypatch.setattr(language, "PRODUCTS", products)
    r = np.random.default_rng(1)
    sizes = [1, 5, 3, 1, 6]
    scores, move, start = r.normal(size=(sum(sizes), 3)), np.exp(r.normal(size=(3, 3))), np.exp(r.normal(size=3))
    first = np.zeros(len(scores), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    want, at = np.zeros_like(scores), 0
    for n in sizes:
        for path in itertools.product(range(3), repeat=n):
            weight = start[path[0]] * np.prod([move[a, b] for a, b in itertools.pairwise(path)]) * np.exp(sum(scores[at + k, v] for k, v in enumerate(path)))
            for k, v in enumerate(path):
                want[at + k, v] += weight
        at += n
    want /= want.sum(axis=1, keepdims=True)
    assert np.abs(language.marginals(scores, first, move, start) - want).max() < 1e-12


def test_long_sequences_are_as_exact_as_short_ones():
    r = np.random.default_rng(2)
    scores, move = r.normal(size=(1000, 2)) * 5, np.array([[0.9, 0.1], [0.2, 0.8]])
    first = np.zeros(1000, bool)
    first[0] = True
    got = language.marginals(scores, first, move, np.ones(2))
    a, ahead = np.ones(2), []
    for t in range(1000):
        a = (a if t == 0 else a @ move) * np.exp(scores[t])
        a /= a.sum()
        ahead.append(a)
    b = np.ones(2)
    for t in range(999, -1, -1):
        p = ahead[t] * b
        assert np.abs(got[t] - p / p.sum()).max() < 1e-9
        b = move @ (np.exp(scores[t]) * b)
        b /= b.sum()


def test_features_gradient_is_that_of_the_scores():
    words, _ = language.text_words(pa.array(["Ab abc é x", "aaaaaaaaab 日本語"]))
    v = language.Vocabulary.of(words, np.arange(len(words)))
    r = np.random.default_rng(3)
    w, g = r.normal(size=(1 << language.WEIGHT_BITS, 2)), r.normal(size=(len(words), 2))
    assert abs((v.scores(w) * g).sum() - (v.gradient(g) * w).sum()) < 1e-9
    assert v.letters.tolist() == [True, True, True, True, True, True]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.op11_language_id(spark, DATA).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_switched_text_is_labelled_word_by_word(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs)
    parts = {k: next(r.text for r in docs.where(f"lang = '{k}' and n_chars between 150 and 900 and crc32(cast(string(doc_id) as binary)) % 3 = 1").orderBy("doc_id").collect()).split() for k in ("de", "es")}
    words, _ = language.text_words(pa.array([" ".join(parts["de"] + parts["es"])]))
    scores, _ = model.word_scores(words)
    p = language.marginals(scores, np.arange(len(words)) == 0, model.move, model.start)
    want = np.array([model.languages.index(k) for k in ("de", "es") for _ in parts[k]])
    assert (p.argmax(axis=1) == want).mean() > 0.9


def test_odd_rows(spark):
    texts = [*HARD, "und der die das", "und der die das", "12 34 !", None]
    ids = [*range(len(HARD)), 100, 100, None, None]
    docs = frame(spark, texts, ids)
    got = language.identify(docs, language.fit(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.lang_pred in ("en", "und") and (r.score == 0) == (r.lang_pred == "und")
    assert [r.lang_pred for r in got if r.doc_id is None] == ["und", "und"] and {r.lang_pred for r in got if r.doc_id == 100} == {"en"}
    nothing = docs.withColumn("lang", language.F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(nothing, language.fit(nothing)).collect()} == {"und"}
    assert language.identify(docs.limit(0), language.fit(docs.limit(0))).collect() == []


def test_prediction_takes_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    other = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "reverse(lang) AS lang", "'x' AS source", "n_chars")
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    b = {r.doc_id - 1000000: (r.lang_pred, r.score) for r in language.identify(other, model).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-9 for k in a)
