import hashlib
import html
import re

import corpus_pipeline
import sentencepiece
from fieldloom.llm import html_text, quality, secrets
from fieldloom.llm.pieces import model_bytes

from .hard_cases import HARD, frame
from .test_repeats import plain_tiling, sets
from .test_row_operators import base_spans

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    whole = rows_of(docs)
    verdicts = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    good = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert rows_of(good) == [r for r in whole if verdicts[r["doc_id"]]] and good.columns == docs.columns

    kept = rows_of(corpus_pipeline.near_dedup(spark, docs, DATA))
    s = {r["doc_id"]: sets(r["text"], 5) for r in whole}
    ids, label = sorted(s), {i: i for i in s}
    for _ in range(5):
        for i in ids:
            for j in ids:
                if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert kept == [r for r in whole if label[r["doc_id"]] == r["doc_id"]] and len(kept) < len(whole)

    clean = rows_of(corpus_pipeline.decontamination(spark, docs, DATA))
    items = [re.findall(r"[^\x20\x09-\x0D]+", r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = set()
    for r in whole:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        seeds = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for x in items:
            if any(tuple(x[i : i + 5]) in seeds for i in range(len(x) - 4)) and 2 * sum(n for *_, n in plain_tiling(w, x)) >= len(x):
                bad.add(r["doc_id"])
    assert clean == [r for r in whole if r["doc_id"] not in bad] and bad

    safe = rows_of(corpus_pipeline.secret_scan(spark, docs, DATA))
    assert [r["doc_id"] for r in safe] == [r["doc_id"] for r in whole]
    for a, b in zip(whole, safe, strict=True):
        assert ("[SECRET]" in b["text"]) >= bool(base_spans(a["text"])) and not base_spans(b["text"])
        assert b["text"] == a["text"] or b["n_chars"] == len(b["text"])


def test_run_and_schema(spark):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    want = {r["doc_id"]: hashlib.sha256(",".join(map(str, sp.encode(r["text"]))).encode()).hexdigest() for r in rows_of(docs)}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and len(got) > 50


def test_stages_stand_hard_cases(spark):
    for texts, ids in ((HARD, None), (HARD, [None, 1, 1, *range(len(HARD) - 3)]), ([], None)):
        docs = frame(spark, texts, ids)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            n = out.count()
            assert n <= len(texts), name
            if name != "encoding":
                assert out.columns == docs.columns


# --- 6: main text


def test_field_on_held_out_pages():
    model = html_text.default_model()
    right = whole = pages = 0
    for k in range(50_000, 50_200):
        page, labels = html_text.labelled_page(k)
        got = model.label(html_text.blocks(page))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        whole += len(labels)
        pages += got == labels
    assert right >= 0.995 * whole and pages >= 190


def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body))
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_blocks_of_tag_soup():
    page = "<ul><li>a<li>b <a href='x>y'>c</a></ul><script>var t='</p>'</script><p>x &lt;i&gt; <b>y<p>z<br>w < 3<!-- c --><table><tr><td>1<td>2</table><style>"
    assert [b.text for b in html_text.blocks(page)] == ["a", "b c", "x <i> y", "z w < 3", "1", "2"]
    assert html_text.blocks("<") and html_text.blocks("") == []


def test_pages_of_odd_rows(spark):
    rows = [(1, None, None, 5), (1, "u", "", 5), (None, "u", "<p", 5), (2, "u", "plain words", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.where("false")).count() == 0


def test_redaction_of_overlapping_spans():
    assert secrets.BASE[0].version != secrets.Rule("assign", "x").version
