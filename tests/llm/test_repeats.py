import hashlib
import random
import re
import resource
import time
from collections import Counter

import numpy as np
import pytest

from fieldloom.llm import minhash, tiling
from fieldloom.llm.byte_repeats import SuffixArrays, SuffixFamily, SuffixIndex
from fieldloom.llm.common import shared_dir
from fieldloom.llm.hashing import PRIME, Words, range_hashes
from fieldloom.llm.minhash import drop_near_duplicates, near_duplicates
from fieldloom.llm.repeats import remove_repeats
from fieldloom.llm.tiling import contaminated, tile_matches, tiles
from fieldloom.llm.word_repeats import COVER, PERIOD, DifferenceCover

from .hard_cases import HARD, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sample(spark):
    got = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    p, q = prose(11, 300), prose(12, 90)
    made = [p, p[5:], "start " + p[:700], p[100:499], p[100:501] + " é", q + " x " + q, q + " " + p[200:900] + " " + q, p, "a" * 1200, "ab" * 450, None, "", prose(13, 34), prose(13, 35), prose(13, 35) + " é"]
    edited = [" ".join(w if (k * 7 + e) % 61 else "edit" for k, w in enumerate(prose(14, 400).split())) for e in range(6)]
    return HARD + got + made + edited


def brute(units, window):
    seen = Counter(tuple(u[i : i + window]) if not isinstance(u, bytes) else u[i : i + window] for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u) + 1, np.int64)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window]) if not isinstance(u, bytes) else u[i : i + window]] > 1:
                gone[i] += 1
                if i + window <= len(u):
                    gone[i + window] -= 1
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


def test_bytes_equal_brute_force(spark):
    texts = sample(spark)
    gone = brute([(t or "").encode() for t in texts], 400)
    assert sum(g.sum() for g in gone) > 20_000
    rows = remove_repeats(frame(spark, texts), SuffixArrays()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b, g = (texts[r.doc_id] or "").encode(), gone[r.doc_id]
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        spans = int(np.count_nonzero(g & ~np.r_[False, g[:-1]])) if len(g) else 0
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), g.sum(), spans, hashlib.sha256(kept).hexdigest()), r.doc_id


def test_words_equal_brute_force(spark):
    texts = sample(spark)
    words = [WORD.findall(t or "") for t in texts]
    gone = brute(words, 35)
    rows = remove_repeats(frame(spark, texts), DifferenceCover()).collect()
    assert len(rows) == len(texts) and sum(g.sum() for g in gone) > 3000
    for r in rows:
        w, g = words[r.doc_id], gone[r.doc_id]
        kept = " ".join(x for x, y in zip(w, g, strict=True) if not y)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), g.sum(), hashlib.sha256(kept.encode()).hexdigest()), r.doc_id


@pytest.mark.parametrize("method", [SuffixArrays, DifferenceCover])
def test_repeats_of_nothing(spark, method):
    assert remove_repeats(frame(spark, []), method()).count() == 0
    assert {r.n_removed for r in remove_repeats(frame(spark, [None, "", "a"]), method()).collect()} == {0}


def test_cover_has_every_difference_once():
    assert Counter((a - b) % PERIOD for a in COVER for b in COVER if a != b) == Counter(range(1, PERIOD))


def test_family_keeps_few_levels_and_finds_all():
    rng, family, seen = np.random.default_rng(1), SuffixFamily(), {}
    for batch in range(37):
        keys = np.unique(rng.integers(0, 3000, 50)).astype(np.uint64)
        ids = np.arange(len(keys)) + batch * 100
        again, partners = family.add(keys, ids)
        want = {(int(i), seen[int(k)]) for k, i in zip(keys, ids, strict=True) if int(k) in seen}
        assert set(zip(again.tolist(), partners.tolist(), strict=True)) == want
        for k, i in zip(keys, ids, strict=True):
            seen.setdefault(int(k), int(i))
        assert len(family.levels) <= 6


def test_index_finds_what_batches_share_and_reads_none_again(spark, tmp_path):
    texts = [t for t in sample(spark) if t] * 2
    order = np.random.default_rng(4).permutation(len(texts))
    batches = np.array_split(order, 7)
    index, seen, most = SuffixIndex(spark, f"{shared_dir(spark)}/index-{tmp_path.name}", 4), Counter(), 0
    for number, batch in enumerate(batches):
        path = f"{tmp_path}/batch-{number}"
        frame(spark, [texts[k] for k in batch], [int(k) for k in batch]).write.parquet(path)
        rows = {r.doc_id: r for r in index.add(spark.read.parquet(path)).collect()}
        for f in (tmp_path / f"batch-{number}").iterdir():  # no later batch can read this one
            f.unlink()
        units = {int(k): texts[k].encode() for k in batch}
        seen.update(u[i : i + 400] for u in units.values() for i in range(len(u) - 399))
        assert set(rows) == set(units)
        for k, u in units.items():
            gone = np.zeros(len(u), bool)
            for i in range(len(u) - 399):
                if seen[u[i : i + 400]] > 1:
                    gone[i : i + 400] = True
            kept = np.frombuffer(u, np.uint8)[~gone].tobytes()
            assert (rows[k].n_removed, rows[k].kept_sha256) == (gone.sum(), hashlib.sha256(kept).hexdigest()), (number, k)
        most = max(most, len(index.levels()))
    assert most <= 3 and [rank for _, rank in index.levels()] == [2, 1, 0]


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n]


def test_ranges_hash_as_polynomials_modulo_a_prime():
    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 256, 500).astype(np.uint8), rng.integers(0, 1 << 63, 500).astype(np.uint64)):
        start = np.sort(rng.integers(0, 400, 200))
        end = start + rng.integers(0, 90, 200)
        for which in (0, 1):
            h = range_hashes(values, start, end, which)
            ranges = [values[a:b].tobytes() for a, b in zip(start, end, strict=True)]
            assert len(set(h.tolist())) == len(set(ranges))
            assert len(set(zip(ranges, h.tolist(), strict=True))) == len(set(ranges))
    big = np.tile(rng.integers(0, 256, 200_000).astype(np.uint8), 13)
    at = np.arange(0, 150_000, 37)
    assert (range_hashes(big, at, at + 400) == range_hashes(big[1_000_000:], at + 200_000, at + 200_400)).all()
    assert (range_hashes(big, np.array([0, 200_000]), np.array([2_100_000, 2_300_000])) == range_hashes(big, np.array([0, 0]), np.array([2_100_000] * 2))).all()
    assert PRIME == 2**61 - 1


def test_words_of_the_thue_morse_sequence_are_told_apart(spark):
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    w = Words([x.encode(), y.encode()])
    assert w.hash[0] != w.hash[1] and w.second_hash()[0] != w.second_hash()[1]
    assert {r.component_id for r in near_duplicates(frame(spark, [x, y])).collect()} == {0, 1}
    more = prose(70, 34)
    got = remove_repeats(frame(spark, [f"{x} {more}", f"{y} {more}"]), DifferenceCover()).collect()
    assert {r.n_removed for r in got} == {0}
    got = remove_repeats(frame(spark, [x[:512], y[:512], "z" + x[:400], y[:450] + "z"]), SuffixArrays()).collect()
    gone = brute([t.encode() for t in (x[:512], y[:512], "z" + x[:400], y[:450] + "z")], 400)
    assert {(r.doc_id, r.n_removed) for r in got} == {(k, g.sum()) for k, g in enumerate(gone)}
    item = spark.createDataFrame([(0, x)], "item_id long, text string")
    assert contaminated(frame(spark, [y]), item).count() == 0


@pytest.mark.parametrize("method", [SuffixArrays, DifferenceCover])
def test_long_texts(spark, method):
    long = " ".join(f"w{k}" for k in range(400_000))
    part = long[1_000_000:1_003_000]
    rows = {r.doc_id: r.n_removed for r in remove_repeats(frame(spark, [long, "x " + part + " y", "q" * 2_000_000]), method()).collect()}
    bytes_ = method is SuffixArrays
    assert rows[0] == rows[1] == (3000 if bytes_ else len(part.split()) - 2)
    assert rows[2] == (2_000_000 if bytes_ else 0)


# --- 5: near duplicates


def test_near_duplicates_of_long_texts(spark):
    long = [f"w{k}" for k in range(400_000)]
    other = [w if k % 40 else "x" for k, w in enumerate(long)]  # two of 40 shingles differ
    far = [w if k % 8 else "y" for k, w in enumerate(long)]
    rows = near_duplicates(frame(spark, [" ".join(t) for t in (long, other, far)])).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(0, 0), (1, 0), (2, 2)} and all(r.n_shingles == 399_999 for r in rows)


def sets(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    texts = sample(spark)
    for e in range(40):  # a chain and a ring of near copies around one text
        w = prose(21, 120).split()
        for j in range(e % 9):
            w[(e * 13 + j * 31) % 120] = f"z{e}"
        texts.append(" ".join(w))
    s = [sets(t, k) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    rows = near_duplicates(frame(spark, texts), k).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id), r.doc_id


def test_near_duplicates_of_odd_rows(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    rows = near_duplicates(frame(spark, ["a b c", "a b c", "a b c", None], [None, 5, 5, 6])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("5", "5", True), ("5", "5", True), ("6", "6", True), ("None", "5", False)]
    rows = near_duplicates(frame(spark, ["a b c", "a b c", "x y", None], [None, None, None, None])).collect()
    assert [(r.component_id, r.kept) for r in rows] == [(None, True)] * 4
    kept = drop_near_duplicates(frame(spark, ["a b c", "a b c", "x y", None, "a b c"], [None, None, None, None, 9])).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("9", "a b c"), ("None", "None"), ("None", "x y")]


def test_a_row_without_an_id_links_others(spark):
    words = prose(9, 100).split()
    texts = [" ".join(words[k : k + 92]) for k in (0, 4, 8)]  # neighbours share 88 of 96 words, the ends 84 of 100
    one, two, three = ({tuple(t.split()[k : k + 2]) for k in range(91)} for t in texts)
    assert all(100 * len(a & b) >= 85 * len(a | b) for a, b in ((one, two), (two, three))) and 100 * len(one & three) < 85 * len(one | three)
    rows = near_duplicates(frame(spark, texts, [4, None, 2]), percent=85).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept, r.first) for r in rows) == [("2", 2, True, True), ("4", 2, False, False), ("None", 2, False, False)]
    assert {r.component_id for r in near_duplicates(frame(spark, [texts[0], texts[2]], [4, 2]), percent=85).collect()} == {2, 4}


def test_pages_of_one_template_do_not_meet(spark, monkeypatch):
    shared = prose(1, 120, 10_000).split()
    texts = []
    for k in range(300):
        r, page = random.Random(k), list(shared)
        for n in range(20):
            page.insert(r.randrange(len(page)), f"own{k}x{n}")
        texts.append(" ".join(page))
    counts, confirm = [], minhash._confirm
    monkeypatch.setattr(minhash, "_confirm", lambda pairs, *more: (counts.append(pairs.count()), confirm(pairs, *more))[1])
    rows = near_duplicates(frame(spark, [*texts, texts[7] + " end"])).collect()
    assert sorted(r.component_id for r in rows) == sorted([*range(300), 7]) and counts[-1] < 300


def test_near_duplicates_under_an_id_of_many_texts(spark):
    made = [prose(50 + n, 60) for n in range(6)]
    near = [t + " end" for t in made]
    ids = [0] * 6 + list(range(10, 16)) + list(range(20, 26))
    rows = near_duplicates(frame(spark, made + made + near, ids)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == sorted((i, 0, i == 0) for i in ids)
    rows = near_duplicates(frame(spark, [made[0], near[0], made[0], made[1], made[0]], [3, 3, 3, 4, None])).collect()
    first = min((hashlib.sha256(t.encode()).digest(), t) for t in (made[0], near[0]))[1]
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == sorted([(3, 3, True)] * 3 + [(4, 4, True), (0, 3, False)])
    assert sorted(r.first for r in rows) == sorted([first == made[0]] * 2 + [first == near[0], True, False])
    kept = drop_near_duplicates(frame(spark, made + made + near, ids)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((0, t) for t in made)


# --- 4: greedy string tiling


def plain_tiling(a, b, least=5):
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = least - 1
        found = []
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j, n)]
                elif n == best and n >= least:
                    found.append((i, j, n))
        if not found:
            return out
        for i, j, n in found:
            if all(fa[i : i + n]) and all(fb[j : j + n]):
                fa[i : i + n] = fb[j : j + n] = [False] * n
                out.append((i, j, n))


def test_tiles_equal_plain_greedy_tiling():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = rng.integers(0, 30, 60).astype(np.uint64)
        cut = sorted(rng.integers(0, 60, 3))
        doc = np.concatenate([rng.integers(0, 30, 20), item[cut[1] : cut[2]], rng.integers(0, 4, 9), item[: cut[0]], item[cut[0] : cut[1]], item[10:25]]).astype(np.uint64)
        assert tiles(doc, item) == plain_tiling(doc.tolist(), item.tolist())


@pytest.mark.parametrize("bytes_", [8 << 20, 1])
def test_contamination(spark, monkeypatch, bytes_):
    monkeypatch.setattr(tiling, "BLOCK_BYTES", bytes_)  # sent to the tasks, or joined
    item = [prose(31, 40, 5000), prose(32, 40, 5000), "too short item", None, "", "one", "u v", "q w e r", "x1 x2 x3 x4 x5"]
    benchmark = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    a, b = item[0].split(), item[1].split()
    texts = [" ".join(a[20:] + ["x"] * 9 + a[:20]), " ".join(a[:15]).upper(), prose(33, 300, 5000), " ".join(a + b), None, "", "too short item", "it is One", "u x v", "q w e\nr", "x1 x2 x3 x4", "x5 x1 x2 x3 x4 x5"]
    texts.append(" ".join(a + a))
    want = []
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        for k, x in enumerate(item):
            x = (x or "").split()
            found = plain_tiling(w, x, min(5, len(x))) if x else []
            if x and 2 * sum(n for *_, n in found) >= len(x):
                want.append((d, k, len(found), sum(n for *_, n in found)))
    docs = frame(spark, texts)
    got = sorted((r.doc_id, r.item_id, r.n_tiles, r.n_covered) for r in contaminated(docs, benchmark).collect())
    assert got == want and {(0, 0, 2, 40), (6, 2, 1, 3), (7, 5, 1, 1), (9, 7, 1, 4)} <= set(want)
    assert {(r.doc_id, r.n_covered) for r in tile_matches(docs, benchmark).collect()} >= {(1, 15)}
    assert contaminated(docs, benchmark.where("false")).count() == 0
    left = tiling.drop_contaminated(docs.withColumn("_row", docs.doc_id), benchmark)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(range(len(texts))) - {d for d, *_ in want}) and left.columns == [*docs.columns, "_row"]


def test_tiles_of_equal_words_need_no_pairs():
    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = tiles(np.zeros(20_000, np.int64), np.zeros(1000, np.int64))
    assert found == [(0, 0, 1000)]
    item = np.arange(1000) % 2
    assert tiles(np.zeros(20_000, np.int64), item) == []
    assert sum(n for *_, n in tiles(np.arange(20_000) % 3 % 2, np.arange(999) % 3 % 2)) == 999
    assert time.perf_counter() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20
