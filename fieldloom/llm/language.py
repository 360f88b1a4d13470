"""Language identification: a linear-chain conditional random field over the words of a text.

Every word has a state score for each language, from affixes, n-grams of bytes and a lexicon; learned transitions tie
neighbours, so that switches within a text are told. Forward-backward gives each word's probabilities, and a text is of
the language that holds most of its words' probability.

The lexicon counts the words of all labelled texts by language. Weights and transitions are fitted on a bounded sample
(SAMPLE_ROWS texts a language), cut into spans that are joined into code-switched sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import LOW_BYTES, SPACE_BYTES, BufferWords, eights, flat_texts, row_slices
from .common import documents, widen
from .hashing import mix

UNKNOWN = "und"
#: Labelled texts a language that the weights are fitted on, and the longest of them in bytes. A language of longer texts
#: only is known by its lexicon.
SAMPLE_ROWS, SAMPLE_BYTES = 200, 20_000
#: Code-switched training sequences, their words, and the mean number of words before the language changes.
SEQUENCES, SEQUENCE_WORDS, SPAN_WORDS = 1_200, 48, 16
ROUNDS, RATE, DECAY = 60, 0.1, 1e-5
WEIGHT_BITS = 16
#: The lexicon has so many cells at most, buckets times languages.
LEXICON_CELLS = 1 << 20
SLICE = 1 << 21
#: Numbers that the products of neighbouring transitions take at most.
PRODUCTS = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[SPACE_BYTES] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("a") : ord("z") + 1] = True
_GRAMS, _AFFIXES = (2, 3, 4, 5), (1, 2, 3, 4)


def text_words(column: pa.Array) -> tuple[BufferWords, int]:
    data, at = flat_texts(column)
    return BufferWords(data, _SPACE[data], at), len(at) - 1


def _buckets(parts: np.ndarray, kind: int) -> np.ndarray:
    return (mix(parts ^ np.uint64(0x9E3779B97F4A7C15 * (kind + 1) % (1 << 64))) >> np.uint64(64 - WEIGHT_BITS)).astype(np.int32)


@dataclass
class Vocabulary:
    """Distinct words with their features: (bucket, word, value) in groups, and what each has of letters."""

    size: int
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    letters: np.ndarray

    @classmethod
    def of(cls, words: BufferWords, chosen: np.ndarray) -> Vocabulary:
        """Features of chosen words, lower-cased (A-Z), with a space at either end."""
        size, start = words.size[chosen], words.start[chosen]
        ends = np.cumsum(size + 2)
        begins = ends - size - 2
        owner = np.repeat(np.arange(len(chosen)), size + 2)
        data = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        inner = np.ones(len(data), bool)
        inner[begins] = inner[ends - 1] = False
        data[inner] = _LOWER[words.data[np.repeat(start - begins - 1, size) + np.flatnonzero(inner)]]
        loads, left, groups = eights(data), ends[owner] - np.arange(len(data)), []
        for n in _GRAMS:
            at = np.flatnonzero(left >= n)
            w = owner[at]
            value = 2.0 / np.bincount(w, minlength=len(chosen))[w]
            groups.append((_buckets(loads[at] & LOW_BYTES[n], n), w, value.astype(np.float32)))
        for n in _AFFIXES:
            w = np.flatnonzero(size >= n)
            one = np.ones(len(w), np.float32)
            groups.append((_buckets(loads[begins[w] + 1] & LOW_BYTES[n], 8 + n), w, one))
            groups.append((_buckets(loads[ends[w] - 1 - n] & LOW_BYTES[n], 16 + n), w, one))
        letters = np.zeros(len(chosen), bool)
        letters[owner[_ASCII_LETTER[data]]] = True
        for w in np.unique(owner[(data >= 0x80) & ~letters[owner]]).tolist():  # other alphabets, word by word
            letters[w] = any(map(str.isalpha, data[begins[w] : ends[w]].tobytes().decode()))
        return cls(len(chosen), groups, letters)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """State scores of each word: the sum of its features' weights."""
        out = np.zeros((self.size, weights.shape[1]))
        for bucket, word, value in self.groups:
            for k in range(weights.shape[1]):
                out[:, k] += np.bincount(word, weights[bucket, k] * value, self.size)
        return out

    def gradient(self, of_scores: np.ndarray) -> np.ndarray:
        out = np.zeros((1 << WEIGHT_BITS, of_scores.shape[1]))
        for bucket, word, value in self.groups:
            for k in range(of_scores.shape[1]):
                out[:, k] += np.bincount(bucket, of_scores[word, k] * value, 1 << WEIGHT_BITS)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(scores: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over many texts in one flat sequence: probabilities of each word's languages.

    first marks where a text begins: what came before counts for nothing there. Words are cut into stretches that run
    side by side; products of a stretch's transitions carry from one to the next, so long texts are as exact as short.
    """
    n, many = scores.shape
    if not n:
        return np.zeros((0, many))
    length = max(64, -(-n * many * many // PRODUCTS))
    lanes = -(-n // length)
    psi = np.ones((lanes * length, many))
    psi[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    reset = np.ones(lanes * length, bool)
    reset[:n] = first
    psi, reset = psi.reshape(lanes, length, many), reset.reshape(lanes, length)
    through = np.broadcast_to(np.eye(many), (lanes, many, many))
    for t in range(length):
        on = np.where(reset[:, t, None, None], through.sum(axis=2, keepdims=True) * start, through @ move) * psi[:, t, None]
        through = on / on.max(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((lanes, many)), np.empty((lanes, many))
    enter[0], leave[-1] = 1.0 / many, 1.0 / many
    for k in range(1, lanes):
        enter[k] = _unit(enter[k - 1] @ through[k - 1])
        leave[-1 - k] = _unit(through[-k] @ leave[-k])
    ahead, a = np.empty_like(psi), enter
    for t in range(length):
        a = _unit(np.where(reset[:, t, None], start, a @ move) * psi[:, t])
        ahead[:, t] = a
    b = leave
    for t in range(length - 1, -1, -1):
        ahead[:, t] = _unit(ahead[:, t] * b)
        b = psi[:, t] * b
        b = _unit(np.where(reset[:, t, None], 1.0 / many, b @ move.T))
    return ahead.reshape(-1, many)[:n]


@dataclass
class Lexicon:
    """Smoothed log shares of each language among the occurrences of a bucket's words."""

    bits: int
    table: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.table[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]

    @classmethod
    def count(cls, train: DataFrame, languages: list[str]) -> Lexicon:
        """Counts the words of all texts of train(text, lang). A task sends one number a cell, whatever it has read."""
        many = len(languages)
        bits = max(4, (LEXICON_CELLS // many).bit_length() - 1)
        codes = {x: k for k, x in enumerate(languages)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(many << bits, np.int64)
            for some in row_slices(batches, "text", SLICE):
                words, _ = text_words(some.column("text"))
                lang = np.array([codes[x] for x in some.column("lang").to_pylist()])
                total += np.bincount((words.hash >> np.uint64(64 - bits)).astype(np.int64) * many + lang[words.text], minlength=len(total))
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

        cells = train.select("text", "lang").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(many << bits)
        counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        counts = counts.reshape(-1, many)
        share = counts / np.maximum(counts.sum(axis=0), 1.0)
        even = share.sum(axis=1, keepdims=True) / many + 1.0 / counts.sum().clip(1.0)
        return cls(bits, np.log((share + 0.1 * even) / (1.1 * even)).astype(np.float32))


@dataclass
class LanguageModel:
    languages: list[str]
    lexicon: Lexicon
    weights: np.ndarray  # a row a bucket
    trust: np.ndarray  # what the lexicon counts, by language
    move: np.ndarray  # from a language to the next word's, as factors
    start: np.ndarray

    def word_scores(self, words: BufferWords) -> tuple[np.ndarray, np.ndarray]:
        """State scores of every word, and whether it has a letter. A word without one speaks for no language."""
        _, chosen, back = np.unique(words.hash, return_index=True, return_inverse=True)
        v = Vocabulary.of(words, chosen)
        scores = (v.scores(self.weights) + self.trust * self.lexicon.of(words.hash[chosen])) * v.letters[:, None]
        return scores[back], v.letters[back]

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """A row a text: the mean of its words' probabilities over the words with letters. Zeros if it has none."""
        words, texts = text_words(column)
        scores, letters = self.word_scores(words)
        p = marginals(scores, np.diff(words.text, prepend=-1) > 0, self.move, self.start)
        mine = words.text[letters]
        sums = np.stack([np.bincount(mine, p[letters, k], texts) for k in range(len(self.languages))], axis=1)
        return sums / np.maximum(np.bincount(mine, minlength=texts), 1)[:, None]


def _id_remainder() -> Column:
    """crc32 of the id as text, modulo 3. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def _sample(train: DataFrame, languages: list[str]) -> list[tuple[str, str]]:
    """(lang, text) of at most SAMPLE_ROWS different texts a language, those of least hash among the not too long."""
    rows = train.where((F.octet_length("text") <= SAMPLE_BYTES) & (F.length(F.trim("text")) > 0)).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, 1.5 * SAMPLE_ROWS / max(1, counts.get(k, 1))))))
    rows = rows.where((F.col("h") / 2.0**64 + 0.5) <= share[F.col("lang")])
    picked = rows.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect()
    out, taken = [], dict.fromkeys(languages, 0)
    for r in picked:
        taken[r.lang] += 1
        if taken[r.lang] <= SAMPLE_ROWS:
            out.append((r.lang, r.text))
    return out


def _sequences(words: BufferWords, label: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Code-switched sequences: word numbers and labels. Spans of sampled texts follow one another, each of another
    language than the last."""
    r = np.random.default_rng(7)
    by = [np.flatnonzero(label == k) for k in range(many)]
    spoken = [k for k in range(many) if len(by[k])]
    pick, tags = np.zeros((SEQUENCES, SEQUENCE_WORDS), np.int64), np.zeros((SEQUENCES, SEQUENCE_WORDS), np.int64)
    for s in range(SEQUENCES):
        at, lang = 0, spoken[r.integers(len(spoken))]
        while at < SEQUENCE_WORDS:
            mine = by[lang]
            size = min(int(r.geometric(1.0 / SPAN_WORDS)), SEQUENCE_WORDS - at, len(mine))
            begin = int(r.integers(len(mine) - size + 1))
            pick[s, at : at + size], tags[s, at : at + size] = mine[begin : begin + size], lang
            at += size
            others = [k for k in spoken if k != lang] or spoken
            lang = others[r.integers(len(others))]
    return pick, tags


def train_model(train: DataFrame, languages: list[str]) -> LanguageModel:
    """The field that makes the sample's labels likely: full gradients from forward-backward, steps by Adam."""
    many, lexicon = len(languages), Lexicon.count(train, languages)
    sample = _sample(train, languages)
    words, _ = text_words(pa.array([t for _, t in sample], pa.string()))
    label = np.array([languages.index(x) for x, _ in sample], np.int64)[words.text]
    state = {"weights": np.zeros((1 << WEIGHT_BITS, many)), "trust": np.full(many, 0.5), "move": np.log(np.full((many, many), 1.0 / many)), "start": np.zeros(many)}
    if len(words):
        pick, tags = _sequences(words, label, many)
        _, chosen, back = np.unique(words.hash[pick.ravel()], return_index=True, return_inverse=True)
        chosen = pick.ravel()[chosen]
        v, lex = Vocabulary.of(words, chosen), lexicon.of(words.hash[chosen]).astype(np.float64)
        first = np.zeros(pick.shape, bool)
        first[:, 0] = True
        hot = np.eye(many)[tags.ravel()]
        pairs = np.zeros((many, many))
        np.add.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1.0)
        moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in state.items()}
        for step in range(1, ROUNDS + 1):
            scores = (v.scores(state["weights"]) + state["trust"] * lex) * v.letters[:, None]
            move, start = np.exp(state["move"]), np.exp(state["start"])
            p, across = _expectations(scores[back].reshape(*pick.shape, many), move, start)
            slope = np.stack([np.bincount(back, (p.reshape(-1, many) - hot)[:, k], v.size) for k in range(many)], axis=1) * v.letters[:, None] / pick.size
            slopes = {
                "weights": v.gradient(slope) + DECAY * state["weights"],
                "trust": (slope * lex).sum(axis=0),
                "move": (across - pairs) / pick.size,
                "start": (p[:, 0].sum(axis=0) - hot.reshape(*pick.shape, many)[:, 0].sum(axis=0)) / pick.size,
            }
            for k, g in slopes.items():
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                state[k] = state[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return LanguageModel(languages, lexicon, state["weights"].astype(np.float32), state["trust"], np.exp(state["move"]), np.exp(state["start"]))


def _expectations(scores: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels, and expected numbers of transitions, of sequences of one length."""
    psi = np.exp(scores - scores.max(axis=2, keepdims=True))
    ahead, across = np.empty_like(psi), np.zeros_like(move)
    a = _unit(start * psi[:, 0])
    ahead[:, 0] = a
    for t in range(1, psi.shape[1]):
        a = _unit(a @ move * psi[:, t])
        ahead[:, t] = a
    p, b = np.empty_like(psi), np.full_like(a, 1.0 / a.shape[1])
    p[:, -1] = ahead[:, -1]
    for t in range(psi.shape[1] - 1, 0, -1):
        after = psi[:, t] * b
        both = ahead[:, t - 1, :, None] * move * after[:, None]
        across += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = _unit(after @ move.T)
        p[:, t - 1] = _unit(ahead[:, t - 1] * b)
    return p, across


def fit(docs: DataFrame) -> LanguageModel | None:
    """The model of all documents with a language whose id's remainder isn't 1. None if there are none."""
    train = docs.where((_id_remainder() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    languages = sorted(r.lang for r in train.select("lang").distinct().collect())
    return train_model(train, languages) if languages else None


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its text alone.

    A null text, one without letters, and any text where nothing could be learned are UNKNOWN with score 0. The score
    is the mean probability of the predicted language over the words with letters; of languages that tie, the first in
    order of code points is taken. Equal rows are all kept, a null id isn't held out, extra columns are left behind.
    """
    rows = widen(docs).select("doc_id", (_id_remainder() == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(shared.value.languages if shared.value else []), UNKNOWN], object)
        for some in row_slices(batches, "text", SLICE):
            p = shared.value.probabilities(some.column("text")) if shared.value else np.zeros((len(some), 1))
            score = p.max(axis=1)
            lang = names[np.where(score > 0, p.argmax(axis=1), len(names) - 1)]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0))], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id's remainder isn't 1, as identify() defines it."""
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
