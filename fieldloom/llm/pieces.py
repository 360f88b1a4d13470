"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words of a batch are flat numpy symbol arrays. Each round finds every adjacent pair that the
vocabulary can join, takes per word the pair of best rank (the leftmost of equals), merges these
simultaneously over all words and compacts, until no pair is left. That is the order in which the
library pops its agenda, so the ids are the same. A long word that can't be cut has rounds of its own, over linked
symbols: each merges all places of the least rank that nothing comes between.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from .common import documents, texts, widen

SPACE = "▁"
CACHED_WORDS = 300_000
#: Longer words are cut where no piece can cross; what is longer even then has rounds of its own.
LONG_WORD = 192
NONE = np.int64(1 << 30)
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCodec:
    """Encoder and decoder over the vocabulary of a SentencePiece BPE model with byte fallback.

    Only models with the identity normalizer, a dummy prefix, no user-defined and no unused pieces
    are taken; check() tells by what the library does with each piece. The library reads the vocabulary; encoding and
    decoding are done here.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.size, self.unk = size, sp.unk_id()
        piece = {sp.id_to_piece(i): i for i in plain}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        chars = sorted({c for p in piece for c in p})
        lone = [c for c in chars if c not in piece]
        self.symbols = {**piece, **{c: size + k for k, c in enumerate(lone)}}
        self.width = size + len(lone) + 1  # the last symbol stands for any other character
        keys, merged, ranks = [], [], []
        for p, i in piece.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    merged.append(i)
                    ranks.append(order[sp.get_score(i)])
        at = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[at]
        self.merged, self.ranks = np.array(merged, np.int64)[at], np.array(ranks, np.int64)[at]
        self.char_cp = np.array([ord(c) for c in chars], np.uint32)
        self.char_symbol = np.array([self.symbols[c] for c in chars], np.int64)
        self.inside = {p[k : k + 2] for p in piece for k in range(len(p) - 1)}
        if any(x[0] != SPACE and x[1] == SPACE for x in self.inside):
            raise ValueError("pieces with inner spaces are not supported")
        self.bytes_of = [b""] * size
        for i in plain:
            self.bytes_of[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        self.byte_value = {i: b for b, i in enumerate(self.byte_ids)}
        self.id_text = [str(i) for i in range(size)]
        #: Decoded bytes by id. A word's byte pieces make whole characters, so decoded words can be strung together.
        self.raw_of = [bytes((self.byte_value[i],)) if i in self.byte_value else self.bytes_of[i] for i in range(size)]
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        k = np.minimum(np.searchsorted(self.char_cp, cp), len(self.char_cp) - 1)
        return np.where(self.char_cp[k] == cp, self.char_symbol[k], self.width - 1), cp

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of adjacent symbols; NONE where the vocabulary has no such piece."""
        key = a * self.width + b
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.ranks[k], NONE), self.merged[k]

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final symbols of all words, with their first characters, and where each word begins."""
        sym, cp = self._symbols("".join(words))
        lengths = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), lengths)
        rank, product = self._pair(sym, np.r_[sym[1:], sym[:1]])
        rank[np.cumsum(lengths)[lengths > 0] - 1] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at := np.flatnonzero(rank != NONE)):
            owner = word[at]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat((rank[at] << 32) | at, first) & 0xFFFFFFFF
            sym[best] = product[best]
            keep = np.ones(len(sym), bool)
            keep[best + 1] = False
            ends = word[np.minimum(best + 2, len(word) - 1)] != word[best]
            ends |= best + 2 >= len(word)
            live = np.zeros(len(words), bool)
            live[owner] = True
            rest = ~live[word]
            if rest.any():  # words without a pair leave the rounds
                done.append((sym[rest], cp[rest], word[rest]))
                keep &= ~rest
            spot = (np.cumsum(keep) - 1)[best]
            sym, cp, word, rank, product = sym[keep], cp[keep], word[keep], rank[keep], product[keep]
            rank[spot] = NONE
            right = spot[~ends]
            left = spot[(spot > 0) & (word[spot - 1] == word[spot])] - 1
            fresh = np.concatenate((left, right))
            rank[fresh], product[fresh] = self._pair(sym[fresh], sym[fresh + 1])
        done.append((sym, cp, word))
        sym, cp, word = (np.concatenate(x) for x in zip(*done, strict=True))
        at = np.argsort(word, kind="stable")
        return sym[at], cp[at], np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def _ids(self, symbol: int, cp: int) -> list[int]:
        return [symbol] if symbol < self.size else [self.byte_ids[b] for b in chr(cp).encode()]

    def _linked_rounds(self, word: str) -> list[int]:
        """Merge rounds for one long word, whose symbols are linked instead of compacted.

        A round takes the places of the least rank and merges them all, from the left, up to the first whose product
        makes a pair that comes before the next place. The places of each rank wait until their round, so a round
        touches no others.
        """
        sym, cp = self._symbols(word)
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n + 1, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def wait(rank: int, at: np.ndarray) -> None:
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(order, rank)
            waiting[rank].append(at)

        def offer(at: np.ndarray) -> None:
            rank, _ = self._pair(sym[at], sym[after[at]])
            at, rank = at[rank != NONE], rank[rank != NONE]
            by = np.argsort(rank, kind="stable")
            cut = np.flatnonzero(np.r_[True, rank[by][1:] != rank[by][:-1], True][: len(by) + 1]) if len(by) else by
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                wait(int(rank[by[x]]), at[by[x:y]])

        offer(np.arange(n - 1))
        while order:
            r = heapq.heappop(order)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (after[at] < n)]
            rank, product = self._pair(sym[at], sym[after[at]])
            at, product = at[rank == r], product[rank == r]
            if not len(at):
                continue
            tied = np.r_[False, after[at[:-1]] == at[1:]]  # shares a symbol with the place before
            begin = np.maximum.accumulate(np.where(tied, 0, np.arange(len(at))))
            chosen = (np.arange(len(at)) - begin) % 2 == 0
            pick, made = at[chosen], product[chosen]
            right = after[after[pick]]
            left = before[pick]
            next_to = np.r_[False, right[:-1] == pick[1:]]
            left_sym = np.where(next_to, np.r_[made[:1], made[:-1]], sym[left])
            first_left = np.where(left >= 0, self._pair(left_sym, made)[0], NONE)
            first_right = np.where(right < n, self._pair(made, sym[np.minimum(right, n - 1)])[0], NONE)
            early = np.flatnonzero((first_left <= r) | (first_right <= r))
            if len(early) and early[0] + 1 < len(pick):
                end = early[0] + 1
                wait(r, at[at >= pick[end]])
                pick, made, right = pick[:end], made[:end], right[:end]
            sym[pick] = made
            alive[after[pick]] = False
            after[pick] = right
            inner = right < n
            before[right[inner]] = pick[inner]
            fresh = np.unique(np.concatenate((before[pick], pick)))
            fresh = fresh[fresh >= 0]
            offer(fresh[after[fresh] < n])
        left = np.flatnonzero(alive[:n])
        return [i for s, c in zip(sym[left].tolist(), cp[left].tolist(), strict=True) for i in self._ids(s, c)]

    def _pieces_of(self, word: str) -> list[str]:
        """Cuts of a long word where no piece holds both neighbours, so that no merge can cross."""
        cut = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.inside), len(word)]
        return [word[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        parts, owner, out = [], [], [[] for _ in words]
        for k, w in enumerate(words):
            for x in [w] if len(w) <= LONG_WORD else self._pieces_of(w):
                parts.append(x)
                owner.append(k)
        short = [k for k, x in enumerate(parts) if len(x) <= LONG_WORD]
        found: dict[int, list[int]] = {}
        if short:
            sym, cp, start = (x.tolist() for x in self._rounds([parts[k] for k in short]))
            if max(sym) < self.size:
                found = {k: sym[a:b] for k, a, b in zip(short, start, start[1:], strict=False)}
            else:
                found = {k: [i for j in range(a, b) for i in self._ids(sym[j], cp[j])] for k, a, b in zip(short, start, start[1:], strict=False)}
        for k, x in enumerate(parts):
            ids = found[k] if k in found else self._linked_rounds(x)
            out[owner[k]] = out[owner[k]] + ids if out[owner[k]] else ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids): bytes that are not UTF-8 become U+FFFD, the dummy prefix goes."""
        out: list[str] = []
        run = bytearray()
        first = True

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        if n == 4 or at + n >= len(run):
                            out.append("�")
                            at += 1
                            break
            run.clear()

        for i in ids:
            if (b := self.byte_value.get(i)) is not None:
                run.append(b)
                first = False
                continue
            if run:
                flush()
            if i == self.unk:
                out.append(" ⁇ ")
                first = False
            elif self.bytes_of[i]:
                s = self.bytes_of[i].decode()
                out.append(s[1:] if first and s[0] == " " else s)
                first = False
        flush()
        return "".join(out)

    def split(self, text: str) -> list[str]:
        return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: set[str]) -> None:
        """Encode the words that the cache lacks. When its half is full, the other half is forgotten."""
        for w in words - self.cache.keys():
            if w in self.old:
                self.cache[w] = self.old[w]
        new = list(words - self.cache.keys())
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            text, raw = self.id_text, self.raw_of
            for w, ids in zip(part, self.encode_words(part), strict=True):
                self.cache[w] = (",".join([text[i] for i in ids]), b"".join([raw[i] for i in ids]))

    def check(self, model: bytes) -> None:
        """Raise ValueError for a model whose ids would differ: it normalizes, or holds pieces that no merge makes."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        said = [b.decode("utf-8", "replace") for b in self.bytes_of if b]
        probes = ["", "a", " a  b ", "\ufb01 \uff21 \u0301e\u00a0x\u200b\t\r\n", "A a \u00c9", *said, *(f"x{p}x" for p in said)]
        mine = self.encode_words([w for p in probes for w in self.split(p)])
        at = 0
        for p, want in zip(probes, sp.encode(probes), strict=True):
            n = len(self.split(p))
            if [i for ids in mine[at : at + n] for i in ids] != want:
                raise ValueError(f"the model encodes {p!r} in a way that merge rounds over its vocabulary don't")
            at += n

    def forget(self) -> None:
        """Empty the caches: a worker that waits for other work holds no words."""
        self.cache, self.old = {}, {}

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_words(self.split(text)) for i in ids]

    def digest(self, texts_: list[str]) -> list[tuple[str, bytes]]:
        """For each text, its ids as decimals joined by commas and its decoded bytes."""
        split = [self.split(t) for t in texts_]
        out, k = [], 0
        while k < len(split):  # as many texts at a time as the cache can hold the words of
            end, words = k, set()
            while end < len(split) and (end == k or len(words) < CACHED_WORDS // 2):
                words.update(split[end])
                end += 1
            if len(self.cache) > CACHED_WORDS // 2:
                self.old, self.cache = self.cache, {}
            self.learn(words)
            get = self.cache.__getitem__
            for ws in split[k:end]:
                found = [get(w) for w in ws]
                out.append((",".join([x[0] for x in found]), b"".join([x[1] for x in found])[1:]))
            k = end
        return out


_CODECS: dict[bytes, PieceCodec] = {}
#: Models that check() has passed.
_CHECKED: set[bytes] = set()


def codec(model: bytes) -> PieceCodec:
    """One codec for each Python worker and model."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def slices(batch: pa.RecordBatch, column: str, chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch whose texts have about so many characters, one text at least."""
    lengths = [n or 0 for n in pa.compute.utf8_length(batch.column(column)).to_pylist()]
    start = total = 0
    for k, n in enumerate(lengths):
        if total and total + n > chars:
            yield (part := batch.slice(start, k - start)), [t or "" for t in part.column(column).to_pylist()]
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield (part := batch.slice(start)), [t or "" for t in part.column(column).to_pylist()]


DIGEST_FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver and shipped with the tasks (half a megabyte)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id with the token count and digests of the ids and the decoded text; with ids=True also the ids.

    Null and empty texts have no tokens; their digests are those of the empty string. Rows are kept
    one to one, repeated rows and null doc_ids included; long texts are encoded whole; other columns are left behind.
    """
    blob = model_bytes(model)
    if (digest := hashlib.sha256(blob).digest()) not in _CHECKED:
        codec(blob).check(blob)
        _CHECKED.add(digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(blob)
        gc.disable()  # millions of cached strings and no cycles: collections would only walk them
        try:
            yield from encoded(c, batches)
        finally:
            c.forget()
            gc.enable()

    def encoded(c: PieceCodec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ts in slices(batch, "text", 2_000_000):
                rows = c.digest(ts)
                columns = [
                    part.column("doc_id"),
                    pa.array([s.count(",") + 1 if s else 0 for s, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for s, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(b).hexdigest() for _, b in rows], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([[int(x) for x in s.split(",")] if s else [] for s, _ in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    docs = widen(texts(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {DIGEST_FIELDS}" + ", ids array<int>" * ids)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens' number and digests, as encode_decode defines them."""
    return encode_decode(documents(spark, sf_dir))
