"""License scanning: Aho-Corasick over normalised words, shunting-yard over license expressions.

A text becomes its lower-cased words joined by single spaces; one automaton finds all phrases, each wrapped in
spaces so that matches keep to word borders. Where the identifier tag occurs, its expression is read from
the original text and evaluated with AND, OR and WITH.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, texts

#: Base phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: More phrases, their labels and how sure each makes us.
NOTICES = {
    "mit license": ("mit", 0.9),
    "apache license": ("apache", 0.9),
    "apache license version 2 0": ("apache-2.0", 0.95),
    "bsd license": ("bsd", 0.8),
    "mozilla public license": ("mpl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.8),
    "public domain": ("public-domain", 0.5),
    "licensed under": ("notice", 0.4),
    "released under": ("notice", 0.4),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
}
BASE_SURE = {"cc-by": 0.8, "gpl": 0.9, "reserved": 0.6}
TAG = "spdx license identifier"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.:-]+\+?")
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}
# Families of licence identifiers, in lower case.
_PERMISSIVE = re.compile(r"(mit|apache|bsd|isc|zlib|unlicense|cc0|cc-by-[0-9]|0bsd|boost|bsl-1|python|postgresql)")
_KNOWN = re.compile(_PERMISSIVE.pattern + "|a?l?gpl|mpl|epl|eupl|cddl|cc-by|ofl|artistic|odbl")
#: How sure an identifier of no known family makes us.
UNKNOWN_SURE = 0.7


def normalise(text: str) -> bytes:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased, joined by one space."""
    return b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split())


def postfix(expression: str) -> list[str]:
    """Shunting-yard. What follows a complete expression is left alone; an unbalanced or broken one gives []."""
    out: list[str] = []
    ops: list[str] = []
    operand_next = True
    for t in _TOKEN.findall(expression):
        up = t.upper()
        if t == "(":
            if not operand_next:
                break
            ops.append(t)
        elif t == ")":
            if operand_next or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif up in _BINDS:
            if operand_next:
                return []
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[up]:
                out.append(ops.pop())
            ops.append(up)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(t)
            operand_next = False
    if operand_next or "(" in ops:
        return []
    return out + ops[::-1]


def evaluate(rpn: list[str], leaf: Callable, either: Callable, both: Callable, exception: Callable):
    """The value of a postfix expression: leaf(name), and what OR, AND and WITH make of two values."""
    stack, make = [], {"OR": either, "AND": both, "WITH": exception}
    for t in rpn:
        if t in _BINDS:
            b = stack.pop()
            stack[-1] = make[t](stack[-1], b)
        else:
            stack.append(leaf(t.lower()))
    return stack[0] if stack else None


def choices(expression: str) -> Iterator[frozenset[str]]:
    """The sets of licences that each satisfy the expression, one after another: OR gives a choice, AND joins, WITH adds
    an exception. There may be exponentially many; none is made before it is asked for."""
    either = lambda a, b: lambda: itertools.chain(a(), b())
    both = lambda a, b: lambda: (p | q for p in a() for q in b())
    exception = lambda a, b: lambda: (frozenset(f"{x} with {y}" for x in sorted(p) for y in sorted(q)) for p in a() for q in b())
    made = evaluate(postfix(expression), lambda x: lambda: iter((frozenset((x,)),)), either, both, exception)
    return made() if made else iter(())


def licences(rpn: list[str]) -> frozenset[str]:
    """All licences named, whether one must or may follow them; an exception stands with its licence."""
    join = lambda a, b: a | b
    return evaluate(rpn, lambda x: frozenset((x,)), join, join, lambda a, b: frozenset(f"{x} with {y}" for x in a for y in b)) or frozenset()


def certainty(rpn: list[str]) -> float:
    """How sure the expression makes us: it is as sure as the best of its alternatives, of which the weakest part counts."""
    return evaluate(rpn, lambda x: 1.0 if _KNOWN.match(x) else UNKNOWN_SURE, max, min, lambda a, b: a) or 0.0


def permissive(rpn: list[str]) -> bool | None:
    """Whether one may choose permissive licences alone."""
    return evaluate(rpn, lambda x: bool(_PERMISSIVE.match(x)), lambda a, b: a or b, lambda a, b: a and b, lambda a, b: a)


class LicenseScanner:
    def __init__(self):
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for p, label in BASE.items():
            found.setdefault(p, []).append((label, BASE_SURE[label], True))
        for p, (label, sure) in NOTICES.items():
            found.setdefault(p, []).append((label, sure, False))
        found.setdefault(TAG, []).append(("", 0.0, False))
        for p, what in found.items():
            self.phrases.add_word(f" {p} ", (len(p) + 1, what))
        self.phrases.make_automaton()

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, expression, permissive."""
        body = normalise(text)
        spaced = f" {body.decode('latin-1')} "
        places: list[int] = []
        base, labels, doubt, tagged = set(), set(), 1.0, False
        for end, (back, what) in self.phrases.iter(spaced):
            for label, sure, of_base in what:
                if of_base:
                    places.append(end - back)
                    base.add(label)
                if label and label not in labels:
                    labels.add(label)
                    doubt *= 1 - sure
                tagged |= not label
        expression = free = None
        if tagged:
            for m in _EXPRESSION.finditer(text):
                if rpn := postfix(m[1]):
                    expression = " ".join(rpn)
                    labels.update(x.replace(",", "") for x in licences(rpn))
                    doubt *= 1 - certainty(rpn)
                    free = permissive(rpn) if free is None else free and permissive(rpn)  # all tags hold
        first = last = None
        if places:
            first, last = (spaced.count(" ", 1, p + 1) for p in (min(places), max(places)))
        words = body.count(b" ") + 1 if body else 0
        return words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - doubt, expression, free


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, permissive boolean"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id with what was found. Null and empty texts have no words, no labels and a score of 0.

    Rows are kept one to one (repeated rows and null ids too); long texts are scanned whole; other columns are left behind.
    An identifier tag's expression decides its labels (all licences named), how much it adds to the score, and permissive
    (whether one may choose permissive licences alone; null without an expression). expression is the last, in postfix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner()
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            rows = [scanner.scan(t.as_py() or "") for t in column]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))])

    docs = texts(docs)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its labels, as scan_licenses defines them."""
    return scan_licenses(documents(spark, sf_dir))
