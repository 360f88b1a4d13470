"""Small texts with the cases that every operator must stand."""

import random

HARD = [None, "", " ", "\n\n", "word", "a b", "Same text twice, same text twice.", "Same text twice, same text twice.", "日本語 🙂 é́ ▁ x", "x" * 5000, "\x00\x01 tab\tend\x0b\x0c", "É ß ÀA zZ"]


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


def frame(spark, texts, ids=None, **more):
    """documents with clashing extra columns."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", 1, "x", 2, True) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, blob string, n_words long, kept boolean")
