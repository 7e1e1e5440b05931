"""Small frames with every awkward case, and brute-force versions."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997}x{i % 89}." + ("\n" if i % 23 == 0 else "") for i in range(20_000))

# doc_id, text, lang, source, n_chars, and columns whose names could clash with an operator's own
EDGE_ROWS = [
    (1, None, "en", "a", None, 1, "k", 2.0),
    (2, "", None, None, 0, 1, "k", 2.0),
    (3, " \t\n ", "de", "b", 4, None, None, None),
    (4, "one two", "en", "a", 7, 1, "k", 2.0),
    (4, "one two", "en", "a", 7, 1, "k", 2.0),
    (5, "one two", "en", "c", 7, 1, "k", 2.0),
    (None, "a document without an id but with words", "en", None, None, 1, "k", 2.0),
    (6, LONG, "fr", "a", len(LONG), 1, "k", 2.0),
    (7, "Ünï çödé ✓ 日本語 text\nwith lines\nwith lines", "fr", "b", 1, 1, "k", 2.0),
    (8, "12345 67890 !!! ###", "en", "b", 1, 1, "k", 2.0),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, n_removed double"


def edge_docs(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


def docs(spark, texts, **columns):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def shingle_bag(text):
    w = WORD.findall(text or "")
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def similarity(a, b):
    joint = sum((a | b).values())
    return sum((a & b).values()) / joint if joint else 0.0


def classes(ids, links):
    """id -> smallest id joined to it."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}
