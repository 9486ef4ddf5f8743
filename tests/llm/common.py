"""Fixtures of the training-data operators' tests."""

from __future__ import annotations

import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """Rows of (doc_id, text[, lang]); three more columns clash with names that operators make."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def odd_rows():
    """Nulls, empties, ties, repeats and a long text."""
    long = " ".join(f"w{i * 7919 % 104729}" for i in range(60_000))
    base = " ".join(f"a{i}" for i in range(80))
    return [(1, None), (2, ""), (3, " \n\t "), (4, base), (4, base), (5, base), (None, base), (None, None), (6, long), (7, "one two"), (8, "ONE two"), (9, "1234 !!! $$$"), (10, base + "  tail\u001c x"), (11, "é" * 300), (12, "A\n\nA\n A\nb")]


def multiset(rows):
    return Counter(tuple(r) for r in rows)
