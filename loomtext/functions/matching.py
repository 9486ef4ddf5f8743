"""Vectorised string UDFs without a built-in: Jaro-Winkler, Porter2 stems, phrase matching.

They work on names and distinct words, never on whole documents.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.runtime import ship_package


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2  # whole transpositions only
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@lru_cache(maxsize=100_000)
def jaro_winkler_of(a: str, b: str) -> float:
    base = jaro(a, b)
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return base + prefix * 0.1 * (1 - base) if base > 0.7 else base


def similar_pairs(names: list[str], others: list[str], threshold: float) -> list[tuple[str, str, float]]:
    """(name, other, similarity) of different names whose lower-cased forms are similar by `threshold` or more.

    The letters that two names have in common, whatever their order, and the length of their common prefix
    bound the similarity; what the bound lets through is compared.
    """
    if not names or not others:
        return []
    low, near = [x.lower() for x in names], [x.lower() for x in others]
    letters = {c: i for i, c in enumerate(sorted(set("".join(low)) | set("".join(near))))}

    def counted(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts, starts = np.zeros((len(letters), len(words)), np.int32), np.full((4, len(words)), -1, np.int64)
        for i, w in enumerate(words):
            for c in w:
                counts[letters[c], i] += 1
            for j, c in enumerate(w[:4]):
                starts[j, i] = letters[c]
        return counts, starts, np.array([max(1, len(w)) for w in words], np.float64)

    (x, xs, nx), (y, ys, ny) = counted(low), counted(near)
    shared = sum(np.minimum.outer(a, b) for a, b in zip(x, y, strict=True)) if letters else np.zeros((len(low), len(near)), np.int32)
    same = (xs[:, :, None] == ys[:, None, :]) & (xs[:, :, None] >= 0)
    prefix = np.cumprod(same, axis=0).sum(axis=0)
    most = np.where(shared > 0, (shared / nx[:, None] + shared / ny[None, :] + 1) / 3, 0.0)
    most = np.where(most > 0.7, most + prefix * 0.1 * (1 - most), most)
    out = []
    for i, j in zip(*(v.tolist() for v in np.nonzero(most >= threshold - 1e-9)), strict=True):
        if names[i] != others[j] and (s := jaro_winkler_of(low[i], near[j])) >= threshold:
            out.append((names[i], others[j], s))
    return out


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity 0..1, with the usual prefix bonus above 0.7; null if either is null."""
    ship_package(SparkSession.active())
    return _jaro_winkler(a, b)


VOWELS = "aeiouy"
NOT_STEMMED = frozenset("api db uri url dao dto orm id io ok".split())
#: Porter2's words with a stem of their own, and those left as they are.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS and w[-1] not in "wxY"


@lru_cache(maxsize=200_000)
def stem_of(word: str, least: int = 3) -> str:
    """The Porter2 (English) stem of a lower-cased word."""
    w = word.lower()
    if len(w) < least or w in NOT_STEMMED:
        return w
    if len(w) <= 2 or w in _KEPT:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT_LATER:
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(end):
            continue
        at = len(w) - len(end)
        if end in ("eed", "eedly"):
            if at >= r1:
                w = w[:at] + "ee"
        elif any(c in VOWELS for c in w[:at]):
            w = w[:at]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, to in _STEP2 + (("ogi", "og"), ("li", "")):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and not (end == "ogi" and w[at - 1] != "l") and not (end == "li" and w[at - 1] not in "cdeghkmnrt"):
                w = w[:at] + to
            break
    for end, to in _STEP3 + (("ative", ""),):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and not (end == "ative" and at < r2):
                w = w[:at] + to
            break
    for end in sorted(_STEP4 + ("ion",), key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and not (end == "ion" and w[at - 1] not in "st"):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:at])):
            w = w[:at]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem_of(w))


def stem(word: Column) -> Column:
    ship_package(SparkSession.active())
    return _stem(word)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem_of(w) for w in ws if len(w) >= 3])


def stems(words: Column) -> Column:
    """The stems of an array's words of three letters or more."""
    ship_package(SparkSession.active())
    return _stems(words)


def is_abbreviation(short: str, long: str, table: dict[str, list[str]]) -> bool:
    """By the table in either direction, or a prefix of three letters or more."""
    return any(long.startswith(x) for x in table.get(short, ())) or any(short.startswith(x) for x in table.get(long, ())) or (len(short) >= 3 and len(long) > len(short) and long.startswith(short))


def phrase_score(query: list[str], target: list[str], table: dict[str, list[str]], synonyms: list[set[str]], fuzzy: float = 0.8) -> float:
    """Words are paired in six passes, each target word once: exact 1.0, substring .95, fuzzy (its
    similarity), abbreviation .85, stem .80, synonym .82. 85 % of their mean, plus .05 if in order, .02 if
    all are paired and .03 for each word after the first if in order."""
    if not query or not target:
        return 0.0

    def near(a: str, b: str) -> float:
        s = jaro_winkler_of(a, b)
        return s if s >= fuzzy else 0.0

    tests = (
        lambda a, b: 1.0 * (a == b),
        lambda a, b: 0.95 * (a in b or b in a),
        near,
        lambda a, b: 0.85 * is_abbreviation(a, b, table),
        lambda a, b: 0.80 * (stem_of(a) == stem_of(b)),
        lambda a, b: 0.82 * any(a in s and b in s for s in synonyms),
    )
    paired: dict[int, tuple[int, float]] = {}
    taken: set[int] = set()
    for test in tests:
        for i, a in enumerate(query):
            if i in paired:
                continue
            for j, b in enumerate(target):
                if j not in taken and (got := test(a, b)) > 0:
                    paired[i] = (j, got)
                    taken.add(j)
                    break
    if not paired:
        return 0.0
    mean = sum(s for _, s in paired.values()) / len(query)
    order = [paired[i][0] for i in sorted(paired)]
    ordered = len(order) > 1 and all(x < y for x, y in zip(order, order[1:], strict=False))
    score = 0.85 * mean + (0.05 + 0.03 * (len(order) - 1)) * ordered + 0.02 * (len(paired) == len(query))
    return max(0.0, min(1.0, score))


def phrase_matcher(query: list[str], table: dict[str, list[str]], domains: dict[str, list[str]]):
    """A UDF column function: words of a name -> its phrase score against the query's words."""
    ship_package(SparkSession.active())
    synonyms = [set(v) for v in domains.values()]

    @F.pandas_udf(T.DoubleType())
    def score(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: None if ws is None else round(phrase_score(query, list(ws), table, synonyms), 6))

    return score
