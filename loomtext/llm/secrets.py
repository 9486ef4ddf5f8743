"""8. Secret scans: a trigram inverted index in front of regex rules.

From each rule's parsed regex a Boolean query over trigrams is derived: every match must hold them.
Blocks of texts are indexed (postings of those trigrams that any query names, over lower-cased ASCII),
queries intersect and unite postings, and candidates are verified by the regex on their whole text.
A rule without mandatory trigrams scans every text. Blocks are bounded, so the index of a block lives
in one task and is never shuffled.

Spans are of whole matches, in code points, end exclusive. Base rules: `assign`, `access`, `hex`; the
method adds the rest of RULES.

Defined cases: null text counts as empty and has no spans. Repeated rows are scanned one by one. Very
long texts are scanned whole. An empty table gives an empty result; other columns are ignored by
`scan` and kept by `redact`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomtext.llm.frames import column, slices
from loomtext.llm.memory import claim
from loomtext.runtime import ship_package

#: Bytes of text in a block of the index, about.
BLOCK = 4 << 20
#: Sets of strings larger than this are given up for their trigrams.
MOST_STRINGS = 32

ALL = ("all",)


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """keep: which matches of the pattern count."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] | None = None


_KEY_WORDS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
BASE = (
    Rule("assign", rf"""({_KEY_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: m.end(2) - m.start(2) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs are maximal: the same spans as [0-9a-f]+ of 16 or more
)
_BREAK = r"(?:\s|\\[nr])"  # line ends may be escaped, as in JSON
#: To the matching END line; where that is missing, to the end of the header and base64 lines.
_PRIVATE_KEY = (
    r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----"
    r"(?:(?:[^-]++|-(?!----(?:BEGIN |END \1PRIVATE KEY-----)))*+-----END \1PRIVATE KEY-----"
    rf"|(?:{_BREAK}++[A-Z][A-Za-z0-9-]*+:\x20[^\n\\]*+)*+(?:{_BREAK}++[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:{_BREAK}++[A-Za-z0-9+/]++={{0,2}}(?=[\x20\t\r]*(?:\n|\\[nr]|[\"']|\Z)))?)"
)
ADDED = (
    Rule("private_key", _PRIVATE_KEY),
    Rule("code_host", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_api", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"(?:sk|rk)_live_[0-9a-zA-Z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]{2,10}://[^\s:/@]*+:[^\s:/@]{3,}+@"),
)
RULES = BASE + ADDED


def _and(*parts):
    flat = [q for p in parts if p != ALL for q in (p[1:] if p[0] == "and" else (p,))]
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", *dict.fromkeys(flat))


def _or(*parts):
    return ALL if ALL in parts or not parts else parts[0] if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def _holds(strings) -> tuple:
    """The query that one of the strings is in the text."""
    return _or(*[_and(*[("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def query(pattern: str) -> tuple:
    """('all',), ('tri', t), ('and', ...) or ('or', ...): what any text with a match must hold."""
    return _sequence(P.parse(pattern))[1]


def _low(code: int) -> str | None:
    c = chr(code)
    return c.lower() if c.isascii() else None


def _item(op, arg) -> tuple[set[str] | None, tuple]:
    """(the few strings it can match, lower-cased, or None; its query)."""
    if op is C.LITERAL:
        c = _low(arg)
        return ({c} if c else None), ALL
    if op is C.IN:
        chars = set()
        for kind, value in arg:
            codes = [value] if kind is C.LITERAL else range(value[0], value[1] + 1) if kind is C.RANGE and value[1] - value[0] < 64 else None
            if codes is None:
                return None, ALL
            chars |= {_low(c) for c in codes}
        return (chars if None not in chars and len(chars) <= 4 else None), ALL
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        got = [_sequence(x) for x in arg[1]]
        exact = set().union(*[e for e, _ in got]) if all(e is not None for e, _ in got) else None
        return (exact if exact is not None and len(exact) <= MOST_STRINGS else None), _or(*[q for _, q in got])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = arg
        exact, q = _sequence(inner)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, ALL
        if least == most == 1:
            return exact, q
        return None, q if least else ALL
    if op is C.AT:
        return {""}, ALL
    return None, ALL


def _sequence(items) -> tuple[set[str] | None, tuple]:
    """Strings of a run of exact items are joined; where one is not exact, the run's trigrams are due."""
    runs, now, whole, due = [], {""}, True, []
    for op, arg in items:
        exact, q = _item(op, arg)
        due.append(q)
        if exact is not None and len(now) * len(exact) <= MOST_STRINGS:
            now = {a + b for a in now for b in exact}
            continue
        whole = False
        runs.append(now)
        now = exact if exact is not None else {""}
    runs.append(now)
    q = _and(*due, *[_holds(r) for r in runs])
    return (now if whole else None), q


def trigrams(q: tuple) -> set[str]:
    return {q[1]} if q[0] == "tri" else {t for x in q[1:] for t in trigrams(x)} if q[0] in ("and", "or") else set()


class Index:
    """Postings of a block of texts, for the trigrams that some query names."""

    def __init__(self, texts: list[str], numbers: dict[str, int]):
        self.n = len(texts)
        self.numbers = numbers
        raw = [t.encode("utf-8", "replace").lower() for t in texts]  # bytes.lower(): ASCII only
        data = np.frombuffer(b"\n".join(raw) + b"\n\n\n", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        code = (data[:-2].astype(np.int32) << 16) | (data[1:-1].astype(np.int32) << 8) | data[2:]
        which = _lookup(tuple(numbers))[code]
        at = np.flatnonzero(which)
        keys = np.unique((which[at].astype(np.int64) - 1) * self.n + np.searchsorted(ends, at, side="right").clip(max=self.n - 1))
        self.postings = np.split(keys % self.n, np.searchsorted(keys // self.n, np.arange(1, len(numbers)))) if numbers else []

    def find(self, q: tuple) -> np.ndarray:
        """Sorted numbers of the texts that satisfy the query."""
        if q == ALL:
            return np.arange(self.n)
        if q[0] == "tri":
            return self.postings[self.numbers[q[1]]]
        parts = [self.find(x) for x in q[1:]]
        if q[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        got = parts[0]
        for p in parts[1:]:
            got = np.intersect1d(got, p, assume_unique=True)
        return got


@cache
def _lookup(names: tuple[str, ...]) -> np.ndarray:
    """trigram code -> its number from 1, 0: none."""
    table = np.zeros(1 << 24, np.uint8 if len(names) < 255 else np.uint16)
    for i, t in enumerate(names):
        a, b, c = t.encode()
        table[(a << 16) | (b << 8) | c] = i + 1
    return table


@cache
def _compiled(rules: tuple[Rule, ...]):
    queries = [query(r.pattern) for r in rules]
    names = sorted(set().union(*map(trigrams, queries)))
    return [re.compile(r.pattern) for r in rules], queries, {t: i for i, t in enumerate(names)}


def find_all(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text's spans, by start, then by the rules' order."""
    regexes, queries, numbers = _compiled(rules)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= BLOCK):
            size += len(texts[hi] or "")
            hi += 1
        block = [t or "" for t in texts[lo:hi]]
        index = Index(block, numbers)
        for no, (rule, regex, q) in enumerate(zip(rules, regexes, queries, strict=True)):
            for i in index.find(q).tolist():
                out[lo + i] += [(m.start(), no, m.end()) for m in regex.finditer(block[i]) if rule.keep is None or rule.keep(m)]
        lo = hi
    return [[(a, b, rules[no].kind) for a, no, b in sorted(x)] for x in out]


def scan(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, spans array<struct<start, end, kind>> of each row's whole text; rules: RULES if None."""
    ship_package(docs.sparkSession)

    def run(batches):
        claim("secrets")
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for part in slices(batches):
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in find_all(column(part, "text"), rules or RULES)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    span = T.StructType().add("start", "long").add("end", "long").add("kind", "string")
    schema = docs.select("doc_id").schema.add("spans", T.ArrayType(span))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span (overlapping ones together) replaced by `[kind]`."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with secrets in text masked and n_chars, if there, counted anew."""
    ship_package(docs.sparkSession)

    def run(batches):
        claim("secrets")
        for part in slices(batches):
            texts = column(part, "text")
            found = find_all(texts)
            clean = [mask(t, x) for t, x in zip(texts, found, strict=True)]
            arrays = list(part.columns)
            at = part.schema.get_field_index("text")
            arrays[at] = pa.array(clean, part.schema.field(at).type)
            n = part.schema.get_field_index("n_chars")
            if n >= 0:
                was = column(part, "n_chars")
                arrays[n] = pa.array([len(c) if x else w for c, x, w in zip(clean, found, was, strict=True)]).cast(part.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
