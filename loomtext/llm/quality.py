"""2. Quality rules: tokeniser fertility.

Public vocabularies measure each whole text word by word: characters per token of either vocabulary, the
share of tokens that are byte fallbacks, and the entropy of the text's tokens (over the entropy that as many
distinct tokens would have). A text is kept if the base rules hold and each measure lies in its band: the
fitted one of the row's language, else the fitted one of the text's script, else a fixed wide one.

`fit` learns the bands from all texts that labels call good: for each language and script with `least` such
texts a line of each measure over log2 of the number of tokens, and the spread around it. `judge` and
`keep_judged` measure each text once, write the measures (no texts), and fit and judge from them. Limits lie
`deviations` spreads away; the spread is taken no smaller than `floor` of the line's value, and grows by sqrt(1 + typical / tokens), so that it widens steadily for short texts. A script's
band serves languages that were never fitted, so its limits lie `other_deviations` spreads away. Latin text of any
length needs `LATIN_FLOOR` characters a token, which most words of random letters don't have.

Base rules (words are `[^\\x20\\x09-\\x0D]+`): fewer than 10 words fails; so do texts in which more
than 20 % of the words lie in 5-word windows that occur twice or more in the text.

Defined cases: null or empty text has no words, zero counts and fails the base rules; its measures
are null. Null or unknown `lang` takes the script's band. Repeated rows are judged one by one. Very
long texts are measured whole, in pieces of bounded size. Without labels nothing is fitted. An empty table
gives an empty result; doc_id may be of any type that joins; other columns are ignored by `measure` and `judge`
and kept by `keep_good` and `keep_judged`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import words as W
from loomtext.llm.frames import column, slices
from loomtext.llm.memory import claim
from loomtext.llm.vocabularies import WordTable, word_table
from loomtext.runtime import Scratch, ship_package

#: Words whose ids are looked at at once.
BLOCK = 500_000
SPACES = "\t\n\v\f\r "
SYMBOLS = "#*$%&|<>"
#: Scripts by code point ranges (whole blocks of 16), for bands; letters elsewhere are `other`.
SCRIPTS = (("latin", 0x40, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


@dataclass(frozen=True)
class Line:
    """A measure's usual value, intercept + slope * log2(tokens), and its spread in texts of `typical` tokens
    and more (times the square root of 2 at `typical`)."""

    intercept: float
    slope: float = 0.0
    spread: float = 0.0
    typical: float = 0.0

    def usual(self, tokens: int) -> float:
        return self.intercept + self.slope * math.log2(max(tokens, 2))

    def around(self, tokens: int, deviations: float, floor: float) -> tuple[float, float]:
        usual = self.usual(tokens)
        off = deviations * max(self.spread, floor * abs(usual)) * math.sqrt(1 + self.typical / max(tokens, 1))
        return usual - off, usual + off


RATIOS = ("chars_per_token", "chars_per_piece", "byte_share", "entropy")
#: A band: the line of each of RATIOS.
Band = dict[str, Line]
#: Closed limits where nothing is fitted, wide enough for any script: those that the vocabularies spell in
#: bytes have few characters a token and many fallbacks.
WIDE = {"chars_per_token": (0.2, 12.0), "chars_per_piece": (0.2, 12.0), "byte_share": (0.0, 1.0), "entropy": (0.2, 1.0)}
#: Words of random letters have about 1.5 characters a token, so Latin text of any length has at least this many
#: (or this share of its language's usual number, if that is less), and at least that share of the usual number.
LATIN_FLOOR, FLOOR_SHARE, LEAST_SHARE = 1.6, 0.92, 0.75
#: For Latin text where nothing is fitted.
WIDE_LATIN = WIDE | {"chars_per_token": (LATIN_FLOOR, 12.0), "chars_per_piece": (1.6, 12.0), "byte_share": (0.0, 0.1)}


@dataclass(frozen=True)
class Params:
    byte_vocabulary: str = "byte_bpe_50k.tiktoken"
    piece_vocabulary: str = "piece_bpe_32k.model"
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    least: int = 30
    deviations: float = 3.0
    other_deviations: float = 4.5
    floor: float = 0.02
    broadcast_rows: int = 500_000  # at most this many keys of rejected rows are broadcast; more are joined by shuffle
    by_lang: dict[str, Band] = field(default_factory=dict)
    by_script: dict[str, Band] = field(default_factory=dict)

    def limits(self, lang: str | None, script: str, tokens: int) -> dict[str, tuple[float, float]]:
        own = self.by_lang.get(lang)
        band = own or self.by_script.get(script)
        if not band:
            return WIDE_LATIN if script == "latin" else WIDE
        got = {name: line.around(tokens, self.deviations if own else self.other_deviations, self.floor) for name, line in band.items()}
        if script == "latin":
            low, high = got["chars_per_token"]
            usual = band["chars_per_token"].usual(tokens)
            got["chars_per_token"] = max(low, min(LATIN_FLOOR, FLOOR_SHARE * usual), LEAST_SHARE * usual), high
        # few fallbacks are never wrong, nor is a text wrong for repeating no token
        return got | {"byte_share": (0.0, max(0.02, got["byte_share"][1])), "entropy": (got["entropy"][0], 1.0)}


MEASURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField("script", T.StringType()), T.StructField("n_tokens", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in RATIOS]
    + [T.StructField("reason", T.StringType())]
)


def repeat_words(h: np.ndarray, k: int) -> int:
    """Words that lie in a k-word window found twice or more."""
    if len(h) < k + 1:
        return 0
    w = W.fast_windows(h, k)
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script with the most letters; none: `other`."""
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else "other"
    counts: Counter = Counter()
    for lo in range(0, len(text), 1_000_000):
        points = np.frombuffer(text[lo : lo + 1_000_000].encode("utf-32-le", "replace"), np.uint32)
        by16 = np.bincount(points >> 4, minlength=0xD7B0 >> 4)
        for name, a, b in SCRIPTS:
            counts[name] += int(by16[a >> 4 : (b >> 4) + 1].sum())
    best = max(SCRIPTS, key=lambda x: counts[x[0]])[0]
    return best if counts[best] else "other"


def fertility(table: WordTable, rows: np.ndarray, chars: int) -> tuple[float, float, float, float, int]:
    """(characters per token, per piece, byte share, entropy over its most, tokens) of some words."""
    counts = np.zeros(0, np.int64)
    if len(rows) <= BLOCK:
        ids = np.sort(table.ids_of(rows))
        n = len(ids)
        counts = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))) if n else counts
    else:
        n = 0
        for lo in range(0, len(rows), BLOCK):
            some = np.bincount(table.ids_of(rows[lo : lo + BLOCK]))
            counts = np.pad(counts, (0, max(0, len(some) - len(counts))))
            counts[: len(some)] += some
        n, counts = int(counts.sum()), counts[counts > 0]
    p = counts / max(n, 1)
    entropy = float(-(p * np.log2(p)).sum()) / float(np.log2(n)) if n > 1 else 1.0
    m = int(table.n_pieces[rows].sum())
    return chars / max(n, 1), chars / max(m, 1), int(table.n_fallback[rows].sum()) / max(m, 1), min(entropy, 1.0), n


def judge_all(texts: list[str | None], langs: list[str | None], params: Params) -> list[dict]:
    """The measures and verdict of each whole text."""
    table = word_table(params.byte_vocabulary, params.piece_vocabulary)
    table.forget()
    rows = []
    for text in texts:
        got = [table.rows(block) for block in W.blocks((text or "").encode("utf-8", "replace"))]
        rows.append(got[0] if len(got) == 1 else np.concatenate(got))
        if len(table._new) > 50_000:
            table.learn()
    table.learn()
    return [_judge(text or "", lang, r, table, params) for text, lang, r in zip(texts, langs, rows, strict=True)]


def _judge(text: str, lang: str | None, rows: np.ndarray, table: WordTable, params: Params) -> dict:
    n = len(rows)
    out = {"n_words": n, "word_chars": len(text) - sum(map(text.count, SPACES)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup_lines(text), "n_repeat_words": repeat_words(table.hash[rows], params.window)}
    out["base_failed"] = n < params.min_words or 100 * out["n_repeat_words"] > params.max_repeat_percent * n
    if not n:
        out |= {"script": "other", "n_tokens": 0} | dict.fromkeys(RATIOS)
        return out | _verdict(out, lang, params)
    script = script_of(text)
    *ratios, tokens = fertility(table, rows, out["word_chars"])
    out |= {"script": script, "n_tokens": tokens} | {name: round(value, 6) for name, value in zip(RATIOS, ratios, strict=True)}
    return out | _verdict(out, lang, params)


def _verdict(got: dict, lang: str | None, params: Params) -> dict:
    """kept and reason of a text's measures."""
    failed = ["base"] * (got["base_failed"] or not got["n_words"])
    if got["n_words"]:
        limits = params.limits(lang, got["script"], got["n_tokens"])
        failed += [x for x in RATIOS if not limits[x][0] <= got[x] <= limits[x][1]]
    return {"kept": not failed, "reason": ",".join(failed)}


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id").distinct()


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Params:
    """The parameters with bands fitted on all good texts: rows (doc_id, quality) of 1 in `labels`."""
    scratch = Scratch(docs.sparkSession, "quality-fit")
    try:
        return _fit(scratch.write(measure(docs.join(_good(labels), "doc_id", "left_semi"), params, "lang"), "measures"), params)
    finally:
        scratch.keep()


def _fit(rows: DataFrame, params: Params) -> Params:
    """Bands from the measures and lang of good texts; a row for each language and script comes to the driver."""
    of = lambda name: F.struct(F.lit(name).alias("of"), F.col(name).alias("name"))
    rows = rows.where("not base_failed").withColumn("x", F.log2(F.greatest("n_tokens", F.lit(2))))
    rows = rows.select("n_tokens", "x", *RATIOS, F.explode(F.array(of("lang"), of("script"))).alias("of")).where("of.name is not null")
    sums = [F.struct(F.avg(y), F.avg("x"), F.regr_syy(y, "x"), F.regr_sxy(y, "x"), F.regr_sxx(y, "x")).alias(y) for y in RATIOS]
    fitted: dict[str, dict[str, Band]] = {"lang": {}, "script": {}}
    for r in rows.groupBy("of.of", "of.name").agg(F.count("*").alias("n"), F.avg("n_tokens").alias("typical"), *sums).where(F.col("n") >= params.least).collect():
        fitted[r["of"]][r["name"]] = {y: _line(*r[y], r["n"], r["typical"]) for y in RATIOS}
    return replace(params, by_lang=fitted["lang"], by_script=fitted["script"])


def _line(mean: float, mean_x: float, syy: float, sxy: float, sxx: float, n: int, typical: float) -> Line:
    if sxx <= 1e-9 * n:  # all texts equally long: the mean, level
        return Line(mean, 0.0, math.sqrt(max(syy, 0.0) / max(n - 1, 1)), typical)
    slope = sxy / sxx
    return Line(mean - slope * mean_x, slope, math.sqrt(max(syy - sxy * slope, 0.0) / max(n - 2, 1)), typical)


def _judged(part: pa.RecordBatch, params: Params) -> list[dict]:
    return judge_all(column(part, "text"), column(part, "lang"), params)


def measure(docs: DataFrame, params: Params = Params(), *keep: str) -> DataFrame:
    """doc_id, kept columns, and every measure and verdict of each row's whole text."""
    ship_package(docs.sparkSession)
    names = ["doc_id", *keep]
    schema = T.StructType([*docs.select(*names).schema, *MEASURES.fields])
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}

    def run(batches):
        claim("quality words", word_table.cache_clear)
        for part in slices(batches):
            rows = _judged(part, params)
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in names], *[pa.array([r[f.name] for r in rows], kinds[f.dataType.simpleString()]) for f in MEASURES]], names=schema.names)

    return docs.select(*dict.fromkeys([*names, "text", "lang"])).mapInArrow(run, schema)


def keep_good(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows whose text is kept, with all their columns; no shuffle."""
    ship_package(docs.sparkSession)

    def run(batches):
        claim("quality words", word_table.cache_clear)
        for part in slices(batches):
            yield part.filter(pa.array([r["kept"] for r in _judged(part, params)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """What `measure` gives with the parameters that `fit` gives; each text is measured once."""
    return _judge_fitted(docs, labels, params, Scratch(docs.sparkSession, "quality")).drop("lang")


def _judge_fitted(docs: DataFrame, labels: DataFrame, params: Params, scratch: Scratch, *keep: str) -> DataFrame:
    rows = scratch.write(measure(docs, params, "lang", *keep), "measures")
    fitted = _fit(rows.join(_good(labels), "doc_id", "left_semi"), params)

    def run(batches):
        for batch in batches:
            got = batch.select(["lang", "script", "n_words", "n_tokens", "base_failed", *RATIOS]).to_pylist()
            verdicts = [_verdict(r, r["lang"], fitted) for r in got]
            for name, kind in (("kept", pa.bool_()), ("reason", pa.string())):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array([v[name] for v in verdicts], kind))
            yield batch

    return rows.mapInArrow(run, rows.schema)


def keep_judged(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows that `judge` keeps, with all their columns. Rejected rows are known by doc_id and a hash of what
    is judged; they are broadcast while they are at most `broadcast_rows`, else joined by shuffle."""
    scratch = Scratch(docs.sparkSession, "quality-keep")
    which = F.xxhash64(F.col("text").isNull(), "text", "lang")
    judged = _judge_fitted(docs.select("doc_id", "text", "lang", which.alias("which")), labels, params, scratch, "which")
    gone = scratch.write(judged.where("not kept").select(F.col("doc_id").alias("_rejected_id"), F.col("which").alias("_rejected")).distinct(), "gone")
    scratch.keep("gone")
    few = gone.count() <= params.broadcast_rows
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").eqNullSafe(F.col("_rejected_id")) & (which == F.col("_rejected")), "left_anti")
