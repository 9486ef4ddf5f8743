"""1. Language ID: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, every run of non-letters becomes one separator, and the 1-, 2- and 3-grams
that hold no inner separator are hashed into 2**k buckets. Fitting counts buckets per language on the
executors; the driver gets one count per language and bucket (never anything per document), turns
them into a fixed-point log-probability matrix of at most `max_cells` cells and broadcasts it.
Scoring takes the sparse (document, bucket) rows of a batch and sums matrix columns with numpy;
sums are of integers, so they don't depend on how rows are batched.

Defined cases: null text or a text without letters gives `und` and score 0; so does every text when
nothing was learned. A null `lang` is not learned from; an empty one is a language like any other. Repeated rows are scored and learned
once for each row. Texts are cut into pieces of bounded size that overlap by one n-gram less a letter, so that
no n-gram is lost or counted twice. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.frames import column, slices
from loomtext.runtime import ship_package

UNDETERMINED = "und"
#: Code points handled at once, about.
PIECE = 400_000
SEPARATOR = 32
SCALE = 1 << 16


@dataclass(frozen=True)
class Params:
    """max_docs_per_lang bounds the labelled sample: about so many rows of each language, by a hash
    of the row's key, are learned from; all rows of the table are scored."""

    orders: tuple[int, ...] = (1, 2, 3)
    max_bits: int = 16
    max_cells: int = 1 << 22
    smoothing: float = 0.1
    max_docs_per_lang: int = 30_000


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    bits: int
    orders: tuple[int, ...]
    log_prior: np.ndarray  # int64, fixed point
    log_prob: np.ndarray  # int32, langs x buckets, fixed point


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def _pieces(text: str, orders: tuple[int, ...]):
    """(code points, how many of them the piece before has): cut at a non-letter where there is one, else within a
    run of letters, with an overlap of the longest order less one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    held = 0
    while len(points) > PIECE:
        gaps = np.flatnonzero(~_letters()[points[max(held, 1) : PIECE]])
        cut = int(gaps[-1]) + max(held, 1) if len(gaps) else PIECE
        yield points[:cut], held
        held = 0 if len(gaps) else max(orders) - 1
        points = points[cut - held :]
    yield points, held


def grams(texts: list[str | None], orders: tuple[int, ...], bits: int):
    """Yields (rows, buckets) of bounded size: which text each n-gram is of, and its bucket."""
    held, rows, size = [], [], 0
    for i, text in enumerate(texts):
        pieces = list(_pieces(text, orders)) if text else []
        for k, (piece, again) in enumerate(pieces):
            held.append((piece, again, k + 1 < len(pieces) and pieces[k + 1][1] > 0))
            rows.append(i)
            size += len(piece) + 2
            if size > PIECE:
                yield _hashed(held, rows, orders, bits)
                held, rows, size = [], [], 0
    if held:
        yield _hashed(held, rows, orders, bits)


def _hashed(pieces, rows, orders, bits):
    """n-grams of pieces (code points, how many at its start stood at the end of the one before, whether its run
    goes on in the next): a separator is put at each end but where a run of letters was cut, and n-grams that lie
    within the overlap are left out, as the piece before has them."""
    gap = np.array([SEPARATOR], np.uint32)
    points = np.concatenate([x for p, again, on in pieces for x in (gap, p, gap)])
    size = [len(p) + 2 for p, _, _ in pieces]
    of = np.repeat(np.array(rows, np.int32), size)
    # 0: whole; 1: the place of a cut, no n-gram may hold it; 2: overlap, no n-gram may end in it
    mark = np.zeros(len(points), np.int8)
    at = 0
    for (p, again, on), n in zip(pieces, size, strict=True):
        if again:
            mark[at] = 1
            mark[at + 1 : at + 1 + again] = 2
        if on:
            mark[at + n - 1] = 1
        at += n
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first separator of each run
    keep[0] = True
    keep |= mark == 1
    c, of, mark, letter = np.where(letter, points, SEPARATOR)[keep].astype(np.uint64), of[keep], mark[keep], letter[keep]
    cut = np.concatenate(([0], np.cumsum(mark == 1)))
    out_rows, out = [], []
    for n in orders:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h ^ c[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        good = letter[:m].copy() if n == 1 else np.ones(m, np.bool_)
        for j in range(1, n - 1):
            good &= letter[j : j + m]
        if n == 2:
            good &= letter[:m] | letter[1 : 1 + m]
        good &= (cut[n : n + m] == cut[:m]) & (mark[n - 1 : n - 1 + m] != 2)
        row = np.where(letter[:m], of[:m], of[min(1, n - 1) : min(1, n - 1) + m])
        out_rows.append(row[good])
        out.append((h[good] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits))
    return np.concatenate(out_rows), np.concatenate(out).astype(np.int64)


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """Learn from rows (key, text, lang); the key only chooses the bounded sample."""
    ship_package(labelled.sparkSession)
    rows = labelled.select("key", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), 1, params.orders, np.zeros(0, np.int64), np.zeros((0, 2), np.int32))
    bits = min(params.max_bits, (params.max_cells // len(langs)).bit_length() - 1)
    if bits < 8:
        raise ValueError(f"{len(langs)} languages leave fewer than 256 buckets each")
    share = {x: min(1.0, params.max_docs_per_lang / n) for x, n in sizes.items()}
    limit = F.create_map(*[F.lit(y) for x in langs for y in (x, int(share[x] * 1_000_000))])
    sample = rows.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1_000_000)) < limit[F.col("lang")]).select("text", "lang")
    index, orders = {x: i for i, x in enumerate(langs)}, params.orders

    def count(batches):
        totals = np.zeros((len(langs), 1 << bits), np.int64)
        for part in slices(batches):
            texts, of = column(part, "text"), np.array([index[x] for x in column(part, "lang")])
            for rows, buckets in grams(texts, orders, bits):
                cells = np.bincount((of[rows] << bits) + buckets, minlength=totals.size)
                totals += cells.reshape(totals.shape)
        for i in range(len(langs)):
            at = np.flatnonzero(totals[i])
            for lo in range(0, len(at), 16_384):
                some = at[lo : lo + 16_384]
                yield pa.record_batch({"lang_no": pa.array(np.full(len(some), i), pa.int32()), "bucket": pa.array(some, pa.int32()), "n": pa.array(totals[i, some], pa.int64())})

    counted = sample.mapInArrow(count, "lang_no int, bucket int, n long").groupBy("lang_no", "bucket").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros((len(langs), 1 << bits))
    totals[counted["lang_no"], counted["bucket"]] = counted["n"]
    totals += params.smoothing
    log_prob = np.log(totals / totals.sum(axis=1, keepdims=True))
    prior = np.log(np.array([sizes[x] for x in langs]) / sum(sizes.values()))
    return Model(langs, bits, orders, np.rint(prior * SCALE).astype(np.int64), np.rint(log_prob * SCALE).astype(np.int32))


def score(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, posterior) of each text."""
    n, m = len(texts), len(model.langs)
    total = np.repeat(model.log_prior[None, :].astype(np.float64), n, axis=0)
    seen = np.zeros(n, np.bool_)
    for rows, buckets in grams(texts, model.orders, model.bits):
        for k in range(m):
            total[:, k] += np.bincount(rows, weights=model.log_prob[k, buckets], minlength=n)  # integers below 2**53: exact
        seen[rows] = True
    if not m:
        return [(UNDETERMINED, 0.0)] * n
    best = total.argmax(axis=1)
    weight = np.exp((total - total.max(axis=1, keepdims=True)) / SCALE)
    sure = np.round(1.0 / weight.sum(axis=1), 6)
    return [(model.langs[b], float(s)) if ok else (UNDETERMINED, 0.0) for b, s, ok in zip(best, sure, seen, strict=True)]


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Adds lang_pred and score to the kept columns, reading whole texts."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for part in slices(batches):
            got = score(shared.value, column(part, "text"))
            kept = part.select(keep)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def identify(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Fold 1 of crc32(doc_id) mod 3 is never learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labelled = docs.where(fold != 1).select(F.col("doc_id").alias("key"), "text", "lang")
    rows = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    return predict(rows, fit(labelled, params), ["doc_id", "held_out"])
