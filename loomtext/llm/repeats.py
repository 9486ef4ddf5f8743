"""9. Suffix-array dedup: sparse suffix arrays.

Suffixes are kept at content-selected positions only: the minimisers of each `pick` consecutive k-word
shingles, so any `pick + k - 1` shared words select the same positions in either text. A passage of
`length` shared words then has a kept suffix whose first `length - pick + 1` words (its head) lie in it.
Heads that occur once are dropped after a pre-aggregated count. The rest are sorted globally by what
follows the head (range-partitioned with the document as the last key, so one head may fill many
partitions), neighbours from different documents are compared, and matches are extended to the right
and to the left of the head; those of `length` words or more are repeats. Extension compares 32 bits of
each word's hash next to a head of 64 bits that is equal, so a match is off by one word at an end once in
2^32. Another partner may still match further left than a neighbour in this order; the windows that a
suffix's best right extension allows and its neighbours don't hold are settled exactly, as keys that are
counted. Overlapping matches of a document are united.

Texts that are equal word by word are one text in all this; its repeats hold for every copy, and a copied text of
`length` words or more is a repeat as a whole.

Defined cases: null texts and texts of fewer than `length` words repeat nothing. Only passages shared
between different doc_ids count. Rows with the same doc_id are one document each time; a null doc_id is
left out; doc_id is an integer of any width. Very long texts are read block by block. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm import words as W
from loomtext.llm.frames import column, slices
from loomtext.llm.joins import join_hot
from loomtext.llm.memory import claim
from loomtext.runtime import Scratch, ship_package


@dataclass(frozen=True)
class Params:
    length: int = 50
    shingle: int = 8
    pick: int = 24
    broadcast_bytes: int = 1 << 20  # positions that are broadcast at most; more are joined by shuffle
    block: int = 20_000  # sorted suffixes compared at once, at least
    hot: int = 50_000  # rows of one key that one task joins; more are salted

    @property
    def head(self) -> int:
        return self.length - self.pick + 1


def minimisers(h: np.ndarray, params: Params) -> np.ndarray:
    """Positions of the smallest shingle (the last of equals) of each `pick` consecutive shingles."""
    if len(h) < params.shingle + params.pick - 1:
        return np.zeros(0, np.int64)
    s = W.fast_windows(h, params.shingle)
    n, step, low = len(s), 1, s
    at = np.arange(n)
    while step < params.pick:  # doubling windows, then one overlapping step
        jump = min(step, params.pick - step)
        later = low[jump:] <= low[:-jump]
        low, at = np.where(later, low[jump:], low[:-jump]), np.where(later, at[jump:], at[:-jump])
        step += jump
    return np.unique(at)


def _suffixes(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, n_words, two fingerprints of the word sequence, positions and heads of kept suffixes."""
    size = params.head

    def run(batches):
        for part in slices(batches):
            out = {x: [] for x in ("n", "a", "b", "pos", "head")}
            for text in column(part, "text"):
                h = W.text_hashes((text or "").encode("utf-8", "replace"))
                out["n"].append(len(h))
                order = np.arange(len(h), dtype=np.uint64)
                for x, m in (("a", 1), ("b", 2)):
                    out[x].append(int(W.mix(h * W.MULTIPLIERS[m] + order * W.MULTIPLIERS[m + 1]).sum(dtype=np.uint64).view(np.int64)))
                at = minimisers(h, params)
                at = at[at <= len(h) - size]
                out["pos"].append(at.astype(np.int32))
                out["head"].append(W.fast_windows(h, size)[at].view(np.int64) if len(at) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64()), pa.array(out["pos"], pa.list_(pa.int32())), pa.array(out["head"], pa.list_(pa.int64()))], names=["doc_id", "n_words", "fa", "fb", "pos", "head"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, n_words long, fa long, fb long, pos array<int>, head array<long>")


#: Bytes of a word's hash in a context.
WIDE = 4


def _contexts(rows: DataFrame, params: Params) -> DataFrame:
    """For each position: its head, up to pick - 1 words' hashes (WIDE bytes each, then zeros) to the right
    of the head and to the left of it (nearest first), and how many words these are."""
    size, most = params.head, params.pick - 1

    def run(batches):
        claim("suffixes")
        step = np.arange(most)
        fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDE * most), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
        for part in slices(batches):
            cols = {x: [] for x in CONTEXT}
            for doc, text, at in zip(column(part, "doc_id"), column(part, "text"), column(part, "pos"), strict=True):
                h = W.text_hashes((text or "").encode("utf-8", "replace"))
                at = np.unique(np.array(at, np.int64))
                at = at[at <= len(h) - size]
                if not len(at):
                    continue
                word = np.zeros(len(h) + 2 * most, ">u4")
                word[most : most + len(h)] = h >> np.uint64(32)
                right, left = word[(most + at + size)[:, None] + step], word[(most + at - 1)[:, None] - step]
                for name, value in zip(CONTEXT, (np.full(len(at), doc), at, W.fast_windows(h, size)[at].view(np.int64), right, left, np.minimum(most, len(h) - size - at), np.minimum(most, at)), strict=True):
                    cols[name].append(value)
            if cols["pos"]:
                made = {x: np.concatenate(v) for x, v in cols.items()}
                kinds = (pa.int64(), pa.int32(), pa.int64(), None, None, pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(made[x], k) if k else fixed(made[x]) for x, k in zip(CONTEXT, kinds, strict=True)], names=list(CONTEXT))

    return rows.select("doc_id", "text", "pos").mapInArrow(run, _CONTEXT)


CONTEXT = ("doc_id", "pos", "head", "right", "left", "n_right", "n_left")
_CONTEXT = "doc_id long, pos int, head long, right binary, left binary, n_right int, n_left int"


def _matrix(batch: pa.RecordBatch, name: str, most: int) -> np.ndarray:
    """A column of contexts as rows of words."""
    c = batch.column(batch.schema.get_field_index(name))
    if not len(c):
        return np.zeros((0, most), np.uint32)
    _, ends, data = c.buffers()
    start = int(np.frombuffer(ends, np.int32)[c.offset])
    return np.frombuffer(data, np.uint32, len(c) * most, start).reshape(-1, most)


def _shared(words: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the contexts of the rows a and b have in common from their start."""
    differ = words[a] != words[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    return np.minimum(first, np.minimum(known[a], known[b]))


def compared(batch: pa.RecordBatch, first: bool, last: bool, params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best right extension, start, end) of each of some sorted suffixes against the nearest of another
    document with the same head, before and after it; start is -1 where neither makes `length` words. first,
    last: whether the rows' first and last head may go on elsewhere, where all may match."""
    most, n = params.pick - 1, batch.num_rows
    doc, head, pos, n_right, n_left = (batch.column(batch.schema.get_field_index(x)).to_numpy().astype(np.int64) for x in ("doc_id", "head", "pos", "n_right", "n_left"))
    right, left = _matrix(batch, "right", most), _matrix(batch, "left", most)
    best, start, end = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
    new_head = np.concatenate(([True], head[1:] != head[:-1]))
    new_run = new_head | np.concatenate(([True], doc[1:] != doc[:-1]))
    row = np.arange(n)
    before = np.maximum.accumulate(np.where(new_run, row, 0)) - 1
    group = np.maximum.accumulate(np.where(new_head, row, 0))
    run_ends, head_ends = np.append(new_run[1:], True), np.append(new_head[1:], True)
    after = np.minimum.accumulate(np.where(run_ends, row, n)[::-1])[::-1] + 1
    group_end = np.minimum.accumulate(np.where(head_ends, row, n)[::-1])[::-1]
    for near, there, edge in ((before, before >= group, first & (group == 0)), (after, after <= group_end, last & (group_end == n - 1))):
        i = np.flatnonzero(there)
        j = near[i]
        r, l = _shared(right, n_right, i, j), _shared(left, n_left, i, j)  # noqa: E741
        best[i] = np.maximum(best[i], r)
        ok = l + r >= most
        i, a, b = i[ok], (pos[i] - l)[ok], (pos[i] + params.head + r)[ok]
        start[i] = np.where(start[i] < 0, a, np.minimum(start[i], a))
        end[i] = np.maximum(end[i], b)
        best[edge & ~there] = most
    return np.minimum(best, n_right), start, end


def _neighbours(suffixes: DataFrame, params: Params) -> DataFrame:
    """Each sorted suffix against its neighbours: best, start and end of `compared`, start null for none."""

    def run(batches):
        claim("suffixes")
        held, rows = [], 0

        def out(batch, first, last):
            best, start, end = compared(batch, first, last, params)
            none = start < 0
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(start, pa.int64(), mask=none), pa.array(end, pa.int64(), mask=none)], names=[*CONTEXT, "best", "start", "end"])

        first = True
        for batch in batches:
            held.append(batch.select(list(CONTEXT)))
            rows += batch.num_rows
            if rows < params.block:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            heads = whole.column(CONTEXT.index("head")).to_numpy()
            others = np.flatnonzero(heads != heads[-1])
            if len(others):  # the last head may go on in the next batch
                cut = int(others[-1]) + 1
                yield out(whole.slice(0, cut), first, False)
                first = False
            else:  # one head fills the block: its seams are edges
                cut = len(heads)
                yield out(whole, True, True)
                first = True
            held, rows = [whole.slice(cut)], len(heads) - cut
        if rows:
            yield out(pa.Table.from_batches(held).combine_chunks().to_batches()[0], first, True)

    names = ["head", "right", "doc_id", "pos"]
    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = suffixes.repartitionByRange(n, *names).sortWithinPartitions(*names)
    return sorted_.mapInArrow(run, _CONTEXT + ", best int, start long, end long")


def _splits(suffixes: DataFrame, params: Params) -> DataFrame:
    """Matches of exactly `length` words that no neighbour showed.

    A window that starts j words left of a suffix is open if the suffix's best right extension allows
    it and its neighbours' matches don't hold it. Of each head, every suffix makes keys
    (left words, head, right words) for the j that are open in any of them; equal keys are matches.
    """
    most, length = params.pick - 1, params.length
    held_lo, held_hi = f"cast(greatest(0, pos + {length} - end) as int)", f"cast(least({most}, pos - start) as int)"
    bits = lambda a, b: f"case when {a} <= {b} then shiftleft(1, {b} + 1) - shiftleft(1, {a}) else 0 end"
    rows = suffixes.select("doc_id", "pos", "head", "left", "right", F.expr(f"{most} - best").alias("lo"), F.col("n_left").alias("hi"), F.expr(held_lo).alias("a"), F.expr(held_hi).alias("b"), "start")
    rows = rows.select("doc_id", "pos", "head", "left", "right", F.expr(bits("lo", "hi")).alias("may"), F.expr(f"case when start is null then 0 else {bits('a', 'b')} end").alias("held"))
    open_ = rows.where("may & ~held != 0").groupBy("head").agg(F.bit_or(F.expr("may & ~held")).alias("open"))
    each = join_hot(rows, open_, "head", params.hot).where("may & open != 0").select("doc_id", "pos", "head", "left", "right", F.explode(F.expr(f"filter(sequence(0, {most}), j -> (shiftright(may & open, j) & 1) = 1)")).alias("j"))
    key = F.xxhash64("j", "head", F.substring("left", F.lit(1), WIDE * F.col("j")), F.substring("right", F.lit(1), WIDE * (F.lit(most) - F.col("j"))))
    each = each.select("doc_id", (F.col("pos") - F.col("j")).cast("long").alias("start"), key.alias("key"))
    twice = each.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b").select("key")
    return join_hot(each, twice, "key", params.hot).select("doc_id", "start", (F.col("start") + length).alias("end"))


def spans(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, start, end (words, end exclusive), n_words of the span: each repeat once a document."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "repeats")
    kept = scratch.write(_suffixes(docs, params), "suffixes")
    texts = scratch.write(kept.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"), F.max("n_words").alias("n_words")), "texts")
    reps = kept.join(texts.select("fa", "fb", F.col("rep").alias("doc_id")), ["fa", "fb", "doc_id"], "left_semi")
    each = scratch.write(reps.select("doc_id", F.explode(F.arrays_zip("pos", "head")).alias("s")).select("doc_id", "s.pos", "s.head"), "each")
    heads = scratch.write(each.groupBy("head").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b").select("head"), "heads")
    where = scratch.write(join_hot(each, heads, "head", params.hot).groupBy("doc_id").agg(F.collect_list("pos").alias("pos")), "where")
    scratch.drop("each", "heads")
    size = where.agg(F.sum(F.size("pos") * 4 + 24)).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(where) if size <= params.broadcast_bytes else where, "doc_id")
    found = scratch.write(_contexts(rows, params), "contexts")
    near = scratch.write(_neighbours(found, params), "compared")
    scratch.drop("contexts", "where")
    matches = scratch.write(near.where("start is not null").select("doc_id", "start", "end").union(_splits(near, params)), "matches")
    scratch.drop("compared")
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    united = matches.distinct().withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    part = united.join(texts.where(f"rep = most and n_words >= {params.length}").select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "start", "end")
    # a text that several documents have repeats whole; its copies share one key, so that may be hot
    copied = texts.where(f"rep != most and n_words >= {params.length}").select("fa", F.col("fb").alias("other"), F.col("n_words").alias("end"))
    copies = join_hot(kept.where(f"n_words >= {params.length}").select("doc_id", "fa", "fb"), copied, "fa", params.hot, "doc_id").where("fb = other")
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("start"), "end").distinct()
    return part.union(whole).select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
