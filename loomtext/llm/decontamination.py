"""6. Benchmark decontamination: template canonicalisation.

Words lose outer punctuation and case; numbers, names and units become typed placeholders (`typed`
view). A second view (`plain`) leaves names as they are, for copies whose capitals changed. Windows of
k words are hashed in either view; a window with fewer than two literal words is hashed without
placeholders. A capitalised word that opens a sentence may be a name or not, so windows that touch such
words are hashed in every reading of them (literal or name), in documents and items, and meet if any
reading does. Items of fewer than k words are one window of their whole literal sequence (`whole` view).

Documents and benchmark become tables of windows, and the tables are hash-joined: first on each item's
rarest windows only, as many as a document can't all miss and still reach `share`, which gives the pairs of
document and item that may count; then these pairs on all windows. A pair's windows are then checked: the
item's slot values must map to the document's consistently (one item value, one document value) within a
stretch of the document, and the share of the item's windows found so must reach `share`. A stretch of
twice the item's length starts at every place where they begin to meet.

A sieve (a bitmap of the benchmark's window hashes, at most 2^24 bits, made by an aggregation) lets tasks
leave out windows that can't join; a benchmark that fills it only makes the join larger. Window tables
are broadcast while they have at most `broadcast_rows` rows, else shuffled.

Defined cases: null texts have no words and meet nothing; an item of one word is not looked for (it would
be found in ordinary text). Rows with the same doc_id and text are one document, and benchmark rows with
the same item_id and text are one item; a null doc_id or item_id is passed on. Ids may be of any type. Very
long texts are hashed block by block of words. An empty table gives no hits; other columns are ignored by
`hits` and kept by `keep_clean`.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import words as W
from loomtext.llm.frames import column, slices
from loomtext.llm.memory import claim
from loomtext.runtime import Scratch, ship_package

UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars cent cents euro euros eur usd gbp percent % degree degrees c f k w kw mw v a hz khz mhz ghz b kb mb gb tb".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?$")
MEASURE = re.compile(r"[+-]?\d[\d.,]*([a-z%]+)$")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_BYTE_UNITS = frozenset(u.encode() for u in UNITS)
NUM, TITLE, ENDS, UNIT, EMPTY = 1, 2, 4, 8, 16
_NUM, _NAME, _UNIT = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"<number>", b"<name>", b"<unit>"))
LONGS = T.ArrayType(T.LongType())
#: In the order in which equal shares are told apart.
VIEWS = ("typed", "plain", "whole")
#: Distinct words that a worker remembers before it starts anew.
MEMORY = 150_000
#: Bytes of text whose words are objects at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Params:
    window: int = 5
    share: float = 0.8
    literals: int = 2
    shortest: int = 2
    broadcast_rows: int = 500_000


class _Words(dict):
    """word -> row of (hash of its core, flags); remembered."""

    def __init__(self):
        super().__init__()
        self.hash, self.flags = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)

    def __missing__(self, word: bytes) -> int:
        if word.isalpha() and word.islower():  # ASCII only
            low, flags = word, (word in _BYTE_UNITS) * UNIT
        else:
            low, flags = _looked_at(word.decode("utf-8", "replace"))
        n = self[word] = len(self)
        if n >= len(self.hash):
            self.hash, self.flags = np.resize(self.hash, 2 * n), np.resize(self.flags, 2 * n)
        self.hash[n], self.flags[n] = xxhash.xxh3_64_intdigest(low), flags
        return n


def _looked_at(text: str) -> tuple[bytes, int]:
    """(a word's core in lower case, its flags)."""
    core = _OUTER.sub("", text)
    low = core.lower()
    flags = (not core) * EMPTY | (text.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":", ";", "…")) * ENDS
    if core and (core[0].isdigit() or text[0] in "+-$€£"):
        made = MEASURE.match(low)
        flags |= bool(NUMBER.match(low) or (made and made[1] in UNITS)) * NUM
    elif core:
        flags |= (core[0].isupper() and core[1:] == low[1:]) * TITLE | (low in UNITS) * UNIT
    return low.encode("utf-8", "replace"), flags


_WORDS = _Words()


@dataclass
class Canonical:
    """Kept words of some texts: which text (by number) and where in it, the literal hash, if it may be a
    name or not, and the hash and slot mask by view."""

    text: np.ndarray
    at: np.ndarray
    literal: np.ndarray
    unsure: np.ndarray
    views: tuple[tuple[np.ndarray, np.ndarray], ...]


def canonical(words: list[bytes], text: np.ndarray, at: np.ndarray) -> Canonical:
    """words: of texts, one after another; text, at: whose and which of its words each one is."""
    if len(_WORDS) > MEMORY:
        _WORDS.clear()
    rows = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    hashes, flags = _WORDS.hash[rows], _WORDS.flags[rows]
    keep = (flags & EMPTY) == 0
    opens = np.ones(len(words), np.bool_)
    opens[1:] = ((flags[:-1] & ENDS) > 0) | (text[1:] != text[:-1])
    text, at, hashes, flags, opens = text[keep], at[keep], hashes[keep], flags[keep], opens[keep]
    number = (flags & NUM) > 0
    unit = (flags & UNIT) > 0
    unit[1:] &= number[:-1] & (text[1:] == text[:-1])
    unit[:1] = False
    title = ((flags & TITLE) > 0) & ~unit
    name = title & ~opens
    plain = np.where(number, _NUM, np.where(unit, _UNIT, hashes))
    return Canonical(text, at, hashes, title & opens, ((np.where(name, _NAME, plain), number | unit | name), (plain, number | unit)))


def _in_window(mask: np.ndarray, k: int) -> np.ndarray:
    """How many of each window's words are in the mask."""
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
    return sums[k:] - sums[:-k]


def hashed(c: Canonical, view: int, params: Params) -> np.ndarray:
    """The hash of each window of at least k kept words; windows over two texts' seam mean nothing."""
    k = params.window
    h, slot = c.views[view]
    got = W.fast_windows(h, k)
    few = np.flatnonzero(_in_window(slot, k) > k - params.literals)
    if len(few):
        got[few] = _hash(c.literal, few, k, 0 * few)
    return got + np.uint64(view)


def whole(c: Canonical, size: int) -> np.ndarray:
    """The literal hash of each run of `size` kept words."""
    return W.fast_windows(c.literal, size) + np.uint64(VIEWS.index("whole") + size)


def _bits(mask: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """For the windows at these places, which of their words are in the mask."""
    return sum(mask[at + j].astype(np.int64) << j for j in range(k))


def _hash(h: np.ndarray, at: np.ndarray, k: int, named: np.ndarray) -> np.ndarray:
    """As `fast_windows`, of the windows at these places, with some of their words as names."""
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        acc = acc * W.MULTIPLIERS[0] + np.where((named >> j) & 1, _NAME, h[at + j])
    return W.mix(acc)


def readings(c: Canonical, params: Params, words: Sieve | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and slot bits (`typed` view) of windows with unsure words, once for each choice of them
    as names; the choice of none is in `hashed`. words: where given, windows with another word are left out."""
    k, (h, slot) = params.window, c.views[0]
    may = _in_window(c.unsure, k) > 0
    at = np.flatnonzero(may)
    if words is not None and len(at):
        near = (at[:, None] + np.arange(k)[None, :]).ravel()
        known = c.unsure[near] | slot[near] | words.holds(h[near]) | words.holds(c.literal[near])
        at = at[known.reshape(-1, k).all(axis=1)]
    parts = [(at[:0], h[:0], at[:0])]
    if len(at):
        slots, every = _bits(slot, at, k), _bits(c.unsure, at, k)
        named = every
    while len(at):
        got, bits = _hash(h, at, k, named), slots | named
        few = np.flatnonzero(np.bitwise_count(bits) > k - params.literals)
        if len(few):
            got[few] = _hash(c.literal, at[few], k, 0 * few)
        parts.append((at, got + np.uint64(VIEWS.index("typed")), bits))
        named = (named - 1) & every  # the next smaller choice
        left = named > 0
        at, slots, every, named = at[left], slots[left], every[left], named[left]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Sieve:
    """A bitmap of hashes that may be there: two cells of each are set."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.bits = cells, len(cells).bit_length() - 1

    @staticmethod
    def bits_for(n: int) -> int:
        return min(24, max(16, (64 * n).bit_length()))

    @staticmethod
    def of(hashes: DataFrame, name: str) -> Sieve:
        """Of a table's hashes; the driver gets at most 2^24 bits, by 64."""
        bits = Sieve.bits_for(hashes.count())
        cells = [F.shiftrightunsigned(name, 64 - bits), F.shiftrightunsigned(F.shiftleft(name, 20), 64 - bits)]
        words = hashes.select(F.explode(F.array(*cells)).alias("c")).groupBy((F.col("c") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("b"))
        got = words.toPandas()
        packed = np.zeros(1 << (bits - 6), np.int64)
        packed[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
        return Sieve(np.unpackbits(packed.view(np.uint8), bitorder="little").view(np.bool_))

    def holds(self, h: np.ndarray) -> np.ndarray:
        return self.cells[(h >> np.uint64(64 - self.bits)).astype(np.int64)] & self.cells[((h << np.uint64(20)) >> np.uint64(64 - self.bits)).astype(np.int64)]

    def among(self, h: np.ndarray) -> np.ndarray:
        """Which places hold a hash that may be there."""
        at = np.flatnonzero(self.cells[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        return at[self.holds(h[at])] if len(at) else at


def _read(part: pa.RecordBatch, k: int):
    """Canonical blocks of a slice's texts with the row number of each kept word's text. Long texts come in
    several blocks, each of which starts with what the last windows before need."""
    words: list[bytes] = []
    which: list[int] = []
    counts: list[int] = []

    def block():
        text = np.repeat(np.array(which, np.int64), counts)
        n = np.array(counts, np.int64)
        at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        return canonical(words, text, at)

    for i, text in enumerate(column(part, "text")):
        raw = (text or "").encode("utf-8", "replace")
        if len(raw) <= BLOCK:
            own = raw.split()
            words += own
            which.append(i)
            counts.append(len(own))
            continue
        tail, first = [], 0  # words held over, and the number of the first of them
        for own in W.blocks(raw, BLOCK):
            own = tail + own
            c = canonical(own, np.full(len(own), i), np.arange(first, first + len(own)))
            yield c
            held = len(own) - (int(c.at[-k - 1]) - first) + 1 if len(c.at) > k else len(own)  # one word more, for what a word's own flags need
            held = min(held, len(own))
            first += len(own) - held
            tail = own[len(own) - held :]
    if words:
        yield block()


def _lists(values: np.ndarray, k: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, k), pa.int32()), pa.array(values.ravel(), pa.int64()))


def _items(benchmark: DataFrame, scratch: Scratch, params: Params) -> tuple[DataFrame, DataFrame]:
    """(windows: item, view, class, hash, q, slots, cores; items: item, item_id, size, reach).

    item numbers an (item_id, text); windows with the same hash in the item's own reading are one class.
    """
    key = F.xxhash64("item_id", "text")
    texts = scratch.write(benchmark.where("text is not null").select("item_id", "text").distinct().withColumn("item", key), "items")
    k = params.window

    def run(batches):
        claim("template words", _WORDS.clear)
        for part in slices(batches):
            out = {x: [] for x in ("item", "view", "class", "hash", "q", "slots", "size", "reach")}
            cores = []

            def put(item, view, classes, h, q, slots, c, size, at, out=out, cores=cores):
                reach = 2 * (int(c.at[-1]) - int(c.at[0]) + 1)
                for name, value in (("item", item), ("view", view), ("class", classes), ("hash", h.view(np.int64)), ("q", q), ("slots", slots), ("size", size), ("reach", reach)):
                    out[name].append(np.broadcast_to(np.asarray(value), len(h)))
                cores += [x.view(np.int64) for x in at]

            for item, text in zip(column(part, "item"), column(part, "text"), strict=True):
                own = text.encode("utf-8", "replace").split()
                c = canonical(own, np.zeros(len(own), np.int64), np.arange(len(own)))
                n = len(c.at)
                if params.shortest <= n < k:
                    put(item, VIEWS.index("whole"), 0, whole(c, n), 0, 0, c, n, [c.literal])
                for view in range(2) if n >= k else ():
                    h = hashed(c, view, params)
                    q = np.arange(len(h))
                    _, classes = np.unique(h, return_inverse=True)
                    found = [(q, h, _bits(c.views[view][1], q, k))]
                    if VIEWS[view] == "typed":
                        found.append(readings(c, params))
                    for q, h, slots in found:
                        put(item, view, classes[q], h, q, slots, c, k, [c.literal[j : j + k] for j in q.tolist()])
            if out["item"]:
                cols = {x: np.concatenate(v) for x, v in out.items()}
                yield pa.RecordBatch.from_arrays([*[pa.array(cols[x], pa.int64()) for x in cols], pa.array(cores, pa.list_(pa.int64()))], names=[*cols, "cores"])

    schema = "item long, view long, class long, hash long, q long, slots long, size long, reach long, cores array<long>"
    return scratch.write(texts.select("item", "text").mapInArrow(run, schema), "item-windows"), texts.select("item", "item_id")


def _windows(docs: DataFrame, sieve, words, sizes: list[int], params: Params) -> DataFrame:
    """doc_id, doc, view, hash, at (where each word of the window stands), cores: windows the sieve lets through."""
    k = params.window
    schema = docs.select("doc_id", "doc").schema.add("view", "long").add("hash", "long").add("at", LONGS).add("cores", LONGS)

    def run(batches):
        claim("template words", _WORDS.clear)
        sieved, known = sieve.value, words.value
        for part in slices(batches):
            for c in _read(part, k):
                found = []
                for size in sizes:
                    if len(c.at) >= size:
                        h = whole(c, size)
                        p = sieved.among(h)
                        found.append((VIEWS.index("whole"), p, h[p], size))
                if len(c.at) >= k:
                    for view in range(2):
                        h = hashed(c, view, params)
                        p = sieved.among(h)
                        found.append((view, p, h[p], k))
                    p, h, _ = readings(c, params, known)
                    i = sieved.among(h)
                    found.append((0, p[i], h[i], k))
                for view, p, h, size in found:
                    one = c.text[p] == c.text[p + size - 1]
                    p, h = p[one], h[one]
                    if not len(p):
                        continue
                    near = p[:, None] + np.arange(size)[None, :]
                    rows = pa.array(c.text[p])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.full(len(p), view), pa.int64()), pa.array(h.view(np.int64), pa.int64()), _lists(c.at[near], size), _lists(c.literal[near].view(np.int64), size)], names=schema.names)

    return docs.select("doc_id", "doc", "text").mapInArrow(run, schema)


def best_stretch(hits: list[tuple], reach: int, need: int, share: float) -> tuple[float, int, int, int] | None:
    """(share, first word, end word, slots) of the best stretch of one item in one text and view.

    hits: (places of the window's words, q, class, slot bits, item's cores, text's cores), in order. A stretch
    starts at every hit that doesn't go on from one a word before it; those whose hits can't reach the best are
    left out.
    """
    most, spans, inside, end = [], [], Counter(), 0
    for i, (where, _, kind, *_) in enumerate(hits):
        while end < len(hits) and hits[end][0][0] < where[0] + reach:
            inside[hits[end][2]] += 1
            end += 1
        same_place = i and hits[i - 1][0][0] == where[0]
        most.append(most[-1] if same_place else len(inside))
        spans.append(spans[-1] if same_place else (i, end))
        inside[kind] -= 1
        if not inside[kind]:
            del inside[kind]
    best, follows = None, {((*where, where[0] + 1)[1], q + 1) for where, q, *_ in hits}
    starts = [i for i, (where, q, *_) in enumerate(hits) if (where[0], q) not in follows]
    for i in sorted(starts, key=lambda i: -most[i]):
        if most[i] < share * need or (best and most[i] <= best[0]):
            break
        off, stretch = hits[i][0][0] - hits[i][1], hits[slice(*spans[i])]
        for some in (stretch, sorted(stretch, key=lambda x: abs(x[0][0] - x[1] - off))):  # by place; nearest to the start's alignment first
            got = _taken(some)
            if best is None or got[0] > best[0]:
                best = got
            if got[0] == most[i]:
                break
    return best and (best[0] / need, *best[1:])


def _taken(hits: list[tuple]) -> tuple[int, int, int, int]:
    """(classes, first word, end word, slots) of the hits, each taken if consistent with those before."""
    means, seen, start, end = {}, set(), hits[0][0][0], hits[0][0][-1] + 1
    for where, _, kind, slots, cores, own in hits:
        pairs = {(cores[j], own[j]) for j in range(len(own)) if slots >> j & 1}
        if len({x for x, _ in pairs}) == len(pairs) and all(means.get(x, y) == y for x, y in pairs):
            means.update(pairs)
            seen.add(kind)
            start, end = min(start, where[0]), max(end, where[-1] + 1)
    return len(seen), start, end, len(means)


def _checked(pairs: DataFrame, params: Params) -> DataFrame:
    """Adds share, start, end and slots to rows (.., reach, need, hits); share is null where no stretch holds."""
    kept = [f for f in pairs.schema.fields if f.name != "hits"]
    schema = pairs.drop("hits").schema.add("share", "double").add("start", "long").add("end", "long").add("slots", "long")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):  # a pair at a time: its hits are as many as the text has
                part = batch.slice(at, 1)
                (hits,), (reach,), (need,) = column(part, "hits"), column(part, "reach"), column(part, "need")
                rows = sorted({(tuple(h["at"]), h["q"], h["class"], h["slots"], tuple(h["cores"]), tuple(h["own"])) for h in hits})
                got = best_stretch(rows, reach, need, params.share)
                if got and got[0] >= params.share:
                    share, start, end, slots = got
                    yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(f.name)) for f in kept], pa.array([share], pa.float64()), pa.array([start], pa.int64()), pa.array([end], pa.int64()), pa.array([slots], pa.int64())], names=schema.names)

    return pairs.mapInArrow(run, schema)


def _leaks(docs: DataFrame, benchmark: DataFrame, params: Params) -> DataFrame:
    """doc_id, doc (number of doc_id and text), item_id, view, share, start, end, slots."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "leaks")
    windows, items = _items(benchmark, scratch, params)
    n_windows = windows.count()
    small = (lambda x: F.broadcast(x)) if n_windows <= params.broadcast_rows else (lambda x: x)
    sizes = sorted(r["size"] for r in windows.where(F.col("view") == VIEWS.index("whole")).select("size").distinct().collect())
    sieve = spark.sparkContext.broadcast(Sieve.of(windows.select("hash"), "hash"))
    words = spark.sparkContext.broadcast(Sieve.of(windows.select(F.explode("cores").alias("hash")).distinct(), "hash"))
    met = scratch.write(_windows(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), "text"), sieve, words, sizes, params), "windows")
    # each item's rarest windows: one more than a document may miss
    often = met.join(small(windows.select("hash").distinct()), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("often"))
    classes = windows.join(often, "hash", "left").groupBy("item", "view", "class").agg(F.sum(F.coalesce("often", F.lit(0))).alias("often"))
    of_item = Window.partitionBy("item", "view")
    ranked = classes.withColumn("need", F.count("*").over(of_item)).withColumn("rank", F.row_number().over(of_item.orderBy("often", "class")))
    ranked = scratch.write(ranked.withColumn("least", F.ceil(F.col("need") * params.share - 1e-9)), "classes")
    rare = windows.join(ranked.where("rank <= need - least + 1"), ["item", "view", "class"]).select("item", "view", "hash").distinct()
    pairs = met.join(small(rare), ["view", "hash"]).select("doc_id", "doc", "item", "view").distinct()
    needed = ranked.select("item", "view", "need", "least").distinct()
    held = F.struct("at", "q", "class", "slots", "cores", "own").alias("hit")
    own = met.select("doc_id", "doc", "view", "hash", "at", F.col("cores").alias("own")).distinct()
    hits = own.join(pairs.withColumnRenamed("doc_id", "id"), ["doc", "view"]).where("doc_id <=> id").join(small(windows), ["item", "view", "hash"])
    grouped = hits.groupBy("doc_id", "doc", "item", "view", "reach").agg(F.collect_list(held).alias("hits")).join(needed, ["item", "view"])
    grouped = grouped.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["class"]))) >= F.col("least")).drop("least")
    found = scratch.write(_checked(grouped, params), "found")
    best = found.groupBy("doc_id", "doc", "item").agg(F.max_by(F.struct("view", "share", "start", "end", "slots"), F.struct("share", -F.col("view"))).alias("b"))
    views = F.element_at(F.array(*map(F.lit, VIEWS)), F.col("b.view").cast("int") + 1)
    return best.join(items, "item").select("doc_id", "doc", "item_id", views.alias("view"), "b.share", "b.start", "b.end", "b.slots")


def hits(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, item_id, view, share, start, end (words of the document), slots: leaked items only."""
    return _leaks(docs, benchmark, params).drop("doc")


def keep_clean(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows without a leaked item, with all their columns. Documents with a leak are broadcast while they
    are at most `broadcast_rows`, else joined by shuffle."""
    scratch = Scratch(docs.sparkSession, "leaked")
    gone = scratch.write(_leaks(docs, benchmark, params).select(F.col("doc_id").alias("_leaked_id"), F.col("doc").alias("_leaked_doc")).distinct(), "gone")
    few = gone.count() <= params.broadcast_rows
    return docs.join(F.broadcast(gone) if few else gone, (F.col("doc_id").eqNullSafe(F.col("_leaked_id"))) & (F.xxhash64("doc_id", "text") == F.col("_leaked_doc")), "left_anti")
