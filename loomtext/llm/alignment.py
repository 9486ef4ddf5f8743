"""11. Cross-tokenizer alignment: which tokens of two vocabularies lie over the same bytes.

Both tokenizations of a text give token ends (cumulative byte lengths). Ends that both share cut the text into
groups; every pair of tokens whose bytes overlap is a link. A slice of documents is aligned at once, as the end of
a document is an end of both: `cumsum` for ends, `intersect1d` for cuts, `searchsorted` for groups and for the
range of B tokens under each A token, `repeat` for the links.

How often two ids are linked is counted over the whole corpus: tasks count the pairs of chunks of some megabytes
of text, and a salted two-stage shuffle adds these up. The counts go back by a join of each chunk's distinct
pairs, salted for pairs that many chunks hold; a chunk's rows are summed for its documents where its links are.
Only the highest count of each B id is broadcast: the vocabulary bounds it.

Words are encoded once: no piece of the B vocabulary holds a space or line break after another character, so a text
may be cut before these, which is checked when the file is opened (else texts are encoded whole). A bounded number
of words is remembered.

Defined cases: texts that are null or empty, or that a vocabulary doesn't give back byte for byte, have no tokens:
zeros and an empty digest. Special tokens' strings are plain text. Very long texts are encoded part by part; the
largest single text must fit a task's memory. Repeated rows count and are given as often as they occur. A doc_id of
any type, null too, is passed on; other columns are ignored, whatever their name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.frames import column, slices
from loomtext.llm.joins import join_hot
from loomtext.llm.memory import claim
from loomtext.llm.vocabularies import LONG_TEXT, byte_level, long_parts, resolve
from loomtext.runtime import Scratch, ship_package

#: Pairs are a_id * 2^20 + b_id.
SHIFT = 20


@dataclass(frozen=True)
class Params:
    """chunk: bytes of text whose pairs are counted together; words: how many a worker remembers; salts: of the
    first stage of counting; hot: chunks that hold a pair, beyond which the join deals them."""

    a: str = "byte_bpe_50k.json"
    b: str = "piece_bpe_32k.model"
    chunk: int = 4 << 20
    words: int = 400_000
    salts: int = 16
    hot: int = 50_000


class Pieces:
    """Ids of a piece vocabulary for texts with a space before them, word by word."""

    #: A run of spaces or one line break, and what follows up to the next.
    UNIT = re.compile(r"(?: +|\n)[^ \n]*")

    def __init__(self, path: str, most: int):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=resolve(path))
        n = self._model.vocab_size()
        names = [self._model.id_to_piece(i) for i in range(n)]
        plain = [name for i, name in enumerate(names) if not (self._model.is_byte(i) or self._model.is_control(i) or self._model.is_unknown(i))]
        self.tokens = [bytes([int(name[3:5], 16)]) if self._model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.splits = "▁" in plain and not any("\n" in x or "▁" in x.lstrip("▁") for x in plain)
        self._lone = names.index("▁") if "▁" in names else -1
        self._most, self._known = most, Words()
        self._ids, self._starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of a space and each text."""
        if not self.splits:
            return [np.array(self._model.encode(t, num_threads=1), np.int64) for t in texts]
        out, short = [], []
        for t in texts:
            if len(t) > LONG_TEXT:
                out += self._encode_words(short) + [np.concatenate([self._encode_words([part])[0] for part in long_parts(" " + t)])]
                short = []
            else:
                short.append(" " + t)
        return out + self._encode_words(short)

    def _encode_words(self, texts: list[str]) -> list[np.ndarray]:
        """Of texts that start with a space."""
        if len(self._known) > self._most:
            self._known.clear()
            self._ids, self._starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        cut = [self.UNIT.findall(t) for t in texts]
        n_words = np.fromiter(map(len, cut), np.int64, len(cut))
        row = np.fromiter(map(self._known.__getitem__, chain.from_iterable(cut)), np.int64, int(n_words.sum()))
        self._learn()
        n = np.diff(self._starts)[row]
        ends = np.cumsum(n)
        ids = self._ids[np.repeat(self._starts[row] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int64)
        return np.split(ids, np.append(0, ends)[np.cumsum(n_words)[:-1]]) if cut else []

    def _learn(self) -> None:
        """Encode the words that were asked for first. The model puts a space before each; a line break can't
        merge with it, so it is a token of its own."""
        words, self._known.new = self._known.new, []
        got = self._model.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        broken = [i for i, w in enumerate(words) if w[0] == "\n"]
        if any(got[i][0] != self._lone for i in broken):
            raise ValueError("a line break merged with the space before it")
        for i in broken:
            del got[i][0]
        for i, w in enumerate(words):
            if w == " ":  # the model puts no space before nothing
                got[i] = [self._lone]
        n = np.fromiter(map(len, got), np.int64, len(got))
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(n)])
        self._ids = np.concatenate([self._ids, np.fromiter(chain.from_iterable(got), np.int32, int(n.sum()))])


class Words(dict):
    """word -> number, given when it is first asked for; `new` has those since the last look."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Names:
    """Bytes of each id, and its decimal text closed by `,` or by the mark that ends its side of a group."""

    def __init__(self, tokens: list[bytes], mark: str):
        self.bytes = pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.text = [f"{i},".encode() for i in range(len(tokens))] + [f"{i}{mark}".encode() for i in range(len(tokens))]


def _joined(values: pa.Array, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """(the bytes of these entries in a row, where each ends)."""
    got = values.take(pa.array(at))
    ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset + 1 : got.offset + 1 + len(got)]
    return memoryview(got.buffers()[2] or b""), ends


def _same(names: Names, ids: list[np.ndarray], raw: list[bytes]) -> np.ndarray:
    """Which texts are not empty and equal the bytes of their ids."""
    made, ends = _joined(names.bytes, np.concatenate([*ids, np.zeros(0, np.int64)]))
    stops = np.append(0, ends)[np.cumsum([len(x) for x in ids])].tolist()
    return np.array([bool(t) and made[at:end].tobytes() == t for t, at, end in zip(raw, [0, *stops], stops, strict=False)], np.bool_)


@cache
def _tables(a: str, b: str, words: int):
    """(A's encoder, B's encoder, names of both, texts of both one after the other)."""
    first, second = byte_level(a), Pieces(b, words)
    of_a, of_b = Names(first.tokens(), "|"), Names(second.tokens, ";")
    return first, second, of_a, of_b, pa.array(of_a.text + of_b.text, pa.large_binary())


@dataclass
class Aligned:
    """A slice's documents: counts and digests of each, and all links with the document of each."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digests: list[str]
    pairs: np.ndarray
    doc: np.ndarray


def align_texts(texts: list[str | None], params: Params = Params()) -> Aligned:
    first, second, of_a, of_b, both = _tables(params.a, params.b, params.words)
    full = [" " + t if t else "" for t in texts]
    raw = [t.encode() for t in full]
    a = [np.frombuffer(first.encode_plain(t), "<u4").astype(np.int64) if t else np.zeros(0, np.int64) for t in full]
    b = second.encode([t or "" for t in texts])
    for i in np.flatnonzero(~(_same(of_a, a, raw) & _same(of_b, b, raw))).tolist():
        a[i] = b[i] = np.zeros(0, np.int64)
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    ids_a, ids_b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
    end_a, end_b = np.cumsum(of_a.sizes[ids_a]), np.cumsum(of_b.sizes[ids_b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    # links: under each A token the B tokens from the first that ends behind its start; where an A token ends a
    # group, so does a B token, else the B token at its end lies under the next one too
    low = np.searchsorted(end_b, end_a - of_a.sizes[ids_a], side="right")
    n = np.append(low[1:], len(ids_b)) - low + ~last_a
    ends = np.cumsum(n)
    linked_b = np.repeat(low - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    doc_a = np.repeat(np.arange(len(texts)), n_a)
    pairs = (np.repeat(ids_a, n) << SHIFT) | ids_b[linked_b]
    # in order, a group's A tokens and then its B tokens; the last of a side has the closing mark
    upto_a, upto_b = (np.append(0, np.cumsum(np.bincount(g, minlength=len(cuts)))) for g in (group_a, group_b))
    text = np.empty(len(ids_a) + len(ids_b), np.int64)
    text[np.arange(len(ids_a)) + upto_b[group_a]] = ids_a + last_a * len(of_a.sizes)
    text[np.arange(len(ids_b)) + upto_a[group_b + 1]] = ids_b + last_b * len(of_b.sizes) + len(of_a.text)
    written, stops = _joined(both, text)
    stop = np.cumsum(n_a + n_b)
    digests, at = [], 0
    for upto, some in zip(stop.tolist(), (n_a + n_b).tolist(), strict=True):
        if some:
            end = int(stops[upto - 1])
            digests.append(hashlib.sha256(written[at : end - 1]).hexdigest())  # without the mark after the last group
            at = end
        else:
            digests.append("")
    n_groups = np.diff(np.append(0, group_a + 1)[np.cumsum(n_a)], prepend=0)
    return Aligned(n_a, n_b, n_groups, digests, pairs, np.repeat(doc_a, n))


def _chunk(held: list[tuple[list, Aligned]]) -> dict:
    """A chunk's documents, its distinct pairs with their counts, and for each document its distinct pairs
    (by number in the chunk) with its own counts."""
    ids = [d for x, _ in held for d in x]
    first = np.cumsum([0, *[len(x) for x, _ in held]])
    doc = np.concatenate([a.doc + at for (_, a), at in zip(held, first, strict=False)])
    numbered = pa.array(np.concatenate([a.pairs for _, a in held])).dictionary_encode()
    pairs, slot = numbered.dictionary.to_numpy(), numbered.indices.to_numpy().astype(np.int64)
    own, times = np.unique(doc * max(len(pairs), 1) + slot, return_counts=True)
    per_doc = np.bincount(own // max(len(pairs), 1), minlength=len(ids)) if len(own) else np.zeros(len(ids), np.int64)
    of = lambda name: np.concatenate([getattr(a, name) for _, a in held])
    return {
        "doc_ids": ids, "n_a": of("n_a").tolist(), "n_b": of("n_b").tolist(), "n_groups": of("n_groups").tolist(), "digests": [x for _, a in held for x in a.digests],
        "pairs": pairs, "times": np.bincount(slot, minlength=len(pairs)) if len(pairs) else np.zeros(0, np.int64),
        "n_slots": per_doc.astype("<i4").tobytes(), "slots": (own % max(len(pairs), 1)).astype("<i4").tobytes(), "slot_times": times.astype("<i4").tobytes(),
    }


def chunks(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """A row for each chunk of documents, see `_chunk`."""
    doc_id = docs.schema["doc_id"].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc_ids", T.ArrayType(doc_id))] + [T.StructField(c, longs) for c in ("n_a", "n_b", "n_groups")] + [T.StructField("digests", T.ArrayType(T.StringType())), T.StructField("pairs", longs), T.StructField("times", longs)] + [T.StructField(c, T.BinaryType()) for c in ("n_slots", "slots", "slot_times")])

    def run(batches):
        claim("alignment", _tables.cache_clear)
        number, held, size, kind = TaskContext.get().partitionId() << 32, [], 0, None

        def row():
            one = {"chunk": number} | _chunk(held)
            kinds = [pa.int64(), pa.list_(kind), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([one[c]], k) for c, k in zip(schema.names, kinds, strict=True)], names=schema.names)

        for part in slices(batches):
            kind = part.schema.field(0).type
            texts = column(part, "text")
            held.append((column(part, "doc_id"), align_texts(texts, params)))
            size += sum(len(t) for t in texts if t)
            if size >= params.chunk:
                yield row()
                number, held, size = number + 1, [], 0
        if held:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(held: DataFrame, params: Params = Params()) -> DataFrame:
    """pair, count (links over the corpus), best (no pair of its B id has a higher count) from chunks."""
    each = held.select("chunk", F.arrays_zip("pairs", "times").alias("z")).select("chunk", F.inline("z"))
    salted = each.groupBy(F.col("pairs").alias("pair"), F.pmod("chunk", F.lit(params.salts)).alias("salt")).agg(F.sum("times").alias("n"))
    counts = salted.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    return counts.join(F.broadcast(counts.groupBy("b").agg(F.max("count").alias("most"))), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def links(counts: DataFrame) -> DataFrame:
    """a, b, count, best: the alignment table of the two vocabularies."""
    return counts.select(F.shiftrightunsigned("pair", SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b"), "count", "best")


def align(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "alignment")
    held = scratch.write(chunks(docs, params), "chunks")
    counts = scratch.write(pair_counts(held, params), "counts")
    each = held.select("chunk", F.posexplode("pairs").alias("slot", "pair"))
    back = join_hot(each, counts, "pair", params.hot).groupBy("chunk").agg(F.collect_list(F.struct("slot", "count", "best")).alias("found"))
    doc_id = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc_id)] + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups_sha256", T.StringType())])

    def run(batches):
        claim("alignment sums")
        for batch in batches:
            get = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            for i in range(batch.num_rows):
                found = get("found")[i].values
                count, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if found is not None and len(found):
                    order = np.argsort(found.field("slot").to_numpy())
                    count, best = found.field("count").to_numpy()[order], found.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
                slots, times, n = (np.frombuffer(get(c)[i].as_buffer(), "<i4").astype(np.int64) for c in ("slots", "slot_times", "n_slots"))
                upto = np.cumsum(n)
                sums = [np.diff(np.append(0, np.cumsum(x))[upto], prepend=0) for x in (times, times * best[slots], times * count[slots])]
                flat = [get(c)[i].values for c in ("doc_ids", "n_a", "n_b", "n_groups")]
                yield pa.RecordBatch.from_arrays([*flat, *map(pa.array, sums), get("digests")[i].values], names=schema.names)

    rows = held.drop("pairs", "times").join(back, "chunk", "left")
    return rows.mapInArrow(run, schema)
