"""10. Packing: cost-balanced.

A piece of n tokens costs linear * n + quadratic * n**2 (attention stays within a piece). Documents are
cut into pieces of the full length, each a sequence of its own, and a rest; rests, longest first, go to
the cheapest sequence that has room. As many sequences are opened as the rests need in all, and a rest
that fits none is cut over those with the most room, so a group of documents leaves less than one
sequence of padding.

Pieces of full length leave at once. Rests, each shorter than a sequence, are held and packed by groups
of `group` documents of a partition, so a task holds one document's ids and `group * length` more, and
nothing is shuffled. A sequence's id is its partition and a counter; a task that runs again gives the same
ids.

Defined cases: null text is empty, and an empty text is its end token alone. Very long documents are
encoded part by part. Repeated rows are packed as often as they occur; ties keep the rows' order. A
doc_id of any type is passed on. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomtext.llm.frames import column, slices
from loomtext.llm.memory import claim
from loomtext.llm.vocabularies import byte_level
from loomtext.runtime import ship_package

#: Pieces in a batch that leaves a task.
BATCH = 1024


@dataclass(frozen=True)
class Params:
    vocabulary: str = "byte_bpe_50k.json"
    end_id: int = 0
    length: int = 1024
    linear: float = 1.0
    quadratic: float = 1.0 / 1024
    group: int = 4096


class Sequences:
    """Open sequences by room: a segment tree over 0..length, each leaf a heap of (cost, sequence) with
    exactly that room, each inner node the cheapest below it."""

    def __init__(self, n: int, length: int):
        self.leaves = 1 << length.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
        self.heaps[length] = [(0.0, s) for s in range(n)]
        heapify(self.heaps[length])
        self.best: list[tuple[float, int, int] | None] = [None] * (2 * self.leaves)
        self._renew(length)

    def _renew(self, room: int) -> None:
        best, heap = self.best, self.heaps[room]
        i = self.leaves + room
        best[i] = (*heap[0], room) if heap else None
        while i > 1:
            a, b = best[i], best[i ^ 1]
            i >>= 1
            best[i] = b if a is None or (b is not None and b < a) else a

    def cheapest(self, need: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest with room for `need`; ties go to the lower number."""
        i, got = self.leaves + need, None
        if self.best[i]:
            got = self.best[i]
        while i > 1:
            if not i & 1 and (b := self.best[i + 1]) and (got is None or b < got):
                got = b
            i >>= 1
        return got

    def roomiest(self) -> tuple[float, int, int]:
        """(cost, sequence, room) with the most room; ties go to the lower number."""
        i = 1
        while i < self.leaves:
            i = 2 * i + (self.best[2 * i + 1] is not None)
        room = i - self.leaves
        cost, s = min(self.heaps[room], key=lambda x: x[1])
        return cost, s, room

    def move(self, got: tuple[float, int, int], cost: float, took: int) -> None:
        was, s, room = got
        heap = self.heaps[room]
        if heap[0] == (was, s):
            heappop(heap)
        else:
            heap.remove((was, s))
            heapify(heap)
        self._renew(room)
        if took < room:  # a full sequence takes nothing more
            heappush(self.heaps[room - took], (cost, s))
            self._renew(room - took)


def balance(sizes: list[int], params: Params) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) for items no longer than a sequence."""
    open_ = Sequences(-(-sum(sizes) // params.length), params.length)
    out = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        start, left = 0, sizes[i]
        while left:
            got = open_.cheapest(left) or open_.roomiest()
            cost, s, room = got
            took = min(left, room)
            out.append((i, start, took, s, params.length - room))
            open_.move(got, cost + (params.linear * took + params.quadratic * took * took), took)
            start, left = start + took, left - took
    return out


def pack(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset: one row a piece."""
    ship_package(docs.sparkSession)
    schema = docs.select("doc_id").schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")):
        schema = schema.add(name, kind)

    def run(batches):
        claim("packing")
        vocabulary, length = byte_level(params.vocabulary), params.length
        end = np.array([params.end_id], "<u4").tobytes()
        used = TaskContext.get().partitionId() << 36
        rests: list[tuple[object, int, bytes, int]] = []

        def batch(docs, pieces, type_of):
            """Rows of (start, length, ids, doc_tokens, sequence_id, offset) with their documents."""
            start, size, ids, n, s, offset = zip(*pieces, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(docs, type_of), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

        def packed(type_of):
            nonlocal used
            sizes = [len(ids) // 4 for _, _, ids, _ in rests]
            placed = balance(sizes, params)
            for lo in range(0, len(placed), BATCH):
                some = placed[lo : lo + BATCH]
                held = [rests[i] for i, *_ in some]
                yield batch([x[0] for x in held], [(x[1] + start, size, x[2][4 * start : 4 * (start + size)], x[3], used + s, offset) for x, (_, start, size, s, offset) in zip(held, some, strict=True)], type_of)
            used += -(-sum(sizes) // length)
            rests.clear()

        type_of = None
        for part in slices(batches):
            type_of = part.schema.field(0).type
            docs, pieces = [], []
            for doc, text in zip(column(part, "doc_id"), column(part, "text"), strict=True):
                ids = vocabulary.encode(text or "") + end
                n = len(ids) // 4
                whole = n - n % length
                for at in range(0, whole, length):
                    docs.append(doc)
                    pieces.append((at, length, ids[4 * at : 4 * (at + length)], n, used, 0))
                    used += 1
                    if len(docs) == BATCH:
                        yield batch(docs, pieces, type_of)
                        docs, pieces = [], []
                if whole < n:
                    rests.append((doc, whole, ids[4 * whole :], n))
            if docs:
                yield batch(docs, pieces, type_of)
            if len(rests) >= params.group:
                yield from packed(type_of)
        if rests:
            yield from packed(type_of)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
