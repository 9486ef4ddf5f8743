"""5. Token-ID output: best-fit-decreasing packing into id matrices.

Documents are encoded, closed by an end token and, where longer than a row, split without loss into
full rows and a rest. Rests, longest first, go into the open row with the least room that still fits,
found by a segment tree over room sizes; else a new row opens. Rows are written as fixed-width id
matrices (padded), with cumulative segment lengths and position ids that start anew at each segment.

Full rows leave at once. Rests, each shorter than a row, are held and packed by groups of `group` documents
of a partition, so a task holds one document's ids and `group * width` more, nothing is shuffled, and a task
that runs again gives the same rows.

Defined cases: null text is empty, and an empty text is its end token alone. Very long documents are
encoded part by part. Repeated rows are packed as often as they occur; ties keep the rows' order. A
doc_id of any type is passed on. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomtext.llm.frames import column, slices
from loomtext.llm.memory import claim
from loomtext.llm.vocabularies import byte_level
from loomtext.runtime import ship_package


@dataclass(frozen=True)
class Params:
    """width is at most 65,536, as position ids are uint16."""

    vocabulary: str = "byte_bpe_50k.tiktoken"
    end_id: int = 50256
    pad_id: int = 50256
    width: int = 1024
    group: int = 4096


class Rooms:
    """A segment tree over room sizes 0..most: each leaf counts the open rows with that much room."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) with the least room of `need` or more, taken out; None if there is none."""
        i = self.leaves + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up to the first right sibling that holds rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], width: int) -> list[list[int]]:
    """The items of each row, for items of at most `width`."""
    rooms, rows = Rooms(width), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = rooms.take(sizes[i])
        if got is None:
            rows.append([])
            got = len(rows) - 1, width
        rows[got[0]].append(i)
        if got[1] > sizes[i]:
            rooms.put(got[0], got[1] - sizes[i])
    return rows


def build(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One matrix row each: sequence_id, n_tokens, doc_ids, starts, cu_seqlens, ids (binary, width
    little-endian uint32), position_ids (binary, width little-endian uint16, padding 0)."""
    ship_package(docs.sparkSession)
    doc_id = docs.schema["doc_id"].dataType
    schema = T.StructType().add("sequence_id", "long").add("n_tokens", "long").add("doc_ids", T.ArrayType(doc_id)).add("starts", T.ArrayType(T.LongType())).add("cu_seqlens", T.ArrayType(T.IntegerType())).add("ids", "binary").add("position_ids", "binary")

    def run(batches):
        claim("packing")
        vocabulary, width = byte_level(params.vocabulary), params.width
        end, pad = np.array([params.end_id], "<u4").tobytes(), np.array([params.pad_id], "<u4").tobytes()
        count = np.arange(width, dtype="<u2").tobytes()
        number = TaskContext.get().partitionId() << 36
        rests: list[tuple[object, int, bytes]] = []
        type_of = None

        def batches_of(rows):
            """rows: the segments (doc_id, start, ids) of each."""
            nonlocal number
            held = []
            for segments in rows:
                sizes = [len(x) // 4 for _, _, x in segments]
                n = sum(sizes)
                held.append((number, n, [d for d, _, _ in segments], [s for _, s, _ in segments], np.append(0, np.cumsum(sizes)).tolist(), b"".join([*[x for _, _, x in segments], pad * (width - n)]), b"".join([*[count[: 2 * k] for k in sizes], bytes(2 * (width - n))])))
                number += 1
                if len(held) == 1024:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)

        def batch(held):
            cols = list(zip(*held, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.list_(type_of), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        def packed():
            rows = best_fit([len(x) // 4 for _, _, x in rests], width)
            yield from batches_of([rests[i] for i in items] for items in rows)
            rests.clear()

        def full(part):
            """Full rows of the part's documents; what is left of each goes to the rests."""
            for doc, text in zip(column(part, "doc_id"), column(part, "text"), strict=True):
                ids = vocabulary.encode(text or "") + end
                whole = len(ids) - len(ids) % (4 * width)
                for at in range(0, whole, 4 * width):
                    yield [(doc, at // 4, ids[at : at + 4 * width])]
                if whole < len(ids):
                    rests.append((doc, whole // 4, ids[whole:]))

        for part in slices(batches):
            type_of = part.schema.field(0).type
            yield from batches_of(full(part))
            if len(rests) >= params.group:
                yield from packed()
        if rests:
            yield from packed()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def write(packed: DataFrame, path: str) -> None:
    """Write the matrix rows as Parquet; Spark commits whole tasks only."""
    packed.write.mode("overwrite").parquet(path)


def matrix(rows, width: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(ids, position ids) of collected rows as matrices of rows x width."""
    return (np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").reshape(-1, width), np.frombuffer(b"".join(r["position_ids"] for r in rows), "<u2").reshape(-1, width))
