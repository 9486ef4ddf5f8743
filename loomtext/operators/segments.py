"""A positional trigram index in immutable segments.

`positions` has a row for each trigram of a file (of each million characters of a long one): where it stands, as
differences. `literal_positions` finds every place of a literal from these rows alone: the trigrams that cover the
literal, each moved back to where the literal would start, must meet in one place.

`Segments` keeps such rows under a folder. A batch of new, changed or removed files becomes a segment, which is never
written again, together with the ids of the files that it takes out of older ones. A manifest names the segments in
order; it is written last, so a batch that fails leaves the index as it was, and readers hold on to what they opened.
Neighbouring segments of one tier are merged into one of the next tier, without the rows that later segments took out.
Segments are partitioned by a hash of the trigram, so a search reads the buckets of its own trigrams only. Each task
sorts its own rows and writes a file a bucket, so neither a batch nor a merge shuffles postings.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.operators.index import PIECE, strings
from loomtext.runtime import ship_package

COLUMNS = "trigram string, file_id {}, deltas array<int>"
#: Ids of files that were taken out are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def _grouped(text: str, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigrams as rows of code points, ends of their lists, deltas) of a piece of text that starts at `at`."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    place = order + at
    deltas = np.diff(place, prepend=0)
    deltas[first] = place[first]
    mask = np.uint64((1 << 21) - 1)
    own = ranked[first]
    return np.stack([own >> np.uint64(42), (own >> np.uint64(21)) & mask, own & mask], 1).astype(np.uint32), np.append(first[1:], len(code)), deltas


def positions(corpus: DataFrame) -> DataFrame:
    """trigram, file_id, deltas: the characters (from 0) at which a trigram stands in a file, each less the one
    before it. Case is kept and every trigram counts; null content has none."""
    ship_package(corpus.sparkSession)
    schema = T.StructType([T.StructField("trigram", T.StringType()), corpus.schema["file_id"], T.StructField("deltas", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                for at in range(0, max(len(text) - 2, 0), PIECE):
                    codes, ends, deltas = _grouped(text[at : at + PIECE + 2], at)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(deltas, pa.int32()))
                    yield pa.RecordBatch.from_arrays([strings(codes), batch.column(0).take(pa.array(np.full(len(codes), i))), lists], names=schema.names)

    return corpus.select("file_id", "content").mapInArrow(run, schema)


def covering(literal: str) -> list[tuple[str, int]]:
    """(trigram, offset) that together cover the literal."""
    last = len(literal) - 3
    return [(literal[i : i + 3], i) for i in sorted({*range(0, last, 3), last})]


def literal_positions(index: DataFrame, literal: str) -> DataFrame:
    """file_id, start: every place of the literal (three characters or more), overlapping ones too."""
    if len(literal) < 3:
        raise ValueError("a literal has three characters or more")
    ship_package(index.sparkSession)
    asked = covering(literal)
    grams = sorted({g for g, _ in asked})
    rows = index.where(F.col("trigram").isin(grams))
    if len(grams) > 1:  # files without one of the trigrams go first
        whole = rows.groupBy("file_id").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(grams))
        rows = rows.join(whole, "file_id", "left_semi")
    schema = T.StructType([index.schema["file_id"], T.StructField("start", T.IntegerType())])

    def run(batches):
        for batch in batches:
            trigram, lists = batch.column(0).to_pylist(), batch.column(2)
            flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(sizes)
            total = np.append(0, np.cumsum(flat, dtype=np.int64))
            place = total[1:] - np.repeat(total[ends - sizes], sizes)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            for gram, at in asked:
                mine = np.array([t == gram for t in trigram], np.bool_)[row] & (place >= at)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row[mine])), pa.array(place[mine] - at, pa.int32())], names=schema.names)

    starts = rows.select("trigram", "file_id", "deltas").mapInArrow(run, schema)
    return starts.groupBy("file_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("file_id", "start")


@dataclass(frozen=True)
class Segment:
    name: str
    place: int  # order: later ones take files out of earlier ones
    tier: int


class Segments:
    """An index of positions under a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, file_id: str = "bigint", buckets: int = 64, fanout: int = 4):
        self.spark, self.root, self.buckets, self.fanout = spark, root.rstrip("/"), buckets, fanout
        self.columns = COLUMNS.format(file_id)
        self.ids = f"file_id {file_id}"

    def _fs(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _version(self) -> int:
        """The newest complete manifest; 0 if there is none."""
        fs, path = self._fs(f"{self.root}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(n[1:]) for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.root}/manifests/{n}/_SUCCESS")[1])]
        return max(done, default=0)

    def segments(self) -> list[Segment]:
        """Of the newest manifest, in order; their number grows with the logarithm of the batches."""
        version = self._version()
        if not version:
            return []
        rows = self.spark.read.schema("name string, place int, tier int").parquet(f"{self.root}/manifests/v{version}").collect()
        return sorted((Segment(**r.asDict()) for r in rows), key=lambda s: s.place)

    def _commit(self, segments: list[Segment]) -> None:
        rows = self.spark.createDataFrame([(s.name, s.place, s.tier) for s in segments], "name string, place int, tier int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/v{self._version() + 1}")

    def _write(self, rows: DataFrame, gone: DataFrame) -> str:
        name = f"s{uuid.uuid4().hex}"
        bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(self.buckets)).cast("int"))
        bucketed.sortWithinPartitions("bucket", "trigram", "file_id").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{name}/rows")
        gone.write.parquet(f"{self.root}/{name}/gone")
        return name

    def add(self, corpus: DataFrame, removed: DataFrame | None = None) -> None:
        """New and changed files (file_id, content; one row each), and ids of removed ones."""
        gone = corpus.select("file_id")
        gone = (gone if removed is None else gone.union(removed.select("file_id"))).where("file_id IS NOT NULL").distinct()
        held = self.segments()
        name = self._write(positions(corpus), gone)
        self._commit([*held, Segment(name, held[-1].place + 1 if held else 0, 0)])

    def _rows(self, segments: list[Segment], grams: list[str] | None) -> DataFrame:
        """Rows of these segments (with their place) that no later segment of the whole index took out."""
        out = self.spark.createDataFrame([], self.columns + ", place int")
        for s in segments:
            rows = self.spark.read.schema(self.columns + ", bucket int").parquet(f"{self.root}/{s.name}/rows")
            if grams is not None:
                hashed = self.spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(self.buckets)).cast("int")).distinct().collect()
                rows = rows.where(F.col("bucket").isin([r[0] for r in hashed]) & F.col("trigram").isin(grams))
            out = out.unionByName(rows.drop("bucket").withColumn("place", F.lit(s.place)))
        dead = self._dead()
        dead = F.broadcast(dead) if dead.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dead
        return out.join(dead.withColumnRenamed("file_id", "_id"), (F.col("file_id") == F.col("_id")) & (F.col("place") < F.col("last")), "left_anti")

    def _dead(self) -> DataFrame:
        """file_id, last: files with rows in a segment that a later one, `last` at the latest, took out. A batch lists
        its own files too, so a file that stands in one list alone has no older rows."""
        return self._gone(self.segments()).groupBy("file_id").agg(F.max("place").alias("last"), F.count("*").alias("n")).where("n > 1").select("file_id", "last")

    def _gone(self, segments: list[Segment]) -> DataFrame:
        out = self.spark.createDataFrame([], self.ids + ", place int")
        for s in segments:
            out = out.unionByName(self.spark.read.schema(self.ids).parquet(f"{self.root}/{s.name}/gone").withColumn("place", F.lit(s.place)))
        return out

    def read(self, grams: list[str] | None = None) -> DataFrame:
        """trigram, file_id, deltas of the files as they are now; grams: only these trigrams, from their buckets."""
        return self._rows(self.segments(), grams).select("trigram", "file_id", "deltas")

    def find(self, literal: str) -> DataFrame:
        """file_id, start of every place of a literal."""
        return literal_positions(self.read(sorted({g for g, _ in covering(literal)})), literal)

    def merge(self) -> bool:
        """Merge the first `fanout` neighbours of one tier, if there are so many; whether it did. Old segments stay
        until `clean`."""
        held = self.segments()
        for i in range(len(held) - self.fanout + 1):
            some = held[i : i + self.fanout]
            if len({s.tier for s in some}) == 1:
                name = self._write(self._rows(some, None).drop("place"), self._gone(some).select("file_id").distinct())
                self._commit([*held[:i], Segment(name, some[-1].place, some[0].tier + 1), *held[i + self.fanout :]])
                return True
        return False

    def clean(self) -> None:
        """Delete what the newest manifest doesn't name, and older manifests; no reader may hold these."""
        named, version = {s.name for s in self.segments()}, self._version()
        fs, path = self._fs(self.root)
        for x in fs.listStatus(path):
            if x.getPath().getName().startswith("s") and x.getPath().getName() not in named:
                fs.delete(x.getPath(), True)
        for x in fs.listStatus(self._fs(f"{self.root}/manifests")[1]):
            if x.getPath().getName() != f"v{version}":
                fs.delete(x.getPath(), True)
