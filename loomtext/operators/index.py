"""Derived tables that a search may use: trigrams, token postings, paths.

One code-point trigram table over lower-cased content; candidates hold all distinct trigrams of the
pattern up to the threshold, and are always verified afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import paths as P
from loomtext.runtime import ship_package


#: Code points of a text that are looked at at once.
PIECE = 1 << 20
#: Trigrams of small files that leave together.
ROWS = 1 << 16


def trigrams(corpus: DataFrame) -> DataFrame:
    """trigram, file_id: distinct; those without a letter, digit or underscore are skipped."""
    ship_package(corpus.sparkSession)
    schema = corpus.select("file_id").schema.add("trigram", "string")

    def run(batches):
        for batch in batches:
            held, rows = [], 0
            for i in range(batch.num_rows):
                codes = distinct_trigrams(batch.column(1)[i].as_py() or "")
                held.append((i, codes))
                rows += len(codes)
                if rows >= ROWS or i == batch.num_rows - 1:
                    which = np.repeat([i for i, _ in held], [len(c) for _, c in held]).astype(np.int64)
                    if rows:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), strings(np.concatenate([c for _, c in held]))], names=schema.names)
                    held, rows = [], 0

    return corpus.select("file_id", F.lower("content")).mapInArrow(run, schema).select("trigram", "file_id")


def distinct_trigrams(text: str) -> np.ndarray:
    """Rows of three code points each, in order."""
    word = np.zeros(128, np.bool_)
    word[[c for c in range(128) if chr(c).isalnum() or c == 95]] = True
    found = []
    for at in range(0, max(len(text) - 2, 0), PIECE):
        c = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        w = (c < 128) & word[np.minimum(c, 127)]
        keep = w[:-2] | w[1:-1] | w[2:]
        c = c.astype(np.uint64)
        found.append(np.unique(((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[keep]))
    codes = np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.uint64)
    mask = np.uint64((1 << 21) - 1)
    return np.stack([codes >> np.uint64(42), (codes >> np.uint64(21)) & mask, codes & mask], 1).astype(np.uint32)


def strings(codes: np.ndarray) -> pa.Array:
    """Rows of code points as a column of strings."""
    size = 1 + (codes > 0x7F).astype(np.int32) + (codes > 0x7FF) + (codes > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(size.sum(axis=1)))).astype(np.int32)
    data = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(data))


def read_trigrams(spark, path: str, pattern: str, buckets: int = 64) -> DataFrame:
    """The rows of a written table that a pattern's trigrams can be in: only their buckets are read."""
    grams = pattern_trigrams(pattern)
    return read_grams(spark, path, grams, buckets) if grams else spark.read.parquet(path).select("trigram", "file_id")


def read_grams(spark, path: str, grams: list[str], buckets: int = 64) -> DataFrame:
    """The rows of a written table with one of these trigrams; only their buckets are read."""
    rows = spark.read.parquet(path)
    hashed = spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int")).distinct().collect()
    return rows.where(F.col("bucket").isin([r[0] for r in hashed]) & F.col("trigram").isin(grams)).select("trigram", "file_id")


def write_trigrams(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Partitioned by a hash of the trigram, so that a query reads its buckets only."""
    rows.withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("trigram", "file_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def pattern_trigrams(pattern: str) -> list[str]:
    low = pattern.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2) if any(c.isascii() and (c.isalnum() or c == "_") for c in low[i : i + 3])})


def threshold(n: int) -> int:
    """How many of n trigrams a candidate must hold."""
    return n


def candidates(index: DataFrame, pattern: str) -> DataFrame:
    """Files that hold every trigram of the pattern (a superset of those that match)."""
    grams = pattern_trigrams(pattern)
    if not grams:
        return index.select("file_id").distinct()
    return index.where(F.col("trigram").isin(grams)).groupBy("file_id").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") >= threshold(len(grams))).select("file_id")


def postings(corpus: DataFrame) -> DataFrame:
    """token, file_id, n, first_offset: tokens are [a-z0-9_]{3,} of the lower-cased content.

    first_offset counts characters of the token stream before the first occurrence's token number.
    """
    tokens = corpus.select("file_id", F.posexplode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z0-9_]{3,})"), F.lit(1))).alias("at", "token"))
    return tokens.groupBy("token", "file_id").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


def find_token(index: DataFrame, token: str) -> DataFrame:
    return index.where(F.col("token") == token.lower())


def without(index: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The index less removed files."""
    return index.join(tombstones, "file_id", "left_anti")


def path_index(corpus: DataFrame) -> DataFrame:
    p = F.col("path")
    return corpus.select("file_id", "path", P.directory(p).alias("dir"), P.base(p).alias("base"), P.extension(p).alias("ext"), F.size(F.split(p, "/")).alias("depth"), P.category(p).alias("category"))


def semantic_keys(names: DataFrame, stem, split, phonetic, expand) -> DataFrame:
    """kind, key, name: words, stems, phonetic codes and expansions of distinct names."""
    words = names.select("name", split(F.col("name")).alias("ws"))
    word = words.select(F.lit("word").alias("kind"), F.explode("ws").alias("key"), "name")
    stems = word.where("char_length(key) >= 3").select(F.lit("stem").alias("kind"), stem(F.col("key")).alias("key"), "name")
    sounds = names.select(F.lit("phonetic").alias("kind"), phonetic(F.col("name")).alias("key"), "name")
    longer = words.select(F.lit("abbreviation").alias("kind"), F.explode(expand(F.col("ws"))).alias("key"), "name")
    return word.unionByName(stems).unionByName(sounds).unionByName(longer).distinct()
