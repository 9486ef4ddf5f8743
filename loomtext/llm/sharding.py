"""7. Sharding: rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

Each shard scores each key with -weight / ln(u), u in (0, 1) from the first 52 bits of
md5(key || ':' || shard); the highest score takes the row. A new shard only ever outbids the others, so adding
one moves rows into it alone, and a shard's share of the keys is that of its weight.

Slots are gapless from 0 within a shard without one task per shard: rows are dealt to
(shard, bucket) by a hash of the row, numbered there, and shifted by the rows of earlier buckets, which
come from a pre-aggregated table of shards x buckets counts. Equal rows are counted first and numbered last.

Defined cases: null text has no bytes and crc32 0; a null key counts as the key `null`. Rows with the
same key go to the same shard; equal rows get different slots. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one ranking task is meant for.
BUCKET_ROWS = 200_000
#: At most this many (shard, bucket) counts are broadcast.
MOST_BUCKETS = 1 << 20


def score(key: Column, shard: int, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.log(u)


def choose(key: Column, weights: list[float]) -> Column:
    """The shard of a key; ties go to the higher number."""
    bids = [F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return (bids[0] if len(bids) == 1 else F.greatest(*bids))["shard"]


def grow(key: Column, shard: Column, weights: list[float], grown: list[float]) -> Column:
    """The shard under `grown`, given the one under `weights`: where only further shards were added, just theirs
    are scored against the score of the shard that holds the key."""
    n = len(weights)
    if grown[:n] != weights or not any(w > 0 for w in grown[n:]):
        return choose(key, grown)
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    held = F.element_at(F.array(*[F.lit(-float(w)) for w in weights]), shard + 1) / F.log(u)
    best = F.struct(held.alias("score"), shard.alias("shard"))
    return F.greatest(best, *[F.struct(score(key, n + i, w).alias("score"), F.lit(n + i).alias("shard")) for i, w in enumerate(grown[n:]) if w > 0])["shard"]


def assign(docs: DataFrame, weights: list[float], grown: list[float]) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard: shards under `weights`, and under `grown`."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", key.alias("key"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), choose(key, weights).alias("shard"))
    rows = rows.withColumn("grown_shard", grow(F.col("key"), F.col("shard"), weights, grown)).drop("key")
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS // len(weights), -(-n // (BUCKET_ROWS * len(weights)))))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")
    counts = rows.groupBy("shard", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("base"))
    # rows that are alike in every column are one row with a count until they are numbered
    alike = rows.groupBy("shard", "doc_id", "text_crc32", "size", "grown_shard").agg(F.count("*").alias("copies")).withColumn("bucket", bucket)
    upto = F.sum("copies").over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "grown_shard").rowsBetween(Window.unboundedPreceding, 0))
    placed = alike.withColumn("first", upto - F.col("copies")).join(F.broadcast(before), ["shard", "bucket"])
    each = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("first") + F.col("i")).cast("long").alias("slot"), "grown_shard")
