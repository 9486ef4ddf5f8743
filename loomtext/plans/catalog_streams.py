"""Queries of streams with keyed state, each run to the end over files that a table was written as."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.registry import query
from loomtext.runtime import Scratch, table
from loomtext.streaming import linking as L

_STATE = "e AS (SELECT p_brand || '/f' || p_partkey AS path, p_brand AS dir, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS def, [p_type, p_name] AS uses FROM part WHERE p_partkey % 7 <> 0)"
_SCHEMA = L.EDIT


def edits(spark, sf_dir):
    """path, version, defines, uses: every part is a file; a third is edited once more, a seventh removed at last."""
    part = table(spark, sf_dir, "part").withColumn("path", F.concat("p_brand", F.lit("/f"), F.col("p_partkey").cast("string")))
    uses = F.array("p_type", "p_name")
    first = part.select("path", F.lit(1).cast("long").alias("version"), F.array("p_name").alias("defines"), uses.alias("uses"))
    second = part.where("p_partkey % 3 = 0").select("path", F.lit(2).cast("long"), F.array("p_type"), uses)
    none = F.lit(None).cast("array<string>")
    third = part.where("p_partkey % 7 = 0").select("path", F.lit(3).cast("long"), none.alias("defines"), none.alias("uses"))
    return [rows.toDF("path", "version", "defines", "uses") for rows in (first, second, third)]


@query(f"WITH {_STATE}, near AS (SELECT def AS name, dir, min(path) AS near FROM e GROUP BY ALL), far AS (SELECT name, min(near) AS far FROM near GROUP BY 1), u AS (SELECT DISTINCT path, dir, unnest(uses) AS name FROM e) SELECT u.name, u.path, coalesce(near, far) AS target FROM u JOIN far USING (name) LEFT JOIN near USING (name, dir)")
def linked_incrementally(spark, sf_dir):
    """Links after three batches of edits, each run through both streams from where they stopped."""
    place = Scratch(spark, "linker").root
    for batch in edits(spark, sf_dir):
        batch.write.mode("append").parquet(f"{place}/edits")
        changes = L.run_linker(spark.readStream.schema(_SCHEMA).parquet(f"{place}/edits"), place)
    return L.latest(changes)


@query("WITH g AS (SELECT event_type AS scope, user_id, ts, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events), b AS (SELECT *, sum(CASE WHEN gap < 1800000 THEN 0 ELSE 1 END) OVER (PARTITION BY scope ORDER BY ts) AS burst FROM g) SELECT scope, epoch_us(min(ts)) // 1000 AS first, epoch_us(max(ts)) // 1000 AS last, count(*) AS n_events, count(DISTINCT user_id) AS n_paths FROM b GROUP BY scope, burst")
def rebuilds_debounced(spark, sf_dir):
    """Bursts of events of a type, closed by half an hour of quiet; a last event far ahead ends those still open."""
    scratch = Scratch(spark, "rebuilds")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("path"), "ts")
    end = spark.sql("SELECT 'end' AS scope, 'end' AS path, TIMESTAMP '2100-01-01' AS ts")
    rows.union(end).write.parquet(f"{scratch.root}/events")
    stream = spark.readStream.schema("scope string, path string, ts timestamp").parquet(f"{scratch.root}/events")
    out = L.rebuilds(stream, quiet=1_800_000, longest=10**12)
    out.writeStream.format("parquet").option("path", f"{scratch.root}/bursts").option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(L.REBUILD).parquet(f"{scratch.root}/bursts").where("scope != 'end'")
    return found.select("scope", F.unix_millis("first").alias("first"), F.unix_millis("last").alias("last"), "n_events", "n_paths")
