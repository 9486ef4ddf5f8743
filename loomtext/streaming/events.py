"""File events: debounce, windows, and incremental upkeep of a file table, batch and streaming alike.

Debounce is per path: a quiet gap ends a burst, and its last event stands. Late events are dropped
behind the watermark; removals come before changes and creations within a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "path string, type string, ts timestamp, event_id long"
# Fixed value: the default quiet gap.
QUIET = "300 milliseconds"


def source(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """Event files (Parquet) that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def debounced(events: DataFrame, quiet: str = QUIET, watermark: str | None = None) -> DataFrame:
    """path, start, last, type, n_events: one row for each burst of a path, with its last type."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    burst = rows.groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.max_by("type", F.struct("ts", "event_id")).alias("type"), F.max("ts").alias("last"), F.count("*").alias("n_events"))
    return burst.select("path", F.col("w.start").alias("start"), "last", "type", "n_events")


def windowed(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """event_type, start, n, total of tumbling windows."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def final_state(events: DataFrame, removed: str = "remove") -> DataFrame:
    """path, type: the last event of each path that isn't a removal."""
    return events.groupBy("path").agg(F.max_by("type", F.struct("ts", "event_id")).alias("type")).where(F.col("type") != removed)


def applied(state: DataFrame, batch: DataFrame) -> DataFrame:
    """A table (path, content) after a batch (path, type, ts, event_id, content): the last event of each
    path removes or replaces its row; unchanged content is left alone."""
    last = batch.groupBy("path").agg(F.max_by(F.struct("type", "content"), F.struct("ts", "event_id")).alias("e"))
    kept = state.join(last.select("path"), "path", "left_anti")
    fresh = last.where(~F.col("e.type").isin("remove", "rename")).select("path", F.col("e.content").alias("content"))
    return kept.unionByName(fresh)


def changed_only(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Events whose content differs from the table's, and removals of known paths."""
    was = state.select("path", F.sha2("content", 256).alias("was"))
    rows = batch.join(was, "path", "left")
    gone = F.col("type") == "remove"
    return rows.where((gone & F.col("was").isNotNull()) | (~gone & ~F.col("was").eqNullSafe(F.sha2("content", 256)))).drop("was")


PARTS = 64


def maintain(events: DataFrame, table_path: str, checkpoint: str, parts: int = PARTS, keep: int = 3, once: bool = False):
    """Start a stream that keeps a table of (path, content) under table_path, in `parts` parts by a hash of the
    path.

    A batch writes a new version of the parts it touches only; a part's newest complete version is its state, and
    older ones than the last `keep` are removed. A version is named by its batch, so a batch that runs again
    writes the same thing again. once: stop when all events at hand are applied.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")).persist()
        touched = [r["part"] for r in dealt.select("part").distinct().collect()]  # at most `parts` numbers
        if touched:
            held = {p: v for p, vs in _versions(spark, table_path).items() if (v := [x for x in vs if x < number])}
            old = [f"{table_path}/v{max(held[p])}/part={p}" for p in touched if p in held]
            schema = "path string, content string"
            state = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
            after = applied(state, dealt.drop("part")).withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))
            # parts that end empty leave a marker row, so that their older versions don't count
            empty = spark.createDataFrame([(None, None, p) for p in touched], "path string, content string, part int")
            after.unionByName(empty).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{table_path}/v{number}")
            _retain(spark, table_path, keep)
        dealt.unpersist()

    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _files(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, table_path: str) -> dict[int, list[int]]:
    """For each part, the numbers of the complete versions that hold it."""
    fs, root = _files(spark, table_path)
    out: dict[int, list[int]] = {}
    for version in fs.listStatus(root) if fs.exists(root) else []:
        name = version.getPath().getName()
        if not name.startswith("v") or not fs.exists(_files(spark, f"{table_path}/{name}/_SUCCESS")[1]):
            continue
        for part in fs.listStatus(version.getPath()):
            if part.getPath().getName().startswith("part="):
                out.setdefault(int(part.getPath().getName()[5:]), []).append(int(name[1:]))
    return out


def _retain(spark: SparkSession, table_path: str, keep: int) -> None:
    for part, versions in _versions(spark, table_path).items():
        for v in sorted(versions)[:-keep]:
            fs, place = _files(spark, f"{table_path}/v{v}/part={part}")
            fs.delete(place, True)


def current(spark: SparkSession, table_path: str) -> DataFrame:
    """path, content of the newest version of every part."""
    places = [f"{table_path}/v{max(v)}/part={p}" for p, v in _versions(spark, table_path).items()]
    schema = "path string, content string"
    return spark.read.schema(schema).parquet(*places).where("path is not null") if places else spark.createDataFrame([], schema)
