import datetime as dt

from loomtext.streaming import events as S

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


ROWS = [("a", "create", at(0), 1), ("a", "write", at(100), 2), ("a", "remove", at(250), 3), ("b", "write", at(0), 4), ("b", "write", at(900), 5)]


def test_debounce_keeps_the_last_of_a_burst(spark):
    rows = spark.createDataFrame(ROWS, S.EVENTS)
    got = sorted((r["path"], r["type"], r["n_events"]) for r in S.debounced(rows).collect())
    assert got == [("a", "remove", 3), ("b", "write", 1), ("b", "write", 1)]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame(ROWS + [("z", "write", at(10_000_000), 9)], S.EVENTS).write.parquet(folder)
    q = S.debounced(S.source(spark, folder), watermark="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["path"], r["type"], r["n_events"]) for r in spark.table("bursts").collect())
    assert got == [("a", "remove", 3), ("b", "write", 1), ("b", "write", 1)]  # the burst of z is still open


def test_applied_batches(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    schema = "path string, type string, ts timestamp, event_id long, content string"
    batch = spark.createDataFrame([("a", "remove", at(0), 1, None), ("a", "create", at(5), 2, "new"), ("b", "remove", at(1), 3, None), ("c", "create", at(1), 4, "3")], schema)
    assert sorted(tuple(r) for r in S.applied(state, batch).collect()) == [("a", "new"), ("c", "3")]
    same = spark.createDataFrame([("a", "write", at(0), 1, "1"), ("b", "write", at(0), 2, "x"), ("q", "remove", at(0), 3, None)], schema)
    assert [r["path"] for r in S.changed_only(state, same).collect()] == ["b"]


def test_maintained_table_survives_a_restart(spark, tmp_path):
    schema = "path string, type string, ts timestamp, event_id long, content string"
    folder, target, mark = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([("a", "create", at(0), 1, "1"), ("b", "create", at(1), 2, "2")], schema).write.parquet(folder)
    for more in (None, [("a", "remove", at(9), 3, None)]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(folder)
        q = S.maintain(S.source(spark, folder, schema), target, mark)
        q.processAllAvailable()
        q.stop()
    assert [tuple(r) for r in S.current(spark, target).collect()] == [("b", "2")]
