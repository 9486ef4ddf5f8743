"""Streams with keyed state: links equal a full run after any edits, bursts give one rebuild each."""

import datetime as dt
import random

from loomtext.streaming import linking as L


def folder(spark, place, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)


def test_links_follow_random_edits(spark, tmp_path):
    rng, place, edits, version = random.Random(4), str(tmp_path), [], 0
    names = ["a", "b", "c", None]
    for step in range(3):
        batch = []
        for _ in range(12):
            version += 1
            path = f"{rng.choice('xy')}/{rng.randrange(4)}"
            some = lambda: rng.sample(names[:3], rng.randrange(3))
            batch.append((path, version, None, None) if rng.random() < 0.2 else (path, version, some(), some()))
        if step == 2:
            batch += [edits[0], batch[0], (None, 99, ["a"], ["a"])]  # late, twice, without a path
        edits += batch
        rng.shuffle(batch)
        folder(spark, f"{place}/edits", batch, L.EDIT)
        changes = L.run_linker(spark.readStream.schema(L.EDIT).parquet(f"{place}/edits"), place)
        got = sorted(map(tuple, L.latest(changes).collect()))
        want = L.links_of(spark.createDataFrame([e for e in edits if e[0]], L.EDIT))
        assert got == sorted(map(tuple, want.collect()))


def test_a_definition_moves_references_of_other_files(spark, tmp_path):
    place = str(tmp_path)
    run = lambda *rows: (folder(spark, f"{place}/edits", list(rows), L.EDIT), L.run_linker(spark.readStream.schema(L.EDIT).parquet(f"{place}/edits"), place))[1]
    links = lambda c: {(r["name"], r["path"]): r["target"] for r in L.latest(c).collect()}
    assert links(run(("m/use", 1, [], ["f"]), ("n/far", 2, ["f"], []))) == {("f", "m/use"): "n/far"}
    assert links(run(("m/near", 3, ["f"], []))) == {("f", "m/use"): "m/near"}
    assert links(run(("m/near", 4, None, None))) == {("f", "m/use"): "n/far"}
    assert links(run(("n/far", 5, [], []))) == {}


def test_bursts_across_a_restart(spark, tmp_path):
    place, schema = str(tmp_path), "scope string, path string, ts timestamp"
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)

    def run(*rows):
        folder(spark, f"{place}/events", [(s, p, at(ms)) for s, p, ms in rows], schema)
        out = L.rebuilds(spark.readStream.schema(schema).parquet(f"{place}/events"), "0 seconds", 300, 2_000)
        out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/cp").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(L.REBUILD).parquet(f"{place}/out").collect()
        return sorted((r["scope"], (r["first"] - at(0)).total_seconds() * 1000, (r["last"] - at(0)).total_seconds() * 1000, r["n_events"], r["n_paths"]) for r in rows)

    assert run(("m", "a", 0), ("m", "b", 100), ("m", "a", 200)) == []
    assert run(("m", "c", 450)) == []  # the burst goes on after the restart
    assert run(("n", "z", 900)) == [("m", 0, 450, 4, 3)]
    got = run(*[("m", f"p{i}", 1_000 + 250 * i) for i in range(12)])  # never quiet: the longest wait ends it
    assert ("n", 900, 900, 1, 1) in got and any(s == "m" and first == 1_000 and last < 3_000 for s, first, last, *_ in got)
    end = run(("end", "e", 10_000))
    assert sum(n for s, _, _, n, _ in end if s == "m") == 16 and len([r for r in end if r[0] == "m"]) == 3


def test_bursts_of_one_batch_equal_the_stream(spark):
    rows = [("m", "a", dt.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 2, 9, 10, 30)]
    got = L.rebuilds_of(spark.createDataFrame(rows, "scope string, path string, ts timestamp"), 5_000).collect()
    assert sorted(r["n_events"] for r in got) == [1, 2, 3]
