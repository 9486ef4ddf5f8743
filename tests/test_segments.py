"""Positional postings and the segmented index against plain Python and a rebuilt table."""

import random

import pytest

from loomtext.operators import segments as G


def corpus(spark, files):
    return spark.createDataFrame(list(files.items()), "file_id long, content string")


def rebuilt(spark, files):
    return sorted(map(str, G.positions(corpus(spark, files)).collect()))


def places(text, literal):
    return [i for i in range(len(text) - len(literal) + 1) if text.startswith(literal, i)]


def test_positions_decode(spark, monkeypatch):
    files = {1: "abcabcabc", 2: "", 3: "ab", 4: "é\U0001f600é\U0001f600é\U0001f600", 5: None, 6: "aaaaaa"}
    for r in G.positions(corpus(spark, files)).collect():
        at = [sum(r["deltas"][: i + 1]) for i in range(len(r["deltas"]))]
        assert at == places(files[r["file_id"]], r["trigram"])


def test_literal_positions_equal_a_scan(spark):
    rng = random.Random(1)
    files = {i: "".join(rng.choice("ab\n é") for _ in range(rng.choice([0, 3, 40, 400]))) for i in range(30)}
    index = G.positions(corpus(spark, files)).cache()
    for literal in ("aba", "abab", "aaaaa", "a b a", "bé\na", "zzz", "ab" * 6):
        got = sorted(map(tuple, G.literal_positions(index, literal).collect()))
        assert got == sorted((i, at) for i, t in files.items() for at in places(t, literal)), literal
    with pytest.raises(ValueError):
        G.literal_positions(index, "ab")


def test_long_files_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(G, "PIECE", 7)
    text = "hello world, hello again and hello"
    index = G.positions(corpus(spark, {1: text}).coalesce(1))
    assert sorted(r["start"] for r in G.literal_positions(index, "hello").collect()) == places(text, "hello")


def test_any_sequence_of_batches_equals_a_rebuild(spark, tmp_path):
    rng, files = random.Random(2), {}
    index = G.Segments(spark, str(tmp_path / "i"), buckets=4, fanout=2)
    assert index.read().count() == 0
    for step in range(6):
        batch = {rng.randrange(8): "".join(rng.choice("abc") for _ in range(rng.choice([2, 12]))) for _ in range(3)}
        gone = [i for i in rng.sample(range(8), 2) if i not in batch] if step % 2 else []
        index.add(corpus(spark, batch), corpus(spark, dict.fromkeys(gone, "")) if gone else None)
        files = {i: t for i, t in files.items() if i not in gone} | batch
        assert sorted(map(str, index.read().collect())) == rebuilt(spark, files)
        while index.merge():
            pass
        assert sorted(map(str, index.read().collect())) == rebuilt(spark, files)
    assert len(index.segments()) <= 3
    index.clean()
    assert sorted(map(str, index.read().collect())) == rebuilt(spark, files)
    want = sorted((i, at) for i, t in files.items() for at in places(t, "abc"))
    assert sorted(map(tuple, index.find("abc").collect())) == want


def test_a_batch_that_fails_leaves_the_index(spark, tmp_path):
    index = G.Segments(spark, str(tmp_path / "i"), buckets=2)
    index.add(corpus(spark, {1: "abcd"}))
    (tmp_path / "i" / "manifests" / "v2").mkdir()  # begun, never completed
    (tmp_path / "i" / "sbroken").mkdir()
    assert len(index.segments()) == 1 and index.read().count() == 2
    index.add(corpus(spark, {2: "bcde"}))
    assert sorted(r["file_id"] for r in index.find("bcd").collect()) == [1, 2]


def test_postings_are_not_shuffled_and_merged_segments_go(spark, tmp_path):
    from loomtext.plans import catalog_segments as Q

    index = G.Segments(spark, str(tmp_path / "i"), buckets=2, fanout=2)
    index.add(corpus(spark, {1: "abcd", 2: "bcde"}))
    index.add(corpus(spark, {2: "xbcd"}), corpus(spark, {3: ""}))
    rows = index.read()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert index.merge()
    assert sorted(map(str, index.read().collect())) == rebuilt(spark, {1: "abcd", 2: "xbcd"})
    index.add(corpus(spark, {}), corpus(spark, {1: ""}))
    assert sorted(map(str, index.read().collect())) == rebuilt(spark, {2: "xbcd"})
    index.clean()
    assert len([x for x in (tmp_path / "i").iterdir() if x.name.startswith("s")]) == 2
    made = []
    real = Q.G.Segments.__init__

    def seen(self, *args, **options):
        real(self, *args, **options)
        made.append(self)

    Q.G.Segments.__init__ = seen
    try:
        from places import SF

        Q.index_segments(spark, SF)
    finally:
        Q.G.Segments.__init__ = real
    fs, path = made[0]._fs(made[0].root)
    assert len([x for x in fs.listStatus(path) if x.getPath().getName().startswith("s")]) == len(made[0].segments())
