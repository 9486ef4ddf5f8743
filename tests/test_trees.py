"""Folder trees, reach sketches, deep expansion and impact of duplicate groups against plain code."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import context as X
from loomtext.operators import duplicates as D
from loomtext.operators import graph as G
from loomtext.sources import tree as T


@pytest.fixture
def tree(tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    put(".gitignore", "*.log\nbuild/\n!keep.log\n/top.txt\nall/*\n!all/this.py\n")
    put("a.py", "x = 1\n")
    put("top.txt", "no")
    put("keep.log", "kept")
    put("b.log", "no")
    put("build/out.py", "no")
    put("build/.gitignore", "!out.py\n")  # never read
    put("src/top.txt", "here")
    put("src/deep/er/c.go", "package c\n")
    put("src/deep/.ignore", "*.tmp.go\n!b.log\n")
    put("src/deep/x.tmp.go", "no")
    put("src/x.tmp.go", "yes")
    put("src/deep/b.log", "taken back")
    put("src/build", "a file of that name")
    put("all/this.py", "y")
    put("all/that.py", "no")
    put("empty.py", "")
    put("raw.py", b"\x00\x01")
    put("pic.png", b"x")
    put(".hidden/h.py", "h")
    (tmp_path / "src" / "loop").symlink_to(tmp_path / "src", target_is_directory=True)
    (tmp_path / "nothing").mkdir()
    return tmp_path


def test_nested_ignore_files(spark, tree):
    got = {r["path"] for r in T.listing(spark, str(tree)).collect()}
    assert got == {".gitignore", "a.py", "keep.log", "src/top.txt", "src/deep/er/c.go", "src/deep/.ignore", "src/x.tmp.go", "src/deep/b.log", "src/build", "all/this.py", "empty.py", "raw.py", "pic.png", ".hidden/h.py"}


def test_scan_reads_admitted_files(spark, tree):
    rows = {r["path"]: r["content"] for r in T.scan(spark, f"file://{tree}", exclude=["all/**"], max_bytes=15).collect()}
    assert rows == {"a.py": "x = 1\n", "keep.log": "kept", "src/top.txt": "here", "src/deep/er/c.go": "package c\n", "src/x.tmp.go": "yes", "src/deep/b.log": "taken back", "empty.py": ""}


def test_missing_root_and_vanished_files(spark, tree):
    assert T.listing(spark, str(tree / "not-there")).count() == 0
    files = T.listing(spark, str(tree)).where("path in ('a.py', 'keep.log')")
    (tree / "a.py").unlink()
    assert [r["path"] for r in T.contents(files, str(tree)).collect()] == ["keep.log"]


def test_changes(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = lambda *xs: spark.createDataFrame([(p, n, t + datetime.timedelta(seconds=s)) for p, n, s in xs], "path string, length long, modified timestamp")
    got = T.changes(rows(("same", 1, 0), ("gone", 1, 0), ("size", 1, 0), ("time", 1, 0)), rows(("same", 1, 0), ("size", 2, 0), ("time", 1, 1), ("new", 1, 0)))
    assert {tuple(r) for r in got.collect()} == {("gone", "remove"), ("size", "write"), ("time", "write"), ("new", "create")}


def reached(edges, start):
    seen, left = set(), [start]
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    while left:
        for b in after.get(left.pop(), []):
            if b not in seen:
                seen.add(b)
                left.append(b)
    return seen


def test_reach_is_exact_on_small_graphs(spark):
    edges = [(1, 2), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (7, 8), (8, 7), (9, 9), (10, 11), (1, 2), (None, 3), (3, None)]
    rows = spark.createDataFrame(edges, "source long, target long")
    got = dict(map(tuple, G.reach_estimates(rows).collect()))
    whole = [e for e in edges if None not in e]
    assert got == {a: len(reached(whole, a)) for a, _ in whole}
    assert dict(map(tuple, G.reach_estimates(rows, max_depth=2).collect()))[1] == 2
    assert G.reach_estimates(rows.limit(0)).count() == 0


def test_reach_error_is_bounded(spark):
    rng = random.Random(5)
    edges = [(i, rng.randrange(6000)) for i in range(6000) for _ in range(2)]
    got = dict(map(tuple, G.reach_estimates(spark.createDataFrame(edges, "source long, target long"), lg_k=10).collect()))
    for i in range(0, 6000, 600):
        n = len(reached(edges, i))
        assert n > 1000 and abs(got[i] - n) <= 4 * 1.04 / 32 * n


def test_expanded_calls(spark):
    edges = spark.createDataFrame([(1, 2, "call"), (2, 3, "call"), (3, 1, "call"), (3, 4, "call"), (5, 2, "type"), (6, 4, "call"), (4, None, "call")], "source long, target long, type string")
    refs = spark.createDataFrame([("r", 2), ("r", 3), ("s", 2), ("t", None), (None, 1)], "ref_id string, symbol_id long")
    got = {tuple(r) for r in X.expanded_calls(refs, edges, "callees", 2).collect()}
    assert got == {("r", 1, "callees", 1), ("r", 4, "callees", 1), ("s", 3, "callees", 1), ("s", 1, "callees", 2), ("s", 4, "callees", 2)}
    assert {tuple(r) for r in X.expanded_calls(refs, edges, "callers", 9).where("ref_id = 's'").collect()} == {("s", 1, "callers", 1), ("s", 3, "callers", 2)}


def test_group_impact(spark):
    rows = [("a", "f1", 10, 4, "function"), ("a", "f2", 11, 7, "method"), ("b", "f1", 60, 20, "function"), ("b", "f1", 50, 1, "function"), ("c", "x", 5, 1, "function"), (None, "x", 1, 1, "function"), (None, "x", 1, 1, "function"), ("d", None, None, None, None), ("d", None, 1, 1, "function")]
    rows += [("e", f"p{i}", 1, 1, "method") for i in range(6)] + [("f", "p", 26, 1, "class")] * 2
    got = {r["hash"]: tuple(r)[1:] for r in D.group_impact(spark.createDataFrame(rows, "hash string, path string, n_lines int, cc int, kind string").withColumn("fits", F.lit(1))).collect()}
    assert got == {"a": (2, 21, 2, "low", round(1 / 1.521, 6), True), "b": (2, 110, 1, "high", round(1 / 2.11, 6), False), "d": (2, 1, 0, "low", round(1 / 1.001, 6), False), "e": (6, 6, 6, "critical", round(1 / 1.106, 6), True), "f": (2, 52, 1, "medium", round(1 / 1.152, 6), False)}
