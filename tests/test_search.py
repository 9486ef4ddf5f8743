import pytest
from pyspark.sql import functions as F

from loomtext.operators import index as I
from loomtext.operators import ranking as R
from loomtext.operators import search as S
from loomtext.plans import planner
from loomtext.sources import corpus as C

FILES = [(1, "src/a.go", "func Main() {\n// aaa comment\n\taaa := aaaa\n}"), (2, "docs/b.md", "é foo foobar\nFOO"), (3, "pkg/c_test.go", ""), (4, "x/d.py", None)]
ALL = S.Options(per_file=None)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file_id long, path string, content string")


def lines(rows):
    return [(r["path"], r["line"], r["n"]) for r in rows.orderBy("path", "line").collect()]


def test_literals_overlap_and_comments_are_skipped(files):
    assert lines(S.matching_lines(files, "aa", ALL)) == [("src/a.go", 3, 5)]
    assert lines(S.matching_lines(files, "aa", S.Options(skip_comments=False, per_file=None))) == [("src/a.go", 2, 2), ("src/a.go", 3, 5)]
    assert lines(S.matching_lines(files, "a{2}", S.Options(regex=True, per_file=None))) == [("src/a.go", 2, 1), ("src/a.go", 3, 3)]


def test_words_case_and_metacharacters(files):
    assert lines(S.matching_lines(files, "foo", S.Options(whole_word=True, per_file=None))) == [("docs/b.md", 1, 1)]
    assert lines(S.matching_lines(files, "foo", S.Options(ignore_case=True, per_file=None))) == [("docs/b.md", 1, 2), ("docs/b.md", 2, 1)]
    assert lines(S.matching_lines(files, "Main()", ALL)) == [("src/a.go", 1, 1)]


def test_inverted_and_limits(files):
    assert [x[:2] for x in lines(S.matching_lines(files, "a", S.Options(invert=True, per_file=None)))] == [("docs/b.md", 2), ("pkg/c_test.go", 1), ("src/a.go", 4)]
    assert len(lines(S.matching_lines(files, "a", S.Options(per_file=1)))) == 2


def test_positions_in_characters_and_bytes(files):
    hits = S.positions(S.matching_lines(files, "foo", ALL), "foo", ALL).orderBy("column").collect()
    assert [(r["column"], r["byte_column"], r["exact"]) for r in hits] == [(2, 3, True), (6, 7, False)]
    o = S.Options(regex=True, per_file=None)
    hits = S.positions(S.matching_lines(files, "fo+", o), "fo+", o).orderBy("column").collect()
    assert [r["column"] for r in hits] == [2, 6]
    hits = S.positions(S.matching_lines(files, "aa", ALL), "aa", ALL).orderBy("column").collect()
    assert [r["column"] for r in hits] == [1, 2, 8, 9, 10]


def test_index_prunes_without_losing(files):
    grams = I.trigrams(files)
    assert [r[0] for r in I.candidates(grams, "FOOBAR").collect()] == [2]
    assert lines(S.by_trigrams(files, grams, "foobar", ALL)) == lines(S.matching_lines(files, "foobar", ALL))
    assert I.without(grams, files.where("file_id = 2").select("file_id")).where("file_id = 2").count() == 0


def test_index_on_disk(spark, files, tmp_path):
    I.write_trigrams(I.trigrams(files), str(tmp_path / "t"), 4)
    assert spark.read.parquet(str(tmp_path / "t")).select("trigram", "file_id").exceptAll(I.trigrams(files)).count() == 0


def test_regex_classes(spark):
    asked = {"(a(b))": (False, True, True), "(?=a)": (False, True, False), "((((((a))))))": (False, True, False), "(a": (False, False, False), "a)b(": (False, False, False), r"\(a": (False, False, True), "abc def": (True, False, True), "a.c": (False, False, True), "foo.*": (False, True, True), "|".join("abcdefghijkl"): (False, True, False)}
    rows = spark.createDataFrame([(p,) for p in asked], "p string").select("p", S.literal_pattern(F.col("p")), S.regex_like(F.col("p")), S.simple_pattern(F.col("p"))).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == asked
    assert S.is_literal("abc def") and not S.is_literal("a.c")


def test_query_fields():
    pattern, o = planner.parse("needle ext:go dir:src path:*.md")
    assert pattern == "needle" and o.include == (r"\.go$", r"(^|/)src/", "*.md")
    assert not planner.plan("abc", S.Options(regex=True)).options.regex
    assert planner.plan("abc", index_at_hand=True).use_index and not planner.plan("ab", index_at_hand=True).use_index
    with pytest.raises(ValueError):
        planner.plan("x" * 1001)


def test_planned_search(files):
    assert lines(planner.run(files, "aaa ext:go", ALL)) == [("src/a.go", 3, 3)]
    assert lines(planner.run(files, "aaa", ALL, I.trigrams(files))) == [("src/a.go", 3, 3)]


def test_scores(spark, files):
    symbols = spark.createDataFrame([(1, 1, "function")], "file_id long, line long, type string")
    rows = R.scored(S.matching_lines(files, "Main", ALL), "Main", symbols)
    # 10 + exact 100 + definition 1000 + symbol 500 + function 200 + code line 1 - depth .5 + code file 50
    assert rows.first()["score"] == 1860.5
    best = R.boosted(spark.createDataFrame([("p", 1, 2.0), ("p", 1, 3.0), ("q", 1, 1.0)], "path string, line int, score double"), ["path", "line"])
    assert {r["path"]: r["score"] for r in best.collect()} == {"p": 3.45, "q": 1.0}


def test_merged_results(spark):
    a = spark.createDataFrame([("p", 1, "x", 2.0)], "path string, line int, text string, score double")
    b = spark.createDataFrame([("p", 1, "x", 9.0), ("p", 2, "y", 4.0)], "path string, line int, text string, score double")
    assert sorted(r["score"] for r in S.merged(a, b).collect()) == [2.0, 2.0]


def test_directory_scan(spark, tmp_path):
    for name, content in {"a.go": b"package a", "sub/b.py": b"x = 1", "sub/c.png": b"text", ".git/config": b"x", "sub/bin.dat": b"\x00\x01", "skip.log": b"l"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = C.scan_directory(spark, str(tmp_path), ignore_lines=["*.log"]).collect()
    assert {r["path"]: r["content"] for r in rows} == {"a.go": "package a", "sub/b.py": "x = 1"}


def test_offsets(files):
    got = [(r["line"], r["offset"]) for r in C.with_offsets(C.lines(files.where("file_id = 2"))).orderBy("line").collect()]
    assert got == [(1, 0), (2, 14)]


def test_commit_log(spark):
    text = ["abcdef1|Ann|a@x|1700000000|first | with pipe", "3\t1\tsrc/a.go", "-\t-\timg.png", "", "abcdef2|Bob|b@x|1700000100|second", "1\t1\tsrc/{old => new}/b.go", "0\t0\tx.go => y.go"]
    rows = C.commit_log(spark.createDataFrame(list(enumerate(text)), "no long, value string")).orderBy("ts").collect()
    assert [r["author"] for r in rows] == ["Ann", "Bob"] and rows[0]["message"] == "first | with pipe"
    assert [(c["path"], c["old_path"], c["added"]) for c in rows[1]["changes"]] == [("src/new/b.go", "src/old/b.go", 1), ("y.go", "x.go", 0)]
    assert rows[0]["changes"][1]["added"] == 0


def test_name_status(spark):
    rows = C.name_status(spark.createDataFrame([("M\ta.go",), ("R100\tx.go\ty.go",), ("A\tb",)], "value string")).collect()
    assert [tuple(r) for r in rows] == [("modified", "a.go", None), ("renamed", "y.go", "x.go"), ("added", "b", None)]
    assert [C.diff_size(n) for n in (9, 10, 50, 51)] == ["small", "medium", "medium", "large"]


def test_blocks_are_not_broadcast_by_their_estimated_size(spark):
    from loomtext.operators import extraction as X

    files = spark.range(3).selectExpr("id AS file_id", "concat('p/f', id, '.py') AS path", "'def a(x):\\n    if x:\\n        say(x)\\nsay(1)\\n' AS content")
    rows = R.block_context(C.lines(files), S.matching_lines(files, "say", ALL), X.symbols(files))
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    found = sorted((r["file_id"], r["line"], r["symbol"], r["start_line"], r["end_line"], r["text"]) for r in rows.collect())
    body = "def a(x):\n    if x:\n        say(x)"
    assert found == [x for i in range(3) for x in ((i, 3, "a", 1, 3, body), (i, 4, None, 2, 6, "    if x:\n        say(x)\nsay(1)\n"))]


def test_symbols_of_scores_are_not_broadcast_by_their_estimated_size(spark):
    from loomtext.operators import extraction as X

    files = spark.range(3).selectExpr("id AS file_id", "concat('p/f', id, '.go') AS path", "'package p\\nfunc Main() {\\n}\\n' AS content")
    found = X.symbols(files).select("file_id", F.col("line").cast("long").alias("line"), F.col("kind").alias("type"))
    rows = R.scored(S.matching_lines(files, "func Main", ALL), "func Main", found)
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["line"] for r in rows.collect()] == [2, 2, 2]
