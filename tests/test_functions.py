import pytest
from pyspark.sql import functions as F

from loomtext.functions import matching as M
from loomtext.functions import names as N
from loomtext.functions import paths as P


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    ("name", "words"),
    [("HTTPServer", ["http", "server"]), ("parseHTTPResponse", ["parse", "http", "response"]), ("getUserV2", ["get", "user", "v", "2"]), ("snake_case-name.x/y", ["snake", "case", "name", "x", "y"]), ("ÉtéSoleil", ["été", "soleil"]), ("", [])],
)
def test_split(spark, name, words):
    assert one(spark, name, N.split(F.col("x")))[0] == words


@pytest.mark.parametrize(("name", "style"), [("a_b", "snake"), ("A_B", "screaming"), ("a-b", "kebab"), ("AbC", "pascal"), ("aB", "camel"), ("abc", "unknown"), ("", "unknown")])
def test_case_style(spark, name, style):
    assert one(spark, name, N.case_style(F.col("x")))[0] == style


@pytest.mark.parametrize(("name", "code"), [("Robert", "r163"), ("", ""), ("a", "a000"), ("Ashcraft", "a226"), ("ssss", "s200"), ("bab", "b100")])
def test_phonetic(spark, name, code):
    assert one(spark, name, N.phonetic(F.col("x")))[0] == code


def test_base63_round_trip(spark):
    rows = spark.createDataFrame([(0, 0), (62, 0), (63, 0), (1, 1), (2**31 - 1, 2**30)], "f long, l int").select("f", "l", N.composite_id(F.col("f"), F.col("l")).alias("c"))
    for r in rows.withColumn("d", N.decode63(F.col("c"))).collect():
        assert r["d"] == r["f"] + (r["l"] << 32)
        assert r["c"] == "A" or not r["c"].startswith("A")
    assert one(spark, "a-b", N.decode63(F.col("x")))[0] is None


def test_expand(spark):
    got = one(spark, "auth", N.expand(F.col("x")))[0]
    assert got[0] == "auth" and "login" in got and len(got) == len(set(got))
    assert one(spark, "context", N.expand(F.col("x")))[0] == ["context", "ctx"]
    assert one(spark, "zzz", N.expand(F.col("x")))[0] == ["zzz"]


@pytest.mark.parametrize(("word", "stem"), [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("hopping", "hop"), ("hoping", "hope"), ("generalization", "general"), ("conditional", "condit"), ("happily", "happili"), ("skis", "ski"), ("news", "news"), ("api", "api"), ("consistency", "consist"), ("agreed", "agre"), ("plastered", "plaster"), ("cry", "cri"), ("by", "by"), ("say", "say"), ("relational", "relat"), ("hopefulness", "hope"), ("knightly", "knight"), ("electricity", "electr"), ("adjustment", "adjust")])
def test_stems(word, stem):
    assert M.stem_of(word) == stem


def test_jaro_winkler():
    assert M.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert M.jaro_winkler_of("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    assert M.jaro_winkler_of("", "a") == 0.0 and M.jaro_winkler_of("a", "a") == 1.0


def test_phrases():
    score = lambda q, t: M.phrase_score(q, t, N.ABBREVIATIONS, [set(v) for v in N.DOMAINS.values()])
    assert score(["user", "config"], ["user", "config"]) > score(["user", "config"], ["config", "user"]) > score(["user", "config"], ["user", "zzz"]) > 0
    assert score(["db"], ["database"]) > 0 and score([], ["a"]) == 0 and score(["xq"], ["zw"]) == 0


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.go", "a/b.go", True), ("src/**/*.go", "src/b.go", True), ("src/**/*.go", "src/x/y/b.go", True), ("src/*.go", "src/x/b.go", False), ("{a,b}.js", "b.js", True), ("a?.js", "ab.js", True), ("[!a].js", "b.js", True), ("[!a].js", "a.js", False)])
def test_globs(spark, glob, path, hit):
    assert one(spark, path, P.matches_glob(F.col("x"), glob))[0] is hit


def test_last_ignore_rule_wins(spark):
    rules = ["*.log", "!keep.log", "build/", "# no", "", "/root.txt"]
    got = [one(spark, p, P.ignored(F.col("x"), rules))[0] for p in ("a.log", "x/keep.log", "build/a/b", "root.txt", "x/root.txt")]
    assert got == [True, False, True, True, False]


def test_binary(spark):
    rows = spark.createDataFrame([(bytes([0x89]) + b"PNG",), (b"plain text",), (b"zero\x00byte",), (b"",)], "c binary")
    assert [r[0] for r in rows.select(P.is_binary_content(F.col("c"))).collect()] == [True, False, True, False]
    assert one(spark, "a/x.MIN.js", P.is_binary_name(F.col("x")))[0] is False
