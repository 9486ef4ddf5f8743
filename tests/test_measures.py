import datetime as dt

from pyspark.sql import functions as F

from loomtext.operators import duplicates as D
from loomtext.operators import exploration as E
from loomtext.operators import history as H
from loomtext.operators import measures as Q


def test_effects_start_at_two(spark):
    rows = spark.createDataFrame([(0,), (2,), (4,), (8,), (64,), (66,)], "mask int")
    assert [r[0] for r in rows.select(Q.purity_level(F.col("mask"))).collect()] == [1, 2, 3, 4, 5, 5]
    assert rows.where("mask = 66").select(Q.effect_names(F.col("mask"))).first()[0] == ["param_write", "io"]


def test_percentiles_count_ties(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, 3.0)], "id int, s double")
    assert {r["id"]: r["percentile"] for r in Q.percentiles(rows, "s").collect()} == {1: 50.0, 2: 50.0, 3: 75.0, 4: 100.0}


def test_window_edge_counts(spark):
    end = dt.datetime(2024, 1, 31)
    rows = spark.createDataFrame([("a", 1, end - dt.timedelta(days=7), 1.0), ("a", 1, end - dt.timedelta(days=7, seconds=1), 1.0), ("a", 2, end, 1.0)], "path string, author long, ts timestamp, lines double")
    assert H.in_window(rows, "2024-01-31 00:00:00", "7d").count() == 2
    got = H.collisions(rows, "2024-01-31 00:00:00", "30d").first()
    assert (got["n_authors"], got["recent"], got["ratio"]) == (2, 3, 0.5)
    assert H.days("nonsense") == 30


def test_churn_filter(spark):
    rows = spark.createDataFrame([("a.go",), ("go.sum",), ("vendor/x.go",), ("b.min.js",)], "path string")
    assert [r["path"] for r in rows.where(H.churn_kept(F.col("path"))).collect()] == ["a.go"]


def test_anti_patterns(spark):
    rows = spark.createDataFrame([("a.go", "x.Register(y)\n" * 21), ("b.go", "ok"), ("c.go", "\n" * 1500), ("index.ts", "export a\n" * 12), ("settings.py", "a = 1\n" * 10)], "path string, content string")
    got = {(r["path"], r["pattern"]): r["severity"] for r in H.anti_patterns(rows).collect()}
    assert got["a.go", "registration"] == "critical" and ("c.go", "god_object") in got and ("index.ts", "barrel") in got and ("settings.py", "config") in got
    assert not any(p == "b.go" for p, _ in got)


def test_structural_duplicates(spark):
    rows = spark.createDataFrame([(1, "if foo { bar() }"), (2, "if baz { qux() } "), (3, "x"), (4, "x")], "id long, text string")
    got = D.structural_only(rows).collect()
    assert [(r["n"], r["first"]) for r in got] == [(2, 1)]
    assert [(r["n"], r["first"]) for r in D.clusters(rows, D.exact_hash(F.col("text"))).collect()] == [(2, 3)]


def test_new_against_old_loses_no_pair(spark):
    import random

    rnd = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.sample(words, 12) if i % 3 else words[:12] + rnd.sample(words[12:], 1))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r["new_id"], r["old_id"]) for r in D.new_against_old(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 0.8, 10_000).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a % 2 == 0 and b % 2 == 1 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got == want and want


def test_fragments():
    assert "password-reset" in D.fragments_of("user_password-reset") and "reset" in D.fragments_of("user_password-reset")
    assert D.fragments_of('<div class="main">Hello</div>') == ["main", "Hello"]


def test_listing(spark):
    rows = spark.createDataFrame([("f", "function", "a.go", 1, True, 5), ("g", "method", "a.go", 2, False, 9), ("main", "function", "b.go", 1, False, 1)], "name string, kind string, path string, line int, exported boolean, cc int")
    assert [r["name"] for r in E.list_symbols(rows, kind="fn,meth", sort="complexity").collect()] == ["g", "f", "main"]
    assert E.list_symbols(rows, kind="all").count() == 3
    assert {(r["name"], r["why"]) for r in E.entry_points(rows).collect()} == {("main", "main"), ("f", "exported")}


def test_manifest_round_trip(spark, tmp_path):
    refs = spark.createDataFrame([(1, 1, "primary", 1, 2), (2, 1, "test", 2, 9)], "ref_id long, file_id long, role string, start int, `end` int")
    E.save_manifest(refs, str(tmp_path / "m"))
    back = E.load_manifest(spark, str(tmp_path / "m"))
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "file_id long, line long, text string")
    assert {r["ref_id"]: r["text"] for r in E.hydrate(back, lines).collect()} == {1: "a\nb", 2: "b"}
    assert E.manifest_stats(back).first()["n_lines"] == 10


def test_cluster_similarity_is_exact_for_large_groups(spark):
    import random

    rng = random.Random(1)
    texts = [(i, " ".join(rng.sample("abcdefgh", rng.randrange(0, 6))), "g" if i < 200 else "h") for i in range(210)]
    rows = spark.createDataFrame(texts, "id long, text string, hash string")
    got = {r["hash"]: r["similarity"] for r in D.cluster_similarity(rows).collect()}
    for group in "gh":
        sets = [set(t.split()) for _, t, h in texts if h == group]
        pairs = [len(a & b) / max(1, len(a | b)) for i, a in enumerate(sets) for b in sets[:i]]
        assert abs(got[group] - sum(pairs) / len(pairs)) < 1e-5


def test_new_against_old_finds_every_pair(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[j % 7 :: 1 + j % 3][: 9 + j % 5]) for j in range(60)] + ["", "", "...", "...", "// x", "a b", "a  b", "b a"]
    rows = [(i, t) for i, t in enumerate(texts)]
    tok = {i: {x for x in t.split() if x[0] in "wab"} for i, t in rows}
    form = {i: "" if t.startswith("//") else t for i, t in rows}
    want = {}
    for a in tok:
        for b in tok:
            if a % 2 == 0 and b % 2 == 1:
                share = len(tok[a] & tok[b]) / max(1, len(tok[a] | tok[b]))
                if form[a] == form[b] or share >= 0.8:
                    want[a, b] = 1.0 if form[a] == form[b] else round(share, 6)
    df = spark.createDataFrame(rows, "id long, text string")
    new, old = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    assert {(r["new_id"], r["old_id"]): r["similarity"] for r in D.new_against_old(new, old).collect()} == want
    first = sorted(want, key=lambda p: (-want[p], p))
    for k in (5, len(want) - 1):
        assert [(r["new_id"], r["old_id"]) for r in D.new_against_old(new, old, k=k).collect()] == first[:k]
