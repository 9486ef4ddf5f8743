import random

from common import documents, odd_rows, words

from loomtext.llm import near_dups as N


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, k, percent=80):
    sets = {}
    for doc, text in rows:
        w = words(low(text))
        s = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets.setdefault(doc, set()).add(s)
    comp = {d: d for d in sets if d is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(comp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: find(d) for d in comp}


def got(spark, rows, params):
    return [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.classes(documents(spark, rows), params).collect()]


def check(spark, rows, params):
    rows_out = got(spark, rows, params)
    assert sorted(x[0] is None or x[0] for x in rows_out) == sorted(x[0] is None or x[0] for x in rows)
    want = brute([(r[0], r[1]) for r in rows], params.shingle)
    for doc, _, comp, kept in rows_out:
        if doc is None:
            assert comp is None and kept
        elif comp != doc or want[doc] != doc:
            assert comp == want[doc], (doc, comp, want[doc])
            assert kept == (doc == comp)


def test_odd_rows(spark):
    check(spark, odd_rows(), N.Params(shingle=4))


def test_empty(spark):
    assert got(spark, [], N.Params()) == []
    assert N.keep_first(documents(spark, []), N.Params()).count() == 0


def test_chains_and_groups_against_brute_force(spark):
    rnd = random.Random(3)
    rows, doc = [], 0
    for group in range(12):
        base = [f"g{group}w{rnd.randrange(10**6)}" for _ in range(rnd.choice([12, 40, 90, 200]))]
        for _ in range(rnd.choice([1, 2, 15])):
            text = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 8])):
                text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**6)}"
            if rnd.random() < 0.3:
                base = text  # a chain drifts away from its start
            rows.append((doc, " ".join(text)))
            doc += 1
    rnd.shuffle(rows)
    check(spark, rows, N.Params(shingle=4))
    check(spark, rows, N.Params(shingle=5, pivot_rounds=1))
    check(spark, rows, N.Params(shingle=4, pivot_rounds=0, hot=5, block=4))


def test_the_estimate_follows_the_similarity(spark):
    import numpy as np

    p = N.Params()
    a = N._multipliers(p.bands * p.rows)
    rng = np.random.default_rng(1)
    for true in (0.5, 0.8, 0.95):
        n = 4000
        shared = rng.integers(0, 2**63, int(n * true), dtype=np.uint64)
        x = np.concatenate([shared, rng.integers(0, 2**63, (n - len(shared)) // 2, dtype=np.uint64)])
        y = np.concatenate([shared, rng.integers(0, 2**63, (n - len(shared)) // 2, dtype=np.uint64)])
        rows = spark.createDataFrame([(N.pack(N.minima(x, a), p.bits).tolist(), N.pack(N.minima(y, a), p.bits).tolist())], "a array<long>, b array<long>")
        assert abs(rows.select(N.estimate(rows.a, rows.b, p)).first()[0] - true) < 0.12


def test_keep_first_keeps_columns_and_one_of_each_group(spark):
    docs = documents(spark, odd_rows())
    out = N.keep_first(docs, N.Params())
    assert out.columns == docs.columns
    ids = sorted(r["doc_id"] for r in out.where("doc_id is not null").collect())
    assert ids == [1, 2, 3, 4, 6, 7, 9, 11, 12]  # 8 equals 7 in lower case, 10 is near 4
    assert out.where("doc_id is null").count() == 2


def test_keys_of_most_rows_are_salted(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, base) for i in range(40)] + [(i, "") for i in range(40, 70)] + [(i, None) for i in range(70, 90)] + [(90, base.replace("w39", "other"))]
    check(spark, rows, N.Params(shingle=4, hot=3))


def test_of_rows_with_one_doc_id_the_smallest_stays(spark):
    rows = [(1, "b c d e f g", "y", {"k": 1}), (1, "a b c d e f", "z", {"k": 2}), (1, "a b c d e f", "x", {"k": 3}), (2, None, "n", None), (2, "only two words", "m", None), (None, "t", "u", None), (None, "t", "u", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, extra map<string, int>")
    for parts in (1, 3, 7):
        out = N.keep_first(docs.repartition(parts)).collect()
        assert sorted((str(r["doc_id"]), str(r["text"]), r["a.b"], str(r["extra"])) for r in out) == [("1", "a b c d e f", "x", "{'k': 3}"), ("2", "None", "n", "None"), ("None", "t", "u", "None"), ("None", "t", "u", "None")]
