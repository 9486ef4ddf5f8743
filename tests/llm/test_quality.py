from collections import Counter

import numpy as np
from common import documents, multiset, odd_rows, words

from loomtext.llm import quality as Q
from loomtext.llm.vocabularies import byte_level, pieces


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def test_base_measures_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += odd_rows() + [(900, "a b c d e f\x1cg a b c d e\n a b c d e"), (901, "x y   z\n\n\t\nx y   z")]
    got = [tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in Q.judge_all([r[1] for r in rows], ["en"] * len(rows), Q.Params())]
    assert got == [base(r[1]) for r in rows]


def test_measures_against_the_libraries(spark):
    p = Q.Params()
    text = "The quick brown fox — jumps über den Zaun 123 日本語 and more words of every kind"
    (row,) = Q.judge_all([text], ["en"], p)
    plain, (encode, fallback) = byte_level(p.byte_vocabulary).plain, pieces(p.piece_vocabulary)
    ids = [i for w in words(text) for i in plain(" " + w)]
    own = [i for w in words(text) for i in encode(w)]
    chars = sum(map(len, words(text)))
    share = np.array(list(Counter(ids).values())) / len(ids)
    assert row["chars_per_token"] == round(chars / len(ids), 6)
    assert row["chars_per_piece"] == round(chars / len(own), 6)
    assert row["byte_share"] == round(sum(bool(fallback[i]) for i in own) / len(own), 6)
    assert row["entropy"] == round(float(-(share * np.log2(share)).sum() / np.log2(len(ids))), 6)


def fitted(spark, sf="sf0.01"):
    read = lambda t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    return Q.fit(read("documents"), read("labels"))


def test_scripts_and_the_limits_where_nothing_is_fitted():
    p = Q.Params()
    odd = " ".join(f"x{i}q%%z{i * 7}" for i in range(200))
    (row,) = Q.judge_all([odd], ["en"], p)
    assert not row["base_failed"] and not row["kept"] and "chars_per_piece" in row["reason"]
    assert [Q.script_of(t) for t in ("abc", "привет мир", "日本語の文", "123", "שלום")] == ["latin", "cyrillic", "han", "other", "hebrew"]
    assert p.limits("xx", "latin", 9) == Q.WIDE_LATIN and p.limits("xx", "han", 9) == Q.WIDE


def test_limits_widen_steadily():
    line = Q.Line(2.0, 0.0, 0.1, 100.0)
    at = [line.around(n, 3.0, 0.0)[0] for n in (1, 5, 20, 95, 96, 97, 1000, 10**6)]
    assert at == sorted(at) and abs(at[3] - at[4]) < 0.01 and abs(at[-1] - 1.7) < 0.001


def test_equally_long_texts_fit_their_mean(spark):
    rng = __import__("random").Random(4)
    words = "the house near river stands while people walk under old trees every morning before work".split()
    texts = [" ".join(rng.sample(words, len(words))) for _ in range(40)]
    docs = documents(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    p = Q.fit(docs, labels)
    assert p.by_lang["en"]["chars_per_token"].slope == 0 and p.by_lang["en"]["chars_per_token"].intercept > 3
    assert Q.measure(docs, p).where("kept").count() == 40


def test_random_letters_fail_and_unfitted_languages_have_wider_bands(spark):
    rng, p = __import__("random").Random(6), fitted(spark)
    junk = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 10))) for _ in range(n))
    for n, least in ((10, 30), (15, 34), (30, 36), (200, 40)):
        assert sum(not r["kept"] for r in Q.judge_all([junk(n) for _ in range(40)], ["en"] * 40, p)) >= least, n
    own, other = p.limits("en", "latin", 500)["entropy"], p.limits("xx", "latin", 500)["entropy"]
    assert other[0] < own[0]


def test_the_fit_matches_a_plain_regression(spark):
    import math

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.fit(docs, labels).by_lang["en"]["entropy"]
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    rows = [r for r in docs.where("lang = 'en'").collect() if r["doc_id"] in good]
    judged = [j for j in Q.judge_all([r["text"] for r in rows], [None] * len(rows), Q.Params()) if not j["base_failed"]]
    x, y = np.array([math.log2(max(2, j["n_tokens"])) for j in judged]), np.array([j["entropy"] for j in judged])
    slope, intercept = np.polyfit(x, y, 1)
    spread = math.sqrt(((y - intercept - slope * x) ** 2).sum() / (len(x) - 2))
    assert np.allclose((got.intercept, got.slope, got.spread), (intercept, slope, spread), atol=1e-6)
    assert abs(got.typical - np.mean([j["n_tokens"] for j in judged])) < 1e-6


def test_each_measure_rejects_its_case(spark):
    import random

    rng, p = random.Random(2), fitted(spark)
    assert {"de", "en", "es", "fr"} <= set(p.by_lang) and "latin" in p.by_script
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("quality = 1 and lang = 'en' and n_chars > 2000")
    words = docs.first()["text"].split()
    junk = " ".join("".join(rng.choice("bcdfghjkqvwxz0123456789") for _ in range(rng.randint(4, 9))) for _ in range(300))
    few = " ".join(rng.choice(words[:6]) for _ in range(400))
    foreign = " ".join(w if i % 3 else "ក្ខ" for i, w in enumerate(words[:300]))
    cases = {"chars_per_token": junk, "chars_per_piece": junk, "entropy": few, "byte_share": foreign}
    for measure, text in cases.items():
        for lang in ("en", None):
            (row,) = Q.judge_all([text], [lang], p)
            assert measure in row["reason"].split(",") and not row["kept"], (measure, lang, row)
    short = [Q.judge_all([" ".join(junk.split()[:n])], ["en"], p)[0]["kept"] for n in range(12, 60)]
    assert not any(short[i] and not short[i - 1] for i in range(1, len(short))) or sum(short) < 5


def test_good_labelled_texts_stay_and_bad_ones_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.measure(docs, fitted(spark)).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg({"*": "count", "kept": "max"}).collect()
    assert {r["quality"] for r in rows} == {0, 1}
    judged = [(r["quality"], r["kept"]) for r in Q.measure(docs, fitted(spark)).where("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()]
    share = {q: sum(k for x, k in judged if x == q) / sum(x == q for x, _ in judged) for q in (0, 1)}
    assert share[1] > 0.98 and share[0] < 0.5, share


def test_frames(spark):
    docs = documents(spark, odd_rows())
    out = Q.measure(docs)
    assert out.count() == docs.count()
    first = out.where("doc_id = 1").first()
    assert first["n_words"] == 0 and first["base_failed"] and not first["kept"] and first["entropy"] is None
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert Q.measure(documents(spark, [])).count() == 0 and Q.keep_good(documents(spark, [])).count() == 0


def test_every_good_text_is_fitted(spark):
    """12,000 good texts, 30 of them, just enough, of a language of their own: bands come from every one."""
    rng = __import__("random").Random(11)
    words = "the house near river stands while people walk under old trees every morning before work and rain".split()
    texts = [(i, " ".join(rng.sample(words, rng.randint(10, 16))), "xx" if i % 400 == 7 else "en") for i in range(12_000)]
    labels = spark.createDataFrame([(i, 1) for i, _, _ in texts], "doc_id long, quality int")
    p = Q.fit(documents(spark, texts), labels)
    assert "xx" in p.by_lang
    for lang in ("en", "xx"):
        own = [t for _, t, x in texts if x == lang]
        judged = Q.judge_all(own, [lang] * len(own), Q.Params())
        assert abs(p.by_lang[lang]["entropy"].typical - np.mean([j["n_tokens"] for j in judged])) < 1e-9


def test_texts_measured_once_are_judged_alike(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in read("documents").collect()]
    good = next(t for _, t, _ in rows if len(words(t)) > 50)
    rows += [(*r, "en") for r in odd_rows()] + [(rows[0][0], good, "en"), (None, good, None), (None, good, "en"), (None, "short", "zz"), (-1, None, good)]
    docs, labels = documents(spark, rows), read("labels")
    fitted = Q.fit(docs, labels)
    want, got = Q.measure(docs, fitted), Q.judge(docs, labels)
    assert got.columns == want.columns and multiset(got.collect()) == multiset(want.collect())
    kept = multiset(Q.keep_good(docs, fitted).collect())
    assert 0 < sum(kept.values()) < len(rows)
    for limit in (500_000, 0):
        out = Q.keep_judged(docs, labels, Q.Params(broadcast_rows=limit))
        assert out.columns == docs.columns and multiset(out.collect()) == kept
    none = documents(spark, [])
    assert Q.judge(none, labels).count() == 0 and Q.keep_judged(none, labels).count() == 0
    assert Q.judge(docs, labels.limit(0)).where("kept").count() == Q.keep_good(docs).count()
