import zlib

import pytest
from common import documents, odd_rows

from loomtext.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and len(r["text"]) >= 40]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_fold_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    spoilt = docs.withColumn("lang", F.when(fold == 1, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs).collect()}
    assert a == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(spoilt).collect()}


def test_odd_rows(spark):
    rows = [(100 + i, "the cat sat on the mat and the dog ran", "en") for i in range(9)] + [(200 + i, "le chat est sur la table et le chien", "fr") for i in range(9)] + [(300, "12 34 !!", "en"), (301, "the dog", None)]
    docs = documents(spark, odd_rows() + rows)
    got = {r["doc_id"]: r for r in L.identify(docs).collect()}
    assert L.identify(docs).count() == docs.count()
    for doc in (1, 2, 3, 9, 300):
        assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0.0)
    assert got[301]["lang_pred"] == "en" and got[205]["lang_pred"] == "fr"
    assert L.identify(documents(spark, [])).count() == 0
    assert {r["lang_pred"] for r in L.identify(documents(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_pieces_lose_no_gram(monkeypatch):
    import numpy as np

    text = "Ab cd, efg! " * 40 + "déjà vu"

    def counts():
        total = np.zeros(1 << 12, np.int64)
        for rows, buckets in L.grams([text, None, "", text], (1, 2, 3), 12):
            assert set(rows.tolist()) <= {0, 3}
            total += np.bincount(buckets, minlength=1 << 12)
        return total

    whole = counts()
    monkeypatch.setattr(L, "PIECE", 50)
    assert (counts() == whole).all()


def test_scores_are_bayes(spark):
    import math

    model = L.fit(spark.createDataFrame([(1, "aab", "x"), (2, "bbb", "y"), (3, "bb", "y")], "key long, text string, lang string"), L.Params(orders=(1,), max_bits=8))
    grams = lambda t: [b for _, bs in L.grams([t], (1,), model.bits) for b in bs.tolist()]
    seen = {"x": grams("aab"), "y": grams("bbb") + grams("bb")}
    n = 1 << model.bits

    def log_joint(lang, prior, text):
        return math.log(prior) + sum(math.log((seen[lang].count(b) + 0.1) / (len(seen[lang]) + 0.1 * n)) for b in grams(text))

    for text in ("ab", "b", "aaab"):
        x, y = log_joint("x", 1 / 3, text), log_joint("y", 2 / 3, text)
        (lang, sure), = L.score(model, [text])
        assert lang == ("x" if x > y else "y")
        assert sure == pytest.approx(1 / (1 + math.exp(-abs(x - y))), abs=1e-4)


def test_long_runs_of_letters_lose_no_gram(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 105, n))) for n in (100, 49, 50, 51, 52, 53, 99, 149, 151)] + ["ab " + "x" * 120 + " cd", "日" * 130 + "!" + "é" * 70]

    def counts():
        total = np.zeros((len(texts), 1 << 12), np.int64)
        for rows, buckets in L.grams(texts, (1, 2, 3), 12):
            np.add.at(total, (rows, buckets), 1)
        return total

    whole = counts()
    assert whole[0].sum() == 100 + 101 + 100
    for piece in (50, 7, 51):
        monkeypatch.setattr(L, "PIECE", piece)
        assert (counts() == whole).all()
