"""Embedding whitening against a dense eigendecomposition, and its defined cases."""

import numpy as np
import pytest
from places import SF

from loomtext.llm import queries, whitening
from loomtext.runtime import table

SCHEMA = "vec_id long, embedding array<double>, n string, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def dense(vectors, k=4):
    """(distinct x, rows of x by the order given, values, whitened by |projection|)."""
    x = np.floor(256 * np.array(vectors, float)).astype(int)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, v = np.linalg.eigh(centred.T @ centred / len(fit))
    values, v = values[::-1][:k], v[:, ::-1][:, :k]
    dev = ((len(fit) * x - fit.sum(axis=0)) ** 2).sum(axis=1)
    return fit, dev, values / (np.square(centred).sum() / len(fit)), (x - fit.mean(axis=0)) @ v / np.sqrt(values)


def compare(rows, vectors, k=4):
    fit, dev, explained, white = dense(vectors, k)
    assert len(rows) == len(vectors) * k
    got = np.zeros((len(vectors), k))
    for r in rows:
        assert r["n"] == len(fit) and r["deviation"] == dev[r["vec_id"]]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9 and r["residual"] < 1e-12
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    for j in range(k):
        sign = np.sign(got[:, j] @ white[:, j])
        assert np.abs(sign * got[:, j] - white[:, j]).max() < 1e-7


def test_table_against_dense(spark):
    vectors = [r["embedding"] for r in table(spark, SF, "embeddings").orderBy("vec_id").collect()]
    compare(queries.op13_embedding_whitening(spark, SF).collect(), vectors)


def test_steep_and_flat_spectra_with_copies(spark):
    rng = np.random.default_rng(1)
    for scale in (2.0 ** -np.arange(40), np.ones(40)):
        vectors = (rng.standard_normal((300, 40)) * scale + 5).tolist()
        vectors += [vectors[0]] * 100
        got = whitening.whiten(frame(spark, list(enumerate(vectors))), whitening.Params(block=6))
        compare(got.collect(), vectors)


def test_steep_spectrum_stops_before_the_whole_space(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((200, 60)) * 3.0 ** -np.arange(60) * 40).tolist()
    model = whitening.fit(frame(spark, list(enumerate(vectors))), whitening.Params(components=2, block=8))
    assert model.passes > 1 and (model.residuals <= 2.0**-43 * model.values[0]).all()


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None), (1, [1.0, None]), (2, [nan, 1.0]), (3, [1.0, -inf]), (4, [1.0, 2.0, 3.0]), (5, [])]
    good = [(6, [0.5, 1.0]), (7, [0.5, 2.0]), (7, [0.5, 2.0]), (None, [0.5, -1.0])]
    rows = whitening.whiten(frame(spark, odd + good)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in rows) == [(False, 6, 1), (False, 7, 1), (False, 7, 1), (True, 0, 1)]
    assert {r["n"] for r in rows} == {3}
    for none in ([], odd[:4], good[:1] * 3):
        out = whitening.whiten(frame(spark, none))
        assert out.count() == 0 and out.columns[:3] == ["vec_id", "component", "n"]
    huge = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])])).collect()
    assert all(r["deviation"] is None for r in huge if r["vec_id"] != 3)


def test_deviation_is_exact():
    x = np.array([[3, -7], [10**9, 5]])
    assert whitening.deviations(x, 3, [1, 2]) == [(9 - 1) ** 2 + (-21 - 2) ** 2, None if (3 * 10**9 - 1) ** 2 + 169 > whitening.LONG else (3 * 10**9 - 1) ** 2 + 169]
