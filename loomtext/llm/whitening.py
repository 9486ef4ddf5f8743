"""13. Embedding whitening by matrix-free block subspace iteration.

Entries become whole numbers, x = floor(256 * c). The fit list holds each distinct vector once; it is written
once, and every pass over it is a Spark job: a task centres its rows, multiplies (X Q, then its transpose) and
gives one row for each dimension, which a grouped sum adds up. The covariance matrix itself is never formed, and
the driver sees sums of `dimensions x block` numbers only. After each pass the block is put in order by QR and
Rayleigh-Ritz, and the residuals |V q - e q| of the wanted components decide whether to stop. Where the values fall
off slowly, the block is widened with new directions instead of making hundreds of passes; a block as wide as the
space ends the search at once.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are left out; so are vectors of
another length than the most common one (of equally common ones the longest), and empty vectors. Entries beyond
the range of long are put at its ends. Repeated vectors count once in the fit and get the same whitened values;
repeated rows are given as often as they occur. Components whose variance is zero to double precision can't be
scaled and are not given, so one distinct vector gives no rows, nor does an empty table. A deviation beyond the
range of long is null. A vec_id of any type, null too, is passed on; other columns are ignored, whatever their name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.memory import claim
from loomtext.runtime import Scratch, ship_package

LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Params:
    """block: columns to start with; passes: how many more a block may need before it is widened; tolerance:
    of a residual, as a share of the largest value."""

    components: int = 4
    scale: int = 256
    block: int = 16
    passes: int = 4
    tolerance: float = 2.0**-43
    seed: int = 13


@dataclass(frozen=True)
class Model:
    """n vectors with sums per dimension; components in columns, with their values and residuals."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float
    passes: int


def whole(vectors: DataFrame, params: Params = Params(), dimensions: int | None = None) -> DataFrame:
    """vec_id, x (array of long) of the rows that can be used: those of this length, else of the most common one."""
    c = F.col("embedding")
    good = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    value = lambda v: F.floor(F.least(F.greatest(v.cast("double") * params.scale, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))).cast("long")
    rows = vectors.select("vec_id", F.when(good, c).alias("c")).where("c IS NOT NULL").select("vec_id", F.transform("c", value).alias("x"))
    if dimensions is None:
        common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        dimensions = common[0]["d"] if common else -1
    return rows.where(F.size("x") == dimensions)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows x dimensions."""
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _summed(fit: DataFrame, width: int, d: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of make(x), a matrix of d rows and `width` columns."""
    names = [f"c{j}" for j in range(width)]
    schema = T.StructType([T.StructField("i", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches):
        claim("whitening")
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *map(pa.array, np.ascontiguousarray(total.T))], names=["i", *names])

    got = fit.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()
    return np.array([[r[c] for c in names] for r in got]).reshape(-1, width)


def _whole_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sums per dimension): halves of 32 bits are summed apart, so that neither overflows."""

    def run(batches):
        claim("whitening")
        n, low, high = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(axis=0), high + (x >> 32).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(np.full(len(low), n)), pa.array(low), pa.array(high)], names=["i", "n", "low", "high"])

    got = fit.mapInArrow(run, "i int, n long, low long, high long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")).orderBy("i").collect()
    return (got[0]["n"] if got else 0), [r["low"] + (r["high"] << 32) for r in got]


def fit(vectors: DataFrame, params: Params = Params()) -> Model | None:
    """The model of these vectors; None if no row can be used."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    try:
        return _fit(scratch.write(whole(vectors, params).select("x").distinct(), "fit"), params)
    finally:
        scratch.keep()


def _fit(rows: DataFrame, params: Params) -> Model | None:
    n, sums = _whole_sums(rows)
    if not n:
        return None
    d, mean = len(sums), np.array([s / n for s in sums])
    trace = float(_summed(rows, 1, d, lambda x: np.square(x - mean).sum(axis=0)[:, None]).sum()) / n
    empty = Model(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), trace, 0.0, 0)
    if trace == 0:
        return empty
    k, rng, passes = min(params.components, d), np.random.default_rng(params.seed), 0
    block = np.linalg.qr(rng.standard_normal((d, min(d, max(params.block, k)))))[0]
    while True:
        q, width = block, block.shape[1]

        def multiply(x, q=q):
            centred = x - mean
            return centred.T @ (centred @ q)

        y = _summed(rows, width, d, multiply) / n
        passes += 1
        inner = q.T @ y
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, y @ turn
        residuals = np.linalg.norm(image[:, :k] - ritz[:, :k] * values[:k], axis=0)
        worst, limit = residuals.max(), params.tolerance * values[0]
        if worst <= limit or width == d:  # the whole space: what is left is rounding
            break
        rate = max(values[-1], 0.0) / values[k - 1] if values[k - 1] > 0 else 0.0
        left = np.log(limit / worst) / np.log(rate) if 0 < rate < 1 else (0.0 if rate == 0 else np.inf)
        grown = image
        if left > params.passes:
            grown = np.hstack([image, rng.standard_normal((d, min(d, 2 * width) - width)) * values[0]])
        block = np.linalg.qr(grown)[0]
    held = values[:k] > trace * d * np.finfo(float).eps
    vectors, values, residuals = ritz[:, :k][:, held], values[:k][held], residuals[held]
    if not len(values):
        return empty
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])

    def spread(x):
        w = (x - mean) @ vectors / np.sqrt(values)
        return w.T @ w

    error = np.abs(_summed(rows, len(values), len(values), spread) / n - np.eye(len(values))).max()
    return Model(n, sums, vectors, values, residuals, trace, float(error), passes)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None beyond the range of long."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if most * most * len(sums) <= LONG:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    exact = (x.astype(object) * n - np.array(sums, object)) ** 2
    return [v if v <= LONG else None for v in exact.sum(axis=1).tolist()]


def apply(vectors: DataFrame, model: Model | None, params: Params = Params()) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained,
    identity_error, residual (of the component, as a share of the largest value)."""
    ship_package(vectors.sparkSession)
    schema = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("component", T.IntegerType()), *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()), ("residual", T.DoubleType()))]])
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches):
        claim("whitening")
        mean, k = np.array([s / model.n for s in model.sums]), len(model.values)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch)
            white = (x - mean) @ model.vectors / np.sqrt(model.values)
            rows = pa.array(np.repeat(np.arange(m), k))
            of = lambda v: pa.array(np.tile(v, m))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")).take(rows), of(np.arange(1, k + 1, dtype=np.int32)), of(np.full(k, model.n)), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(rows), pa.array(white.ravel()), of(model.values / model.trace), of(np.full(k, model.identity_error)), of(model.residuals / model.values[0])], names=schema.names)

    return whole(vectors, params, len(model.sums)).mapInArrow(run, schema)


def whiten(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    ship_package(vectors.sparkSession)
    return apply(vectors, fit(vectors, params), params)
