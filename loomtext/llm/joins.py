"""Equi-joins whose left side may hold very many rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_hot(rows: DataFrame, others: DataFrame, on: str, hot: int, spread: str = "", counted: DataFrame | None = None) -> DataFrame:
    """rows joined with others (few rows a key) on a column; keys with over `hot` rows are dealt by salt.

    There are at most rows / hot such keys, found by a pre-aggregated count and broadcast. Only for them
    the other side's rows are repeated, once a salt. spread: a column that deals a key's rows; none: all the
    columns. counted: a cheaper table with as many rows a key to count, where `rows` is costly to make twice.
    """
    counts = (rows if counted is None else counted).groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(on, F.ceil(F.col("_n") / hot).cast("int").alias("_salts"))
    dealt = F.pmod(F.xxhash64(*([spread] if spread else [c for c in rows.columns if c != on])), F.col("_salts").cast("long")).cast("int")
    left = rows.join(F.broadcast(counts), on, "left").withColumn("_salt", F.coalesce(dealt, F.lit(0))).drop("_salts")
    right = others.join(F.broadcast(counts), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [on, "_salt"]).drop("_salt")
