"""Vocabulary of names: domains, unique and common terms, term clusters, domain confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import names as N


def _domains(spark: SparkSession, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """domain, word: a rule table of fixed size, so it may be broadcast."""
    rows = sorted({(d, w) for d, ws in (domains or N.DOMAINS).items() for w in ws})
    return F.broadcast(spark.createDataFrame(rows, "domain string, word string"))


def _words(names: DataFrame) -> DataFrame:
    return names.select("name", F.explode(N.split(F.col("name"))).alias("word")).distinct()


def domain_occurrences(names: DataFrame) -> DataFrame:
    """domain, n_symbols (one hit a symbol), n_terms."""
    return _words(names).join(_domains(names.sparkSession), "word").groupBy("domain").agg(F.count_distinct("name").alias("n_symbols"), F.count_distinct("word").alias("n_terms"))


def _terms(names: DataFrame) -> DataFrame:
    return names.select(F.explode(N.terms(F.col("name"))).alias("term"))


def unique_terms(names: DataFrame, k: int) -> DataFrame:
    known = _domains(names.sparkSession).select(F.col("word").alias("term")).distinct()
    return _terms(names).join(F.broadcast(known), "term", "left_anti").groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def common_terms(names: DataFrame) -> DataFrame:
    known = _domains(names.sparkSession).select(F.col("word").alias("term")).distinct()
    return _terms(names).join(F.broadcast(known), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")).where("n >= 2")


def absent_domains(names: DataFrame) -> DataFrame:
    every = _domains(names.sparkSession)
    return every.select("domain").distinct().join(_words(names).join(every, "word").select("domain").distinct(), "domain", "left_anti")


def clusters(terms: DataFrame, keywords: dict[str, list[str]], most: int = 20) -> DataFrame:
    """cluster, term, n: terms (term, n) that hold a cluster's keyword of three letters or more."""
    rows = [(c, k) for c, ks in keywords.items() for k in ks if len(k) >= 3]
    table = F.broadcast(terms.sparkSession.createDataFrame(rows, "cluster string, keyword string"))
    hits = terms.join(table, F.contains("term", "keyword")).select("cluster", "term", "n").distinct()
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "term")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def confidence(strength, n, n_files, share):
    """.4 strength + .25 and .2 of scaled logs of symbols and files + .15 of the share, in .1 .. 1."""
    raw = 0.4 * strength + 0.25 * F.log10(n + 1) / F.log10(F.lit(11.0)) + 0.2 * F.log10(n_files + 1) / F.log10(F.lit(101.0)) + 0.15 * F.least(F.lit(1.0), 10 * share)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), raw)), 6)


def term_strength(terms: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """term, domain, strength: exact 1, prefix or suffix by share of the term, else .5; ties by name."""
    rows = [(d, k) for d, ks in keywords.items() for k in ks]
    table = F.broadcast(terms.sparkSession.createDataFrame(rows, "domain string, keyword string"))
    share = F.char_length("keyword") / F.char_length("term")
    edge = F.col("term").startswith(F.col("keyword")) | F.col("term").endswith(F.col("keyword"))
    hits = terms.select("term").distinct().join(table, F.contains("term", "keyword")).withColumn("strength", F.when(F.col("term") == F.col("keyword"), 1.0).when(edge, 0.6 + 0.3 * share).otherwise(0.5))
    w = Window.partitionBy("term").orderBy(F.desc("strength"), "domain")
    return hits.withColumn("r", F.row_number().over(w)).where("r = 1").select("term", "domain", F.round("strength", 6).alias("strength"))
