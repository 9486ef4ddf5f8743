"""File search, ranked path matching, and rollups of the tree. Sorting comes before any limit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import matching as M
from loomtext.functions import paths as P

LIMIT = 100


def _pattern(path: Column, pattern: str) -> Column:
    return P.matches_glob(path, pattern) if re.search(r"[*?\[{]", pattern) else F.contains(path, F.lit(pattern))


def search(files: DataFrame, pattern: str, kind: str = "glob", exclude=(), extensions=(), directories=(), hidden: bool = True, limit: int = LIMIT) -> DataFrame:
    """path of files that match, sorted; kind: glob, regex or exact."""
    p = F.col("path")
    rows = files.where({"glob": lambda: P.matches_glob(p, pattern), "regex": lambda: p.rlike(pattern), "exact": lambda: p == pattern}[kind]())
    for x in exclude:
        rows = rows.where(~_pattern(p, x))
    if extensions:
        rows = rows.where(P.extension(p).isin([e.lstrip(".").lower() for e in extensions]))
    if directories:
        some = F.lit(False)
        for d in directories:
            some = some | p.startswith(d.rstrip("/") + "/") | F.contains(p, F.lit(f"/{d.strip('/')}/"))
        rows = rows.where(some)
    if not hidden:
        rows = rows.where(~P.is_hidden(p))
    return rows.select("path").orderBy("path").limit(limit)


def path_score(path: Column, pattern: str, fuzzy: float = 0.7) -> Column:
    """exact 1; file name .95; name without extension .93; substring .8 - .2 * position / length; fuzzy
    name .7 * similarity; a path part .6; else 0."""
    want = pattern.lower()
    low = F.lower(path)
    name = F.lower(P.base(path))
    near = M.jaro_winkler(name, F.lit(want))
    return (
        F.when(low == want, 1.0)
        .when(name == want, 0.95)
        .when(F.regexp_replace(name, r"\.[^.]*$", "") == want, 0.93)
        .when(F.contains(low, F.lit(want)), 0.8 - 0.2 * (F.instr(low, want) - 1) / F.char_length(low))
        .when(near >= fuzzy, 0.7 * near)
        .when(F.array_contains(F.split(low, "/"), want), 0.6)
        .otherwise(0.0)
    )


def ranked(files: DataFrame, pattern: str, k: int) -> DataFrame:
    rows = files.select("path", F.round(path_score(F.col("path"), pattern), 6).alias("score")).where("score > 0")
    return rows.orderBy(F.desc("score"), "path").limit(k)


def patterns_of(text: str) -> list[str]:
    """The whole text, then its words of more than two characters."""
    return list(dict.fromkeys([text, *[w for w in re.split(r"\s+", text) if len(w) > 2]]))


def pattern_list(text: Column) -> Column:
    """patterns_of for a column of texts."""
    return F.array_distinct(F.concat(F.array(text), F.filter(F.split(text, r"\s+"), lambda w: F.char_length(w) > 2)))


def ranked_multi(files: DataFrame, patterns: list[str], k: int) -> DataFrame:
    """Best score of each path over the patterns, 15 % more for each further hit, 50 % and 1.0 at most."""
    scores = F.array(*[path_score(F.col("path"), p) for p in patterns])
    hits = F.filter(scores, lambda s: s > 0)
    rows = files.select("path", hits.alias("s")).where("size(s) > 0")
    best = F.array_max("s") * (1 + F.least(0.15 * (F.size("s") - 1), F.lit(0.5)))
    return rows.select("path", F.round(F.least(best, F.lit(1.0)), 6).alias("score")).orderBy(F.desc("score"), "path").limit(k)


def directory_counts(files: DataFrame) -> DataFrame:
    """dir, n_files below each directory, at any depth."""
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.where(F.contains("path", F.lit("/"))).select(F.explode(heads).alias("dir")).groupBy("dir").agg(F.count("*").alias("n_files"))


def language_distribution(files: DataFrame) -> DataFrame:
    rows = files.groupBy("language").agg(F.count("*").alias("n_files"), F.sum(F.size(F.split("content", "\n"))).cast("long").alias("n_lines"))
    total = F.sum("n_files").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("share", F.round(F.col("n_files") / total, 6))


def size_distribution(files: DataFrame) -> DataFrame:
    n = F.octet_length("content")
    bucket = F.when(n < 1024, "under 1 KB").when(n < 10240, "1-10 KB").when(n < 102400, "10-100 KB").otherwise("over 100 KB")
    return files.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_files"))
