"""Matching a query against names: eight layers, fuzzy lists, candidates.

Layers run over distinct names. Words of a query are split before case is lost, so camel case counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import matching as M
from loomtext.functions import names as N
from loomtext.runtime import ship_package

# Layer weights, threshold, limits.
WEIGHTS = {"exact": 1.0, "substring": 0.9, "phrase": 0.88, "annotation": 0.85, "fuzzy": 0.70, "stem": 0.55, "name_split": 0.40, "abbreviation": 0.25}
CONFIDENCE = {"exact": 1.0, "substring": 0.9, "phrase": 0.88, "annotation": 0.85, "fuzzy": 0.7, "stem": 0.6, "name_split": 0.5, "abbreviation": 0.4}
FUZZY, LEAST = 0.7, 0.2


def query_words(query: str) -> list[str]:
    import re

    spaced = re.sub(r"[_\-./\s]+", " ", query)
    for a, b in ((r"([a-z])([A-Z])", r"\1 \2"), (r"([A-Z])([A-Z][a-z])", r"\1 \2"), (r"([A-Za-z])([0-9])", r"\1 \2"), (r"([0-9])([A-Za-z])", r"\1 \2")):
        spaced = re.sub(a, b, spaced)
    return spaced.lower().split()


def layers(names: DataFrame, query: str, labels: list[str] = ()) -> DataFrame:
    """name and one score column for each layer (0 where it doesn't hit)."""
    words = query_words(query)
    low, want = F.lower("name"), query.lower()
    own = N.split(F.col("name"))
    table = N.ABBREVIATIONS
    want_stems = [M.stem_of(w) for w in words if len(w) >= 3]
    arr = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    share = lambda wanted, have: F.size(F.filter(arr(wanted), lambda w: F.array_contains(have, w))) / max(1, len(wanted))
    near = M.jaro_winkler(low, F.lit(want))
    forward = [x for w in words for x in table.get(w, [])]
    back = [k for k, v in table.items() if any(w in v for w in words)]
    long = forward + back
    hits = F.size(F.array_intersect(arr(long), own))
    phrase = M.phrase_matcher(words, table, N.DOMAINS)(own)
    names = names.withColumn("_stems", M.stems(own))
    got = {
        "exact": F.when(low == want, 1.0),
        "substring": F.when(F.contains(low, F.lit(want)), 0.9),
        "phrase": F.when(F.lit(len(words) > 1) & (phrase > 0), WEIGHTS["phrase"] * phrase),
        "annotation": F.when(F.lit(want in [x.lower() for x in labels]), 0.85),
        "fuzzy": F.when(near > FUZZY, WEIGHTS["fuzzy"] * (0.7 + 0.1 * (near - 0.7))),
        "stem": WEIGHTS["stem"] * share(want_stems, F.col("_stems")),
        "name_split": WEIGHTS["name_split"] * share(words, own),
        "abbreviation": WEIGHTS["abbreviation"] * hits / F.greatest(F.lit(1), F.lit(len(long)) + F.size(own)),
    }
    return names.select("name", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(k) for k, c in got.items()])


def rank_symbols(names: DataFrame, query: str, k: int, labels: list[str] = ()) -> DataFrame:
    """name, score, match_type, confidence, rank of the k best with at least the least score."""
    rows = layers(names, query, labels)
    best = F.greatest(*[F.struct(F.col(x).alias("score"), F.lit(CONFIDENCE[x]).alias("confidence"), F.lit(x).alias("match_type")) for x in WEIGHTS])
    rows = rows.select("name", best.alias("b")).select("name", "b.score", "b.match_type", "b.confidence").where(F.col("score") >= LEAST)
    order = [F.desc("score"), F.desc("confidence"), F.col("name")]
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuzzy_matches(names: DataFrame, target: str, threshold: float, k: int) -> DataFrame:
    rows = names.select("name", M.jaro_winkler(F.col("name"), F.lit(target)).alias("s")).where(F.col("s") >= threshold)
    return rows.select("name", F.round("s", 6).alias("similarity")).orderBy(F.desc("similarity"), "name").limit(k)


def fuzzy_weighted(names: DataFrame, target: str, threshold: float) -> DataFrame:
    """.7 similarity + .3 weight."""
    rows = names.withColumn("s", M.jaro_winkler(F.col("name"), F.lit(target))).where(F.col("s") >= threshold)
    return rows.select("name", F.round(0.7 * F.col("s") + 0.3 * F.col("weight"), 6).alias("score"))


def abbreviation_pairs(names: DataFrame) -> DataFrame:
    """word, expansion: each distinct word, itself and its long forms."""
    words = names.select(F.explode(N.split(F.col("name"))).alias("word")).distinct()
    return words.select("word", F.explode(N.expand_words(F.array("word"))).alias("expansion")).distinct()


def candidates(keys: DataFrame, query: str) -> DataFrame:
    """Distinct names that share a word, stem, phonetic code or expansion with the query."""
    words = query_words(query)
    want = {("word", w) for w in words} | {("stem", M.stem_of(w)) for w in words if len(w) >= 3} | {("abbreviation", x) for w in words for x in [w, *N.ABBREVIATIONS.get(w, [])]}
    wanted = keys.sparkSession.createDataFrame(sorted(want), "kind string, key string")
    return keys.join(F.broadcast(wanted), ["kind", "key"], "left_semi").select("name").distinct()


def similar_names(names: DataFrame, others: DataFrame, threshold: float = 0.8, k: int = 3, block: int = 512) -> DataFrame:
    """name, similar, similarity: the k most similar of the other names (Jaro-Winkler of the lower-cased names,
    those alike but for case among them); ties by name.

    Distinct names are dealt into blocks, and blocks of names are held against blocks of others: a count of
    shared letters and the common prefix bound the similarity from above, and only names that pass the bound are
    compared in full, so no pair is lost and only similar ones come out.
    """
    ship_package(names.sparkSession)

    def dealt(rows: DataFrame, name: str):
        rows = rows.select("name").where("name is not null").distinct()
        n = max(1, -(-rows.count() // block))
        return n, rows.groupBy(F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias(f"{name}_no")).agg(F.collect_list("name").alias(name))

    (n, a), (m, b) = dealt(names, "a"), dealt(others, "b")
    pairs = a.withColumn("b_no", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).repartition(min(n * m, 4096), "a_no", "b_no").join(b, "b_no")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = M.similar_pairs(batch.column("a")[i].as_py(), batch.column("b")[i].as_py(), threshold)
                if rows:
                    x, y, s = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(s)], names=["name", "similar", "s"])

    rows = pairs.select("a", "b").mapInArrow(run, "name string, similar string, s double")
    w = Window.partitionBy("name").orderBy(F.desc("s"), "similar")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("name", "similar", F.round("s", 6).alias("similarity"))


def resolved_kind(text: Column, kinds: dict[str, list[str]]) -> Column:
    """struct(kind, how) of a column of kinds' names, as resolve_kind."""
    low = F.trim(F.lower(text))
    named = lambda kind, how: F.struct(F.lit(kind).alias("kind"), F.lit(how).alias("how"))
    exact = [F.when(low == k, named(k, "exact")) for k in kinds]
    alias = [F.when(low.isin(also), named(k, "alias")) for k, also in kinds.items() if also]
    prefix = [F.when((F.char_length(low) >= 2) & F.lit(k).startswith(low), named(k, "prefix")) for k in sorted(kinds)]
    near = F.array_sort(F.array(*[F.struct((-M.jaro_winkler(low, F.lit(k))).alias("s"), F.lit(k).alias("k")) for k in kinds]))[0]
    fuzzy = F.when(near["s"] <= -0.85, F.struct(near["k"].alias("kind"), F.lit("fuzzy").alias("how")))
    return F.coalesce(*exact, *alias, *prefix, fuzzy, named(None, "none"))


def resolve_kind(text: str, kinds: dict[str, list[str]]) -> tuple[str | None, str]:
    """(kind, how) of a kind's name: exact, alias, prefix or fuzzy (one edit in five letters)."""
    low = text.lower().strip()
    if low in kinds:
        return low, "exact"
    for kind, aliases in kinds.items():
        if low in aliases:
            return kind, "alias"
    starts = sorted(k for k in kinds if len(low) >= 2 and k.startswith(low))
    if starts:
        return starts[0], "prefix"
    near = sorted((-M.jaro_winkler_of(low, k), k) for k in kinds)
    return (near[0][1], "fuzzy") if near and -near[0][0] >= 0.85 else (None, "none")


