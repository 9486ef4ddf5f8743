"""Scores, top-k, context windows, merged ranges, pages and budgets of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import paths as P
from loomtext.operators.prefix import running_sum
from loomtext.operators.relations import at_position
from loomtext.operators.search import quoted

# Ranking weights.
CODE_BOOST, DOC_PENALTY, CONFIG_BOOST, TEST_BOOST, NO_SYMBOL, REQUIRED = 50.0, -20.0, 10.0, 40.0, -30.0, -1000.0


def file_type_score(path: Column, overrides: dict[str, float] | None = None) -> Column:
    kind = P.category(path)
    out = F.when(kind == "code", CODE_BOOST).when(kind == "test", TEST_BOOST).when(kind == "doc", DOC_PENALTY).when(kind == "config", CONFIG_BOOST).otherwise(0.0)
    for ext, weight in (overrides or {}).items():
        out = F.when(P.extension(path) == ext.lstrip("."), float(weight)).otherwise(out)
    return out


def symbol_score(has_symbol: Column, required: bool = False) -> Column:
    return F.when(has_symbol, 0.0).otherwise(REQUIRED if required else NO_SYMBOL)


def scored(matches: DataFrame, pattern: str, symbols: DataFrame | None = None, ref_stats: DataFrame | None = None, required: bool = False) -> DataFrame:
    """Adds score. symbols: file_id, line, type of definitions; ref_stats: file_id, line, n_in, n_out."""
    rows = matches
    if symbols is not None:
        # symbols read from sources are far more than their estimated size says, so they are not to be broadcast
        first = symbols.groupBy("file_id", "line").agg(F.min("type").alias("_type")).hint("merge")
        rows = rows.join(first, ["file_id", "line"], "left")
    else:
        rows = rows.withColumn("_type", F.lit(None).cast("string"))
    if ref_stats is not None:
        rows = rows.join(ref_stats, ["file_id", "line"], "left")
    else:
        rows = rows.withColumns({"n_in": F.lit(0), "n_out": F.lit(0)})
    text, has = F.ltrim("text"), F.col("_type").isNotNull()
    exact = F.concat(F.lit(" "), F.col("text"), F.lit(" ")).rlike(f"[^A-Za-z0-9_]{quoted(pattern)}[^A-Za-z0-9_]")
    comment = text.startswith("//")
    linked = F.least(F.coalesce("n_in", F.lit(0)) * 0.1 + F.coalesce("n_out", F.lit(0)) * 0.05, F.lit(10.0))
    depth = F.size(F.split("path", "/")) - 1
    score = (
        F.lit(10.0)
        + F.when(exact, 100.0).otherwise(0.0)
        + F.when(text.startswith("func ") & F.contains("text", F.lit(pattern)), 1000.0).otherwise(0.0)
        + F.when(has, 500.0).otherwise(0.0)
        + F.when(F.col("_type").isin("function", "class"), 200.0).otherwise(0.0)
        + F.when(comment, -5.0).otherwise(F.lit(1.0) + linked)
        + F.when(F.contains(F.lower("path"), F.lit(pattern.lower())), 3.0).otherwise(0.0)
        - depth * 0.5
        + file_type_score(F.col("path"))
        + symbol_score(has, required)
    )
    return rows.withColumn("score", F.round(score, 6)).drop("_type", "n_in", "n_out")


def match_quality(text: Column, start: Column, pattern: str) -> Column:
    """100, +50 at word boundaries, +25 at the line's start, +20 in the same case."""
    n = len(pattern)
    left, right = F.substring(text, F.greatest(start, F.lit(1)), F.lit(1)), F.substring(text, start + n + 1, F.lit(1))
    bounded = ((start == 0) | ~left.rlike(r"\w")) & ~right.rlike(r"\w")
    return 100.0 + F.when(bounded, 50.0).otherwise(0.0) + F.when(start == 0, 25.0).otherwise(0.0) + F.when(F.substring(text, start + 1, F.lit(n)) == pattern, 20.0).otherwise(0.0)


def pattern_complexity(pattern: Column) -> Column:
    """Length, two for each capital after a small letter, one for each underscore and digit."""
    return F.char_length(pattern) + 2 * F.regexp_count(pattern, F.lit("[a-z](?=[A-Z])")) + F.regexp_count(pattern, F.lit("_")) + F.regexp_count(pattern, F.lit("[0-9]"))


def rank(rows: DataFrame, k: int) -> DataFrame:
    """Exact top k with a full order."""
    return rows.orderBy(F.desc("score"), "path", "line").limit(k)


def boosted(rows: DataFrame, key: list[str]) -> DataFrame:
    """Best score of each key, 15 % more for each further pattern, 50 % at most."""
    best = rows.groupBy(*key).agg(F.max("score").alias("score"), F.count("*").alias("n_patterns"))
    return best.withColumn("score", F.round(F.col("score") * (1 + F.least(0.15 * (F.col("n_patterns") - 1), F.lit(0.5))), 6))


def output_size(asked: Column, score: Column) -> Column:
    """full from .8, one level down from .5, else a single line; levels: single, context, full."""
    return F.when(score >= 0.8, asked).when(score >= 0.5, F.when(asked == "full", "context").otherwise("single")).otherwise("single")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def context_lines(lines: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The lines within k of a hit, once each; hits spread to their line numbers, so the join is an equi-join."""
    near = hits.select("file_id", F.explode(F.sequence(F.col("line") - k, F.col("line") + k)).alias("line")).distinct()
    return lines.join(near, ["file_id", "line"])


def block_context(lines: DataFrame, hits: DataFrame, symbols: DataFrame, k: int = 2) -> DataFrame:
    """file_id, path, line, symbol, start_line, end_line, text: the innermost function or type around each hit,
    and where there is none the k lines on either side.

    symbols: file_id, symbol_no, name, line, end_line. Lines and symbols are cut from texts, so there are far more of
    them than their estimated size says: no side is broadcast by it.
    """
    at = hits.select("file_id", "path", "line").distinct().hint("merge")
    start, end = F.col("line").cast("long"), F.col("end_line").cast("long")
    ranges = symbols.select("file_id", F.struct("symbol_no", F.col("name").alias("symbol"), start.alias("start_line"), end.alias("end_line")).alias("range_id"), start.alias("start"), end.alias("end")).hint("merge")
    held = at_position(at, ranges, "file_id", "line").select("file_id", "line", "range_id.symbol", "range_id.start_line", "range_id.end_line")
    blocks = at.join(held, ["file_id", "line"], "left").withColumns({"start_line": F.coalesce("start_line", F.greatest(F.col("line") - k, F.lit(1))), "end_line": F.coalesce("end_line", F.col("line") + k)})
    each = blocks.select("*", F.explode(F.sequence("start_line", "end_line")).alias("no")).join(lines.select("file_id", F.col("line").alias("no"), "text").hint("merge"), ["file_id", "no"])
    return each.groupBy("file_id", "path", "line", "symbol", "start_line", "end_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def merged_ranges(hits: DataFrame, k: int) -> DataFrame:
    """Ranges of hits +- k lines, touching ones united (gaps and islands)."""
    rows = hits.select("file_id", "path", F.greatest(F.col("line") - k, F.lit(1)).alias("a"), (F.col("line") + k).alias("b"))
    w = Window.partitionBy("file_id").orderBy("a", "b")
    fresh = F.when(F.col("a") <= F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1)
    rows = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("file_id", "path", "island").agg(F.min("a").alias("start_line"), F.max("b").alias("end_line"), F.count("*").alias("n_matches"))


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    return F.ceil(F.char_length(text) / chars_per_token).cast("long")


def within_budget(rows: DataFrame, tokens: str, order: list[str], budget: int) -> DataFrame:
    """The first rows, in order, whose tokens sum to the budget at most."""
    return running_sum(rows, order, tokens, "so_far").withColumn("so_far", F.col("so_far").cast("long")).where(F.col("so_far") <= budget)


def page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """One page in a full order, with the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))


def page_size(budget_tokens: int, sample_tokens: int, least: int = 1, most: int = 500) -> int:
    return max(least, min(most, budget_tokens // max(1, sample_tokens)))


def page_sizes(budget_tokens: Column, sample_tokens: Column, least: int = 1, most: int = 500) -> Column:
    """page_size of columns."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(budget_tokens / F.greatest(F.lit(1), sample_tokens)))).cast("int")


def grouped(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.max("score").alias("best"))


def unique_files(rows: DataFrame, most: int) -> DataFrame:
    return rows.groupBy("path").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "path").limit(most).select("path")


def score_distribution(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg"), F.median("score").alias("median"), F.min("score").alias("min"), F.max("score").alias("max"))
