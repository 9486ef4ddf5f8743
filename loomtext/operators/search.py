"""Content search over lines: literal, whole-word, regex, inverted and multi-pattern matches.

Literal matches overlap, regex matches don't. A scan of the corpus reads path and content only; every
predicate stays in the JVM. Results have a total order before any limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import paths as P
from loomtext.operators import regexplan as R
from loomtext.operators import relations as J
from loomtext.sources import corpus as C


@dataclass(frozen=True)
class Options:
    regex: bool = False
    ignore_case: bool = False
    whole_word: bool = False
    invert: bool = False
    skip_comments: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_tests: bool = False
    per_file: int | None = None  # at most so many lines a file; None: all of them
    required: tuple[str, ...] = field(default=())  # further text that a file must hold


def quoted(literal: str) -> str:
    """A Java regex for the literal."""
    return re.sub(r"([^\w\s])", r"\\\1", literal) if literal else ""


#: What makes a pattern more than a literal, what looks like a regex, and what a simple one may not hold.
_META = r"[.^$*+?()\[\]{}|\\]"
_LOOKS = r"\||\[[^\]]+\]|\([^)]*\)|^\^|\$$|\\[bBdDwWsS.]|[^\s][*+?](?:$|[^\w])|\{\d+(?:,\d*)?\}|\.[*+]"
_HARD = r"\(\?[=!<imsx]|\\[1-9]"
#: Alternatives and nesting of a simple pattern.
MOST_BARS, DEEPEST = 10, 5


def is_literal(pattern: str) -> bool:
    """A regex without metacharacters is searched as a literal."""
    return not re.search(_META, pattern)


def literal_pattern(pattern: Column) -> Column:
    """is_literal for a column of patterns."""
    return ~pattern.rlike(_META)


def regex_like(pattern: Column) -> Column:
    """Whether patterns look like regexes."""
    return pattern.rlike(_LOOKS)


def simple_pattern(pattern: Column) -> Column:
    """Balanced, at most five deep, no look-around, back-references or inline flags, no alternation of more
    than ten parts."""
    brackets = F.split(F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"[^()]", ""), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"), F.lit(0).alias("lowest"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.greatest(s["deepest"], depth).alias("deepest"), F.least(s["lowest"], depth).alias("lowest"))

    nested = F.aggregate(brackets, zero, step, lambda s: (s["depth"] == 0) & (s["lowest"] == 0) & (s["deepest"] <= DEEPEST))
    return ~pattern.rlike(_HARD) & (F.regexp_count(pattern, F.lit(r"\|")) <= MOST_BARS) & nested


def needed(pattern: str, o: Options) -> R.Condition:
    """What a text must hold for the pattern to match in it."""
    if o.regex:
        return R.condition(pattern, o.ignore_case)
    return R.literal(pattern, o.ignore_case)


def java_regex(pattern: str, o: Options) -> str:
    body = pattern if o.regex else quoted(pattern)
    return f"{'(?i)' if o.ignore_case else ''}{rf'\b(?:{body})\b' if o.whole_word else body}"


def count_in(text: Column, pattern: str, o: Options) -> Column:
    """Matches in a text: overlapping for plain literals."""
    rx = java_regex(pattern, o)
    if not o.regex and not o.whole_word:
        rx = f"{'(?i)' if o.ignore_case else ''}(?={quoted(pattern)})"
    return F.regexp_count(text, F.lit(rx))


def present(text: Column, pattern: str, o: Options) -> Column:
    """Whether a text holds the pattern; stops at the first place."""
    return F.contains(text, F.lit(pattern)) if not (o.regex or o.whole_word or o.ignore_case) else text.rlike(java_regex(pattern, o))


def path_filtered(corpus: DataFrame, o: Options) -> DataFrame:
    for g in o.include:
        corpus = corpus.where(P.matches_glob(F.col("path"), g) if re.search(r"[*?]", g) else F.col("path").rlike(g))
    for g in o.exclude:
        corpus = corpus.where(~(P.matches_glob(F.col("path"), g) if re.search(r"[*?]", g) else F.col("path").rlike(g)))
    return corpus.where(~P.is_test(F.col("path"))) if o.exclude_tests else corpus


def prefilter(corpus: DataFrame, pattern: str, o: Options) -> DataFrame:
    """Files that can match, by the literals that any match holds, before lines are cut."""
    test = None if o.invert else R.in_text(needed(pattern, o), F.col("content"))
    return corpus if test is None else corpus.where(test)


def matching_lines(corpus: DataFrame, pattern: str, o: Options = Options()) -> DataFrame:
    """file_id, path, line, text, n: the lines that match (or don't, inverted); at most per_file a file, if set."""
    corpus = prefilter(path_filtered(corpus, o), pattern, o)
    for need in o.required:
        corpus = corpus.where(F.contains("content", F.lit(need)))
    rows, hit = C.lines(corpus), present(F.col("text"), pattern, o)
    rows = rows.where(~hit if o.invert else hit)
    if o.skip_comments and not o.regex and not o.invert:
        rows = rows.where(~F.ltrim("text").startswith("//"))
    rows = rows.withColumn("n", F.lit(0) if o.invert else count_in(F.col("text"), pattern, o))
    return first_per_file(rows, o.per_file) if o.per_file else rows


def first_per_file(rows: DataFrame, n: int) -> DataFrame:
    """At most n lines a file, in file order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("file_id").orderBy("line"))).where(F.col("_r") <= n).drop("_r")


def positions(rows: DataFrame, pattern: str, o: Options = Options()) -> DataFrame:
    """Explodes matching lines into matches: column and byte_column (from 0), and whether it is a word.

    A line is cut at its matches once; a running sum over its pieces gives every position.
    """
    rx = java_regex(pattern, o) if o.regex or o.whole_word else f"{'(?i)' if o.ignore_case else ''}(?={quoted(pattern)})"
    gaps = F.split("text", rx, -1)
    if o.regex or o.whole_word:
        hits = F.regexp_extract_all("text", F.lit(f"({rx})"), F.lit(1))
    else:  # matches overlap: a piece starts at its match and ends where the next one starts
        starts = F.col("text").startswith(pattern) if not o.ignore_case else F.lower("text").startswith(pattern.lower())
        gaps = F.when(starts, F.concat(F.array(F.lit("")), gaps)).otherwise(gaps)
        hits = F.transform(F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), lambda g: F.lit(""))
    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("bytes"), F.array().cast("array<struct<i:int,column:int,byte_column:int>>").alias("out"))
    pieces = F.transform(gaps, lambda g, i: F.struct(i.alias("i"), g.alias("gap"), F.get(hits, i).alias("hit")))

    def step(acc: Column, p: Column) -> Column:
        column, at = acc["chars"] + F.char_length(p["gap"]), acc["bytes"] + F.octet_length(p["gap"])
        here = F.array(F.struct(p["i"].cast("int").alias("i"), column.alias("column"), at.alias("byte_column")))
        return F.struct((column + F.coalesce(F.char_length(p["hit"]), F.lit(0))).alias("chars"), (at + F.coalesce(F.octet_length(p["hit"]), F.lit(0))).alias("bytes"), F.when(p["hit"].isNotNull(), F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    places = F.aggregate(pieces, zero, step, lambda acc: acc["out"])
    each = rows.select("file_id", "path", "line", "text", F.explode(places).alias("p"), hits.alias("h"))
    size = F.char_length(F.get("h", F.col("p.i"))) if o.regex or o.whole_word else F.lit(len(pattern))
    left, right = F.when(F.col("p.column") > 0, F.substring("text", F.col("p.column"), F.lit(1))).otherwise(""), F.substring("text", F.col("p.column") + size + 1, F.lit(1))
    exact = ~(left.rlike(r"\w") | right.rlike(r"\w"))
    return each.select("file_id", "path", "line", "text", F.col("p.column").alias("column"), F.col("p.byte_column").alias("byte_column"), exact.alias("exact"))


def count_per_file(corpus: DataFrame, pattern: str, o: Options = Options()) -> DataFrame:
    """path, n_lines, n_matches."""
    rows = matching_lines(corpus, pattern, o)
    return rows.groupBy("path").agg(F.count("*").alias("n_lines"), F.sum("n").cast("long").alias("n_matches"))


def top_files(corpus: DataFrame, pattern: str, k: int, o: Options = Options()) -> DataFrame:
    """The k files with most matches, with their first and last matching line."""
    rows = matching_lines(corpus, pattern, o).groupBy("file_id", "path").agg(F.sum("n").cast("long").alias("n_matches"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    return rows.orderBy(F.desc("n_matches"), "path").limit(k)


def first_pattern(corpus: DataFrame, patterns: list[str], o: Options = Options()) -> DataFrame:
    """Each line once, with the first of the patterns that hits it."""
    rows = C.lines(path_filtered(corpus, o))
    which = F.coalesce(*[F.when(present(F.col("text"), p, o), F.lit(i)) for i, p in enumerate(patterns)])
    names = F.array(*map(F.lit, patterns))
    return rows.withColumn("pattern_no", which).where("pattern_no is not null").select("path", "line", F.element_at(names, F.col("pattern_no") + 1).alias("pattern"))


def stats(corpus: DataFrame, pattern: str, o: Options = Options()) -> DataFrame:
    """One row: totals of a search, with its comment and test lines."""
    rows = matching_lines(corpus, pattern, o).withColumn("dir", P.directory(F.col("path")))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_matches"), F.count("*").alias("n_lines"), F.countDistinct("path").alias("n_files"), F.countDistinct("dir").alias("n_dirs"), F.count_if(F.ltrim("text").startswith("//")).alias("n_comment_lines"), F.count_if(P.is_test(F.col("path"))).alias("n_test_lines"))


def co_occurrence(corpus: DataFrame, patterns: list[str], o: Options = Options()) -> DataFrame:
    """a, b, n_files for each ordered pair of different patterns; one pass, no self-join of files."""
    has = F.array_compact(F.array(*[F.when(present(F.col("content"), p, o), F.lit(p)) for p in patterns]))
    rows = path_filtered(corpus, o).select(has.alias("has")).where("size(has) > 1")
    pairs = rows.select(F.explode("has").alias("a"), "has").select("a", F.explode("has").alias("b")).where("a != b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_files"))


def files_with_all(corpus: DataFrame, patterns: list[str], o: Options = Options()) -> DataFrame:
    for p in patterns:
        corpus = corpus.where(present(F.col("content"), p, o))
    return corpus.select("file_id", "path")


def index_candidates(trigrams: DataFrame, pattern: str, o: Options = Options()) -> DataFrame | None:
    """file_id of files that can match by a trigram table; None if the table can't tell."""
    return None if o.invert else R.candidates(trigrams, needed(pattern, o))


def by_trigrams(corpus: DataFrame, trigrams: DataFrame, pattern: str, o: Options = Options()) -> DataFrame:
    """A literal or regex search pruned by a persisted trigram table (trigram, file_id)."""
    able = index_candidates(trigrams, pattern, o)
    return matching_lines(corpus if able is None else corpus.join(able, "file_id", "left_semi"), pattern, o)


def with_symbols(rows: DataFrame, symbols: DataFrame, kinds: list[str] | None = None, declared: bool = False, exported: bool | None = None, mutable: bool | None = None, top_level: bool | None = None) -> DataFrame:
    """Matching lines kept by the symbol that starts there (declared) or holds them (innermost).

    symbols: file_id, symbol_no, name, kind, line, end_line, exported, depth. mutable: variables and fields,
    not constants; top_level: no symbol around it. Adds symbol and kind.
    """
    s = symbols
    if kinds:
        s = s.where(F.col("kind").isin(kinds))
    if exported is not None:
        s = s.where(F.col("exported") == exported)
    if mutable is not None:
        s = s.where(F.col("kind").isin("variable", "field") == mutable)
    if top_level is not None:
        s = s.where((F.col("depth") == 0) == top_level)
    if declared:
        first = s.groupBy("file_id", "line").agg(F.min_by(F.struct(F.col("name").alias("symbol"), "kind"), "symbol_no").alias("s"))
        return rows.join(first, ["file_id", "line"]).select(*rows.columns, "s.symbol", "s.kind")
    ranges = s.select("file_id", F.col("symbol_no").alias("range_id"), F.col("line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"))
    held = J.at_position(rows, ranges, "file_id", "line")
    named = s.select("file_id", F.col("symbol_no").alias("range_id"), F.col("name").alias("symbol"), "kind")
    return held.join(named, ["file_id", "range_id"]).select(*rows.columns, "symbol", "kind")


def line_of_offset(text: Column, offset: Column) -> Column:
    """1 + the newlines before a character offset (from 0)."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def one_line(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def files_less_one(corpus: DataFrame, pattern: str, o: Options = Options()) -> DataFrame:
    """One row, n_refs: files that hold the pattern, less the one that defines it; a guess without references."""
    return corpus.where(present(F.col("content"), pattern, o)).agg(F.greatest(F.lit(0), F.count_distinct("file_id") - 1).alias("n_refs"))


def merged(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary results, and secondary ones at half score where (path, line, text) is new."""
    rest = secondary.join(primary, ["path", "line", "text"], "left_anti").withColumn("score", F.col("score") * 0.5)
    return primary.unionByName(rest)
