"""Exact and structural duplicates, pairwise Jaccard of a candidate list, and fragment assembly."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.runtime import Scratch, first_rows

# Words kept by the structural normal form.
KEYWORDS = "if else for while do switch case break continue return func function def class struct interface import package var let const type new try catch finally throw async await yield in of not and or true false nil null none self this".split()
SEPARATORS = ("_", "-", ".", "/", ":", " ", "=", "&", ",")


def exact_hash(text: Column) -> Column:
    return F.md5(F.trim(text))


def content_lines(text: Column) -> Column:
    """Trimmed lines that are neither blank nor `//` or `#` comments."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#"))


def normalised(text: Column) -> Column:
    return F.array_join(content_lines(text), "\n")


def structural(text: Column) -> Column:
    """The normal form with every identifier, keywords apart, as ID."""
    words = "|".join(KEYWORDS)
    return F.regexp_replace(normalised(text), rf"\b(?!(?:{words})\b)[A-Za-z_][A-Za-z0-9_]*\b", "ID")


def clusters(texts: DataFrame, hash_: Column) -> DataFrame:
    """hash, n, first: groups of two or more, pre-aggregated."""
    return texts.groupBy(hash_.alias("hash")).agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


def structural_only(texts: DataFrame) -> DataFrame:
    """Structural groups whose members aren't all exact copies of one another."""
    rows = texts.select("id", F.md5(structural(F.col("text"))).alias("hash"), exact_hash(F.col("text")).alias("exact"))
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.count_distinct("exact").alias("n_exact")).where("n > 1 and n_exact > 1")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))), 6)


def new_against_old(new: DataFrame, old: DataFrame, least: float = 0.8, k: int | None = None) -> DataFrame:
    """new_id, old_id, similarity: the k best (None: all); equal normal forms 1, else token Jaccard of `least` or more.

    Texts of one token set are a class (texts without tokens: of one normal form). A class's pairs have similarity
    1 and the pairs of two classes all have the same, so classes are compared, not texts, and of each class and side
    only the first k ids can be among the k best pairs. Where equal sets alone give k pairs, no other pair can be
    among them, and classes aren't compared.
    """
    scratch = Scratch(new.sparkSession, "pairs")
    side = lambda rows, is_new: rows.select("id", normalised(F.col("text")).alias("form"), F.lit(is_new).alias("new"))
    forms = side(new, True).union(side(old, False)).where("id IS NOT NULL AND form IS NOT NULL").withColumn("toks", F.array_sort(tokens(F.col("form")))).withColumn("n", F.size("toks"))
    # a token has no "=", so a text without tokens shares no class with one that has any
    forms = forms.withColumn("class", F.sha2(F.when(F.col("n") > 0, F.array_join("toks", " ")).otherwise(F.concat(F.lit("="), "form")), 256))
    held = members = scratch.write(forms.select("id", "new", "n", "class"), "members")
    if k is not None:
        held = members.withColumn("_r", F.row_number().over(Window.partitionBy("class", "new").orderBy("id"))).where(F.col("_r") <= k)
    a, b = held.where("new").select("class", F.col("id").alias("new_id")), held.where("not new").select("class", F.col("id").alias("old_id"))
    best = lambda rows: first_rows(rows.orderBy(F.desc("similarity"), "new_id", "old_id"), k)
    equal = a.join(b, "class").select("new_id", "old_id", F.lit(1.0).alias("similarity"))
    if k is not None:
        equal = scratch.write(best(equal), "equal")
        # unequal sets of up to a million tokens differ by more than the rounding of similarity
        if equal.count() == k and (members.agg(F.max("n")).first()[0] or 0) <= 1_000_000:
            return best(equal)
    sides = members.where("n > 0").groupBy("class").agg(F.bool_or("new").alias("in_new"), F.bool_or(~F.col("new")).alias("in_old"))
    sets = forms.where("n > 0").groupBy("class", "n").agg(F.first("toks").alias("toks")).join(sides, "class")
    sets = scratch.write(sets.select(F.monotonically_increasing_id().alias("set"), "*"), "sets")
    pairs = _alike(sets, least, scratch).join(sets.select(F.col("set").alias("x"), F.col("class").alias("x_class")), "x").join(sets.select(F.col("set").alias("y"), F.col("class").alias("y_class")), "y")
    rows = pairs.join(a.withColumnRenamed("class", "x_class"), "x_class").join(b.withColumnRenamed("class", "y_class"), "y_class")
    return best(equal.union(rows.select("new_id", "old_id", "similarity")))


def _alike(sets: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """x, y, similarity: different sets, x in the new and y in the old snapshot, of Jaccard `least` or more.

    Candidates share one of a set's rarest tokens: a pair at Jaccard j of sets of n tokens shares one of the
    n - ceil(j * n) + 1 rarest, and behind the first one that they share there must be room for the common tokens
    that j asks for, so no pair is lost.
    """
    each = sets.select("set", "n", "in_new", "in_old", F.explode("toks").alias("t"))
    counts = each.groupBy("t").agg(F.count("*").alias("c"))
    ranked = each.join(counts, "t").withColumn("r", F.row_number().over(Window.partitionBy("set").orderBy("c", "t")))
    slack = 1e-9  # of products that are whole numbers
    rare = scratch.write(ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - slack) + 1).select("t", "set", "n", "r", "in_new", "in_old"), "rare")
    x = rare.where("in_new").select("t", F.col("set").alias("x"), F.col("n").alias("nx"), F.col("r").alias("rx"))
    y = rare.where("in_old").select("t", F.col("set").alias("y"), F.col("n").alias("ny"), F.col("r").alias("ry"))
    near = (F.col("nx") >= F.col("ny") * least - slack) & (F.col("ny") >= F.col("nx") * least - slack)
    room = F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry")) + 1 >= (F.col("nx") + F.col("ny")) * (least / (1 + least)) - slack
    pairs = scratch.write(x.join(y, "t").where((F.col("x") != F.col("y")) & near & room).select("x", "y").distinct(), "candidates")
    rows = pairs.join(sets.select(F.col("set").alias("x"), F.col("toks").alias("tx")), "x").join(sets.select(F.col("set").alias("y"), F.col("toks").alias("ty")), "y")
    share = F.size(F.array_intersect("tx", "ty")) / F.size(F.array_union("tx", "ty"))
    return rows.select("x", "y", share.alias("share")).where(F.col("share") >= least).select("x", "y", F.round("share", 6).alias("similarity"))


#: Token sets compared with each other in one row.
BLOCK = 64


def cluster_similarity(texts: DataFrame) -> DataFrame:
    """hash, similarity: mean token Jaccard over all pairs of each group (id, text, hash), exactly.

    Equal token sets are counted once with their numbers. A group's different sets are dealt into blocks of some
    `BLOCK`, and each two blocks are compared within one row that gives their sum, so pairs are never rows and a
    large group is spread over its blocks.
    """
    sets = texts.select("hash", F.sort_array(tokens(F.col("text"))).alias("t")).groupBy("hash", "t").agg(F.count("*").alias("n"))
    size = sets.groupBy("hash").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.sum("n").alias("all")).where(F.col("all") > 1)
    dealt = sets.join(size, "hash").withColumn("block", F.pmod(F.xxhash64("t"), F.col("blocks").cast("bigint")).cast("int"))
    held = dealt.groupBy("hash", "block", "blocks", "all").agg(F.collect_list(F.struct("t", "n")).alias("sets"))
    left = held.select("hash", "all", F.col("block").alias("i"), F.col("sets").alias("a"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
    pairs = left.join(held.select("hash", "block", F.col("sets").alias("b")), ["hash", "block"])
    alike = lambda x, y: F.size(F.array_intersect(x["t"], y["t"])) / F.greatest(F.lit(1), F.size(F.array_union(x["t"], y["t"])))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + F.aggregate("b", F.lit(0.0), lambda u, y: u + x["n"] * y["n"] * alike(x, y)))
    # within a block each pair is seen twice, and each set beside itself
    same = F.aggregate("a", F.lit(0.0), lambda s, x: s + F.when(F.size(x["t"]) > 0, x["n"].cast("double")).otherwise(0.0))
    part = F.when(F.col("i") == F.col("block"), (total - same) / 2).otherwise(total)
    rows = pairs.select("hash", "all", part.alias("part")).groupBy("hash", "all").agg(F.sum("part").alias("sum"))
    return rows.select("hash", F.round(F.col("sum") / (F.col("all") * (F.col("all") - 1) / 2), 6).alias("similarity"))


def severity(similarity: Column, n_lines: Column) -> Column:
    return F.when((similarity >= 0.95) & (n_lines >= 20), "critical").when((similarity >= 0.9) | (n_lines >= 30), "warning").otherwise("info")


# More lines or more files than these make a grade.
GRADES = (("critical", 200, 5), ("high", 100, 3), ("medium", 50, 2))


def group_impact(blocks: DataFrame) -> DataFrame:
    """hash, n, n_lines, n_files, severity, maintainability, refactorable of each group of two copies or more.

    blocks: hash, path, n_lines, cc (complexity), kind. maintainability: 1 / (1 + cc / 10 + lines / 1000) of the
    mean complexity, rounded down, and all copies' lines. refactorable: functions and methods alone, none with a
    complexity over 15. Nulls count as no lines, no complexity, no file and another kind. Groups are pre-aggregated
    by file, so a group with very many copies stays small.
    """
    fits = F.coalesce(F.col("kind").isin("function", "method"), F.lit(False)) & (F.coalesce("cc", F.lit(0)) <= 15)
    per = blocks.where("hash is not null").groupBy("hash", "path").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_lines", F.lit(0)).cast("long")).alias("n_lines"), F.sum(F.coalesce("cc", F.lit(0)).cast("long")).alias("cc"), F.every(fits).alias("fits"))
    rows = per.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("n_lines").alias("n_lines"), F.count("path").alias("n_files"), F.sum("cc").alias("cc"), F.every("fits").alias("refactorable")).where("n > 1")
    grade = F.lit("low")
    for name, lines, files in reversed(GRADES):
        grade = F.when((F.col("n_lines") > lines) | (F.col("n_files") > files), name).otherwise(grade)
    keeps = F.round(1 / (1 + F.floor(F.col("cc") / F.col("n")) / 10 + F.col("n_lines") / 1000), 6)
    return rows.select("hash", "n", "n_lines", "n_files", grade.alias("severity"), keeps.alias("maintainability"), "refactorable")


def impact(rows: DataFrame) -> DataFrame:
    """n groups, copies, and a maintainability of 1 / (1 + copies / 10)."""
    return rows.agg(F.count("*").alias("n_groups"), F.sum(F.col("n") - 1).alias("n_copies")).withColumn("maintainability", F.round(1 / (1 + F.col("n_copies") / 10), 6))


def fragments_of(target: str, least: int = 4) -> list[str]:
    """Distinct pieces of a string by each separator in turn; of HTML, its tags' names, attributes and text."""
    if re.search(r"<\w+[^>]*>", target):
        found = re.findall(r">([^<>]+)<|=\"([^\"]+)\"|<(\w+)", target)
        pieces = [x.strip() for t in found for x in t]
    else:
        pieces = [p for s in SEPARATORS for p in target.split(s)]
    return list(dict.fromkeys(p for p in pieces if len(p) >= least))


def fragment_list(target: Column, least: int = 4) -> Column:
    """fragments_of for a column of strings that aren't HTML."""
    pieces = F.flatten(F.array(*[F.split(target, F.lit(f"\\Q{s}\\E")) for s in SEPARATORS]))
    return F.array_distinct(F.filter(pieces, lambda p: F.char_length(p) >= least))


def assembly(lines: DataFrame, fragments: list[str], target_size: int, least: float = 0.5) -> DataFrame:
    """path, n_fragments, coverage, span, score: files in which a string's fragments stand together.

    coverage: summed fragment lengths over the target's, 1 at most; score: coverage * 100, times
    2, 1.5, 1.2 or 1 for a span of up to 5, 10, 20 or more lines, times .8 for more than 5 fragments.
    """
    hits = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(f)), F.lit(f)) for f in fragments]))
    rows = lines.select("path", "line", F.explode(hits).alias("fragment"))
    first = rows.groupBy("path", "fragment").agg(F.min("line").alias("line"))
    per = first.groupBy("path").agg(F.count("*").cast("int").alias("n_fragments"), F.least(F.lit(1.0), F.sum(F.char_length("fragment")) / target_size).alias("coverage"), (F.max("line") - F.min("line")).alias("span"))
    near = F.when(F.col("span") <= 5, 2.0).when(F.col("span") <= 10, 1.5).when(F.col("span") <= 20, 1.2).otherwise(1.0)
    many = F.when(F.col("n_fragments") > 5, 0.8).otherwise(1.0)
    return per.where(F.col("coverage") >= least).select("path", "n_fragments", F.round("coverage", 6).alias("coverage"), "span", F.round(F.col("coverage") * 100 * near * many, 6).alias("score"))


def html_fragments(pages: DataFrame) -> DataFrame:
    """url, kind, fragment: texts between tags, attribute values and tag names."""
    text = F.filter(F.transform(F.regexp_extract_all("html", F.lit(r">([^<>]+)<"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    attr = F.regexp_extract_all("html", F.lit(r'[a-z-]+="([^"<>]+)"'), F.lit(1))
    tag = F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))

    def labelled(kind: str, found: Column) -> Column:
        return F.transform(found, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("fragment")))

    kinds = [labelled("text", text), labelled("attribute", attr), labelled("tag", tag)]
    return pages.select("url", F.explode(F.concat(*kinds)).alias("f")).select("url", "f.kind", "f.fragment")
