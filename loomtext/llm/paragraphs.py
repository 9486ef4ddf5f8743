"""12. Document fingerprints by an invertible Bloom lookup sketch of paragraph digests; DataFrame functions only.

A paragraph is a line, cut further behind the first sentence mark after each `LONG` characters. A text's set of
60-bit digests goes into a sketch of 48 cells: each digest into one cell of each of three parts, where a cell has a
count, the XOR of its digests and the XOR of their checks. The sketches of two versions subtract cell by cell:
what both hold goes away, and peeling (cells of count 1 or -1 whose check fits give a digest, which is taken out of
its other cells) recovers the digests that only one side has. If cells are left over, the difference was too large
for the sketch. It is made again larger, as many sketches over parts of the digests: as many as both texts have
paragraphs by `LOAD`, and on failure 4 and 16 times as many. What even these can't peel is compared as sets, so
results are exact for every size.

All of it happens in the row of the two versions: nothing is shuffled for the sketches, and no row meets another.

For `compare_edits` documents follow each other by doc_id, which a running count over ranges of ids decides (ids
only; one row a range reaches the sum of ranges). Texts move once by a hash of the document, and of each text the
beginning that its predecessor takes once more.

Defined cases: null text is empty; a text without a character other than line breaks has no paragraphs, and two
such are alike (1), one of them is like no other text (0). Repeated paragraphs count once. Very long texts are
whole. Rows with equal doc_id and text are one document in the order, and each of them is given; rows that share
only the doc_id follow each other by a hash; a null doc_id comes first. A single document follows itself. A doc_id
of any type that has an order is passed on; other columns are ignored, whatever their name. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.prefix import running_sum
from loomtext.runtime import Scratch

#: Characters after which a line's next sentence mark ends a paragraph.
LONG = 240
PATTERN = rf"[^\n]{{{LONG}}}[^\n.!?]*[.!?]?|[^\n]+"
#: Cells of each of the three parts of a sketch, a power of two.
PART = 16
#: Paragraphs of both texts for each sketch of the second attempt, and how much larger each attempt is.
LOAD, LARGER = 24, (1, 4, 16)
#: The check of a digest is its rest by this prime.
CHECK = 4294967291

_ITEM = "struct<d:bigint,s:bigint,p:int,q:int,r:int>"
_CELL = "struct<n:bigint,k:bigint,c:bigint>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def digests(text: Column) -> Column:
    """The digests of a text's paragraphs, as a set."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))), lambda p: F.conv(F.substring(F.md5(p), 1, 15), 16, 10).cast("bigint"))


def _hash(d: Column, seed: Column | None) -> Column:
    """The bits that place a digest: its own, or in larger sketches a hash of it."""
    return d if seed is None else F.xxhash64(d, seed)


def _placed(d: Column, sign: Column, seed: Column | None) -> Column:
    h = lambda shift, part: (F.shiftrightunsigned(_hash(d, seed), shift).bitwiseAND(PART - 1) + part * PART).cast("int")
    return F.struct(d.alias("d"), sign.cast("bigint").alias("s"), h(0, 0).alias("p"), h(4, 1).alias("q"), h(8, 2).alias("r"))


def _into(items: Column, i: Column) -> Column:
    return F.filter(items, lambda x: (x["p"] == i) | (x["q"] == i) | (x["r"] == i))


def _sum(items: Column) -> Column:
    """The cell that these items make."""
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.aggregate(items, zero, lambda s, x: s + x["s"]).alias("n"),
        F.aggregate(items, zero, lambda s, x: s.bitwiseXOR(x["d"])).alias("k"),
        F.aggregate(items, zero, lambda s, x: s.bitwiseXOR(F.pmod(x["d"], F.lit(CHECK)))).alias("c"),
    )


def sketch(keys: Column, seed: Column | None = None) -> Column:
    """The cells of a set of digests."""
    return _let(F.transform(keys, lambda d: _placed(d, F.lit(1), seed)), lambda items: F.transform(F.sequence(F.lit(0), F.lit(3 * PART - 1)), lambda i: _let(_into(items, i), _sum)))


def _less(a: Column, b: Column) -> Column:
    return F.struct((a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, _less)


def peel(cells: Column, seed: Column | None = None) -> Column:
    """struct(cells, got, done): the cells left over and the recovered items (d, s = 1 if only the first version
    has it, else -1), all digests that can be taken out in a round at once."""

    def step(state: Column, _) -> Column:
        pure = F.filter(
            F.transform(state["cells"], lambda c, i: F.when((F.abs(c["n"]) == 1) & (c["k"] >= 0) & (F.pmod(c["k"], F.lit(CHECK)) == c["c"]), _let(_placed(c["k"], c["n"], seed), lambda x: F.when((x["p"] == i) | (x["q"] == i) | (x["r"] == i), x)))),
            lambda x: x.isNotNull(),
        )
        taken = lambda new: F.struct(
            F.when(F.size(new) == 0, state["cells"]).otherwise(F.transform(state["cells"], lambda c, i: _let(_sum(_into(new, i)), lambda m: _less(c, m)))).cast(f"array<{_CELL}>").alias("cells"),
            F.concat(state["got"], new).cast(f"array<{_ITEM}>").alias("got"),
            (F.size(new) == 0).alias("done"),
        )
        return F.when(state["done"], state).otherwise(_let(F.array_distinct(pure), taken))

    start = F.struct(cells.cast(f"array<{_CELL}>").alias("cells"), F.array().cast(f"array<{_ITEM}>").alias("got"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(3 * PART)), start, step)


def _empty(state: Column) -> Column:
    return F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))


def _sides(removed: Column, added: Column) -> list[Column]:
    return [removed.cast("array<bigint>").alias("removed"), added.cast("array<bigint>").alias("added")]


def _of(state: Column, sign: int) -> Column:
    return F.transform(F.filter(state["got"], lambda x: x["s"] == sign), lambda x: x["d"])


def difference(a: Column, b: Column, cells: Column | None = None) -> Column:
    """struct(removed, added, done): the digests that only a, and only b, has; done: peeling gave them all.
    cells: the subtracted sketches, if known."""

    def attempt(sketches: Column) -> Column:
        part = lambda keys, i: F.filter(keys, lambda d: F.pmod(F.shiftrightunsigned(_hash(d, sketches), 12), sketches) == i)
        one = lambda i: _let(F.struct(part(a, i).alias("a"), part(b, i).alias("b")), lambda x: peel(subtract(sketch(x["a"], sketches), sketch(x["b"], sketches)), sketches))
        joined = lambda states, sign: F.flatten(F.transform(states, lambda s: _of(s, sign)))
        return _let(F.transform(F.sequence(F.lit(0), sketches - 1), one), lambda states: F.struct(*_sides(joined(states, 1), joined(states, -1)), F.forall(states, _empty).alias("done")))

    def larger() -> Column:
        least = F.floor((F.size(a) + F.size(b)) / LOAD).cast("int") + 2
        start = F.struct(*_sides(F.array(), F.array()), F.lit(False).alias("done"))
        as_sets = F.struct(*_sides(F.array_except(a, b), F.array_except(b, a)), F.lit(False).alias("done"))
        return F.aggregate(F.transform(F.array(*map(F.lit, LARGER)), lambda x: x * least), start, lambda s, n: F.when(s["done"], s).otherwise(attempt(n)), lambda s: F.when(s["done"], s).otherwise(as_sets))

    first = peel(subtract(sketch(a), sketch(b)) if cells is None else cells)
    return _let(first, lambda s: F.when(_empty(s), F.struct(*_sides(_of(s, 1), _of(s, -1)), F.lit(True).alias("done"))).otherwise(larger()))


def likeness(a: Column, b: Column, cells: Column | None = None) -> Column:
    """Common paragraphs as a share of all, from sizes and the recovered difference; 1 if neither has any."""
    both = lambda x: F.size(a) - F.size(x["removed"])
    share = lambda x: F.when(F.size(a) + F.size(x["added"]) == 0, F.lit(1.0)).otherwise(both(x) / (F.size(a) + F.size(x["added"])))
    return _let(difference(a, b, cells), share)


def written(cells: Column) -> Column:
    """A sketch as text: for each cell 4 bytes of count, 8 of digests and 4 of checks, in base 64."""
    word = lambda x, n: F.lpad(F.hex(x), n, "0")
    coded = F.base64(F.unhex(F.array_join(F.transform(cells, lambda c: F.concat(word(c["n"], 8), word(c["k"], 16), word(c["c"], 8))), "")))
    return F.translate(coded, "\r\n", "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, fingerprint."""
    rows = docs.select("doc_id", digests(F.coalesce("text", F.lit(""))).alias("d"))
    return rows.select("doc_id", F.size("d").alias("n_paragraphs"), written(sketch(F.col("d"))).alias("fingerprint"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, removed, added, likeness of the versions of each document that both tables have (doc_id once each)."""
    side = lambda t, name: t.select("doc_id", digests(F.coalesce("text", F.lit(""))).alias(name))
    rows = side(old, "a").join(side(new, "b"), "doc_id")
    return rows.select("doc_id", difference(F.col("a"), F.col("b")).alias("x"), likeness(F.col("a"), F.col("b")).alias("likeness")).select("doc_id", "x.removed", "x.added", "likeness")


def compare_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs.

    The edited text's last floor(n_chars / 2) characters are those that the next document begins with.
    """
    scratch = Scratch(docs.sparkSession, "paragraphs")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit(7), "doc_id", "text").alias("k2"))
    ids = rows.select("doc_id", "k", "k2", F.char_length("text").alias("n")).distinct().withColumn("one", F.lit(1).cast("bigint"))
    placed = scratch.write(running_sum(ids, ["doc_id", "k", "k2"], "one", "place").select("k", "k2", "n", "place"), "places")
    total = placed.count()
    after = placed.select(F.col("k").alias("k_next"), F.col("k2").alias("k2_next"), F.when(F.col("place") == 1, F.lit(total)).otherwise(F.col("place") - 1).alias("place"))
    follows = placed.join(after, "place").select("k", "k2", F.floor(F.col("n") / 2).cast("int").alias("half"), "k_next", "k2_next")
    # both joins use all that this gives, so that texts are dealt by document once and that exchange is read twice
    each = rows.groupBy("k", "k2").agg(F.first(F.struct("doc_id", "text")).alias("row"), F.count("*").alias("copies")).where("copies > 0")
    named = each.select(F.col("k").alias("k_next"), F.col("k2").alias("k2_next"), F.col("row.text").alias("next"))
    each = each.select("k", "k2", "row.doc_id", "row.text", "copies")
    begins = named.join(follows, ["k_next", "k2_next"]).select("k", "k2", "half", F.expr("left(next, half)").alias("begin"), digests(F.col("next")).alias("next"))
    both = each.join(begins, ["k", "k2"]).withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - half as int))"), "begin"))
    both = both.select("doc_id", "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("edited"), "next")
    made = both.withColumn("cells", sketch(F.col("own"))).withColumn("edited_cells", sketch(F.col("edited"))).withColumn("next_cells", sketch(F.col("next")))
    out = made.select(
        "doc_id", "copies", "n_chars", "edited_sha256", written(F.col("cells")).alias("fingerprint"), written(F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), subtract(F.col("cells"), F.col("edited_cells"))).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), subtract(F.col("cells"), F.col("next_cells"))).alias("near_next"),
        F.size("own").cast("bigint").alias("n_paragraphs"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies", "copy")
