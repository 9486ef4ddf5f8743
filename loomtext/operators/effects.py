"""Side effects of functions from their sources: what each assignment writes.

Statements come from `nesting`. A definition-use join gives the scope of the root of every written target (`b` of
`b.items[0] = x`): the innermost function around the write that defines the name as a parameter or a local. A write
to a parameter's parts is a parameter write, to the receiver's (or to a field of the class, by its bare name) a
receiver write, to a name of a function further out a closure write; a name that no function around defines is global.
Assigning to a parameter or a local itself is no effect. Throwing, channels, waiting and output are read from the
statement's words. Calls aren't followed here; `graph.propagate_effects` does that with these masks.

A function's own statements are those that no inner function holds. Of several targets on the left of `:=`, or of
Python's `=`, all are definitions; of other assignments the first target counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import nesting as N
from loomtext.operators.measures import EFFECTS
from loomtext.runtime import Scratch

_N = r"[\p{L}_$][\p{L}\p{N}_$]*"
_PARTS = r"(?:\)?(?:\.|\[|->|\?\.)[^=]*?)?"
_OPERATOR = r"(?:[-+*/%&|^]|<<|>>|\?\?|\|\||&&|//|\*\*)?="
#: Target of an assignment or of an increment: its root, and its parts if it has any.
WRITE = rf"^(\(?\*)?({_N})({_PARTS})\s*(?:{_OPERATOR}(?![=>])|\+\+$|--$)"
#: (languages, names that a statement defines, comma-separated).
DEFINES = (
    (("go",), rf"^(?:for\s+|if\s+|switch\s+)?({_N}(?:\s*,\s*{_N})*)\s*:="),
    (("go",), rf"^var\s+({_N})"),
    (("typescript", "javascript"), rf"^(?:for\s*\(\s*)?(?:const|let|var)\s+({_N})"),
    (("rust",), rf"^let\s+(?:mut\s+)?({_N})"),
    (("python",), rf"^(?:for\s+)?({_N}(?:\s*,\s*{_N})*)\s*(?::[^=]*)?(?:=(?!=)|\bin\b)"),
    (("java", "csharp"), rf"^(?:for\s*\(\s*)?(?:final\s+|var\s+)?(?:{_N}(?:<[^=;]*>)?(?:\[\])?\s+)?({_N})\s*(?:=(?!=)|;$)"),
)
#: What else a statement does: (languages or none for all, effect, pattern).
WORDS = (
    ((), "throws", r"^(?:throw|raise)\b|^panic\("),
    (("go",), "channel", r"<-"),
    ((), "async", r"\bawait\b"),
    (("go",), "async", rf"^go\s+{_N}"),
    ((), "io", r"\b(?:fmt\.Print\w*|print|println!?|console\.\w+|System\.out\.\w+|Console\.Write\w*)\s*\("),
)
_RESERVED = ("return", "if", "else", "for", "while", "switch", "case", "var", "let", "const", "go", "defer", "new", "throw", "raise", "await")


def functions(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """file_id, fn, name, line, end_line, language, receiver, params of every function and method. declared: the
    declarations of the files, if they are at hand."""
    declared = N.declarations(files) if declared is None else declared
    rows = declared.where("kind IN ('function', 'method')").join(files.select("file_id", "language"), "file_id")
    inside = r"((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)"
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_$])\Q"), "name", F.lit(rf"\E\s*(?:<[^()]*>|\[[^()]*\])?\s*(?:=\s*(?:async\s*)?)?\({inside}\)"))
    listed = F.call_function("regexp_extract", F.col("signature"), pattern, F.lit(1))
    for nested in (r"\([^()]*\)", r"\([^()]*\)", r"<[^<>]*>", r"<[^<>]*>", r"\[[^\[\]]*\]", r"\{[^{}]*\}"):
        listed = F.regexp_replace(listed, nested, "")
    last = F.col("language").isin("java", "csharp")

    def name_of(p: Column) -> Column:
        p = F.trim(F.regexp_replace(p, r"=.*$", ""))
        first = F.regexp_extract(F.regexp_replace(p, r"^(?:(?:public|private|protected|readonly|mut)\s+|\.\.\.|[*&]+\s*)+", ""), rf"^({_N})", 1)
        return F.when(last, F.regexp_extract(p, rf"({_N})$", 1)).otherwise(first)

    names = F.filter(F.transform(F.split(listed, ","), name_of), lambda p: ~p.isin("", "self", "this", "cls"))
    receiver = F.when(F.col("language") == "go", F.regexp_extract("signature", rf"^func\s*\(\s*({_N})\s", 1)).when(F.col("language").isin("python", "rust"), "self").otherwise("this")
    return rows.select("file_id", F.col("stmt").alias("fn"), "name", "line", "end_line", "language", receiver.alias("receiver"), names.alias("params"))


def _placed(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Statements with the innermost function around them (not the one that they declare)."""
    held = rows.join(scopes.select("file_id", "fn", F.col("line").alias("f_line"), "end_line"), "file_id").where("line BETWEEN f_line AND end_line AND stmt != fn")
    inner = held.groupBy("file_id", "stmt").agg(F.max_by("fn", F.struct("f_line", "fn")).alias("fn"))
    return rows.join(inner, ["file_id", "stmt"])


def facts(files: DataFrame, declared: DataFrame | None = None, said: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """file_id, fn, line, effect, target: one row for each effect of a function's own statements. said, scopes: the
    statements and the functions of the files, if they are at hand."""
    scratch = Scratch(files.sparkSession, "effects")
    said = scratch.write(N.statements(files), "all") if said is None else said
    declared = scratch.write(N.declarations(files, said), "declared") if declared is None else declared
    scopes = scratch.write(functions(files, declared), "functions") if scopes is None else scopes
    body = F.trim(F.regexp_replace("text", r"\s*[;}]+$", ""))
    rows = scratch.write(_placed(said.select("file_id", "language", "stmt", "line", body.alias("text")), scopes), "statements")
    of = lambda langs: F.col("language").isin(*langs) if langs else F.lit(True)
    shared = F.col("text").rlike(r"^(?:global|nonlocal)\b")
    outer = rows.where(shared).select("file_id", "fn", F.explode(F.split(F.regexp_replace("text", r"^\w+\s+", ""), r"\s*,\s*")).alias("name"))
    defined = F.coalesce(*[F.when(of(langs) & F.col("text").rlike(rx), F.regexp_extract("text", rx, 1)) for langs, rx in DEFINES])
    bare = F.col("language").isin("java", "csharp") & F.col("text").rlike(rf"^{_N}\s*=")  # no type: a write, not a definition
    local = rows.where(defined.isNotNull() & ~bare).select("file_id", "fn", F.explode(F.split(defined, r"\s*,\s*")).alias("name")).join(outer, ["file_id", "fn", "name"], "left_anti").withColumn("role", F.lit("local"))
    params = scopes.select("file_id", "fn", F.explode("params").alias("name")).withColumn("role", F.lit("param"))
    names = params.union(local).groupBy("file_id", "fn", "name").agg(F.min_by("role", F.when(F.col("role") == "param", 0).otherwise(1)).alias("role"))
    places = names.join(scopes.select("file_id", "fn", "line", "end_line"), ["file_id", "fn"]).select("file_id", F.col("fn").alias("in"), F.col("name").alias("root"), "role", F.col("line").alias("from"), F.col("end_line").alias("to"))
    root, parts = F.regexp_extract("text", WRITE, 2), F.concat(F.regexp_extract("text", WRITE, 1), F.regexp_extract("text", WRITE, 3))
    writes = rows.where(F.col("text").rlike(WRITE) & ~root.isin(*_RESERVED)).select("file_id", "language", "stmt", "line", "fn", root.alias("root"), parts.alias("parts"))
    writes = writes.join(scopes.select("file_id", "fn", "receiver"), ["file_id", "fn"])
    seen = writes.join(places, ["file_id", "root"], "left").where("`in` IS NULL OR line BETWEEN `from` AND `to`")
    near = seen.groupBy("file_id", "stmt").agg(F.max_by(F.struct("in", "role"), F.struct(F.coalesce("from", F.lit(-1)), F.coalesce("in", F.lit(-1)))).alias("d"))
    fields = declared.where("kind IN ('field', 'property') AND parent_kind = 'class'").select("file_id", F.col("name").alias("root")).distinct().withColumn("field", F.lit(True))
    found = writes.join(near, ["file_id", "stmt"], "left").join(fields, ["file_id", "root"], "left")
    whole = F.col("parts") == ""
    effect = (
        F.when((F.col("root") == F.col("receiver")) & ~whole, "receiver_write")
        .when(F.col("d.in") == F.col("fn"), F.when((F.col("d.role") == "param") & ~whole, "param_write"))
        .when(F.col("d.in").isNotNull(), "closure_write")
        .when(F.col("field") & F.col("language").isin("java", "csharp"), "receiver_write")
        .otherwise("global_write")
    )
    written = found.select("file_id", "fn", "line", effect.alias("effect"), F.concat("root", "parts").alias("target")).where("effect IS NOT NULL")
    said = rows.select("file_id", "fn", "line", F.explode(F.array_compact(F.array(*[F.when(of(langs) & F.col("text").rlike(rx), F.lit(e)) for langs, e, rx in WORDS]))).alias("effect")).withColumn("target", F.lit(None).cast("string"))
    return written.union(said)


def masks(files: DataFrame) -> DataFrame:
    """file_id, fn, name, mask: the effects of each function, 0 for none; the bits are those of measures.EFFECTS."""
    scratch = Scratch(files.sparkSession, "masks")
    said = scratch.write(N.statements(files), "all")
    declared = scratch.write(N.declarations(files, said), "declared")
    scopes = scratch.write(functions(files, declared), "functions")
    own = facts(files, declared, said, scopes)
    bits = F.element_at(F.create_map(*[F.lit(x) for kv in EFFECTS.items() for x in kv]), F.col("effect"))
    per = own.groupBy("file_id", "fn").agg(F.bit_or(bits).alias("mask"))
    return scopes.select("file_id", "fn", "name").join(per, ["file_id", "fn"], "left").na.fill(0, ["mask"])
