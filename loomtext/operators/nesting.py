"""Source structure: tokens, brackets, statements, declarations.

`tokens` cuts a file with one regex a language family, in which comments and strings are tokens of their own, so
nothing inside them counts later. `brackets` pairs brackets by running depth: on one level of a file openings and
closings alternate, so a `lead` finds the partner. `statements` cuts each file by the same rules in one pass, without a
token table, and joins tokens to the end of a logical line: line
breaks inside parentheses, before a continuation and after an operator don't end one, so a signature over many lines
is one statement; blocks (braces, and Go's `const (`) nest statements. In languages that nest by indentation a
statement's block ends before the next one that is not deeper. `declarations` reads statements with rules of plain
regexes; decorators, attributes and annotations before a declaration belong to it. `content_ranges` gives byte ranges
of code, comments and strings.

A file is one row and its tokens are one group, so a task holds the largest file. Files of unknown languages have
tokens of the C family.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.runtime import Scratch, ship_package

#: Files whose statements are held at once.
FILES_A_SLICE = 64
#: Languages that nest by indentation and comment with `#`.
INDENTED = ("python",)
_STRING = r"\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"?"
_QUOTE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
_REST = r"[\p{L}_$][\p{L}\p{N}_$]*|[0-9][0-9A-Za-z_.]*|\n|[^\S\n]+|\+\+|--|[^\s\p{L}\p{N}_$]"
#: Tokens of each family; every character of a text belongs to one.
LEXERS = {
    "c": rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|{_STRING}|{_QUOTE}|`[^`]*+`?|{_REST}",
    "rust": rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|{_STRING}|'(?:[^'\\\n]|\\[^\n']{{1,10}}|\\')'|{_REST}",
    "python": rf"#[^\n]*|[rRbBuUfF]{{0,2}}\"\"\"[\s\S]*?(?:\"\"\"|\z)|[rRbBuUfF]{{0,2}}'''[\s\S]*?(?:'''|\z)|{_STRING}|{_QUOTE}|\\\n|{_REST}",
}
FAMILY = {"python": "python", "rust": "rust"}
#: Words that go on with the statement of the line before, where a line starts with them.
GOES_ON = ("throws", "extends", "implements", "where", "permits")
#: Marks at a line's end that leave its statement open.
OPEN_END = ("=", "|", "&", "+", "<")


def tokens(files: DataFrame) -> DataFrame:
    """file_id, language, no, text, kind, line, byte (both of the token's start): all tokens, spaces too."""
    family = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv]), F.col("language")), F.lit("c"))
    cut = F.coalesce(*[F.when(family == name, F.regexp_extract_all("content", F.lit(rx), F.lit(0))) for name, rx in LEXERS.items()])
    each = files.select("file_id", "language", family.alias("family"), F.posexplode(cut).alias("no", "text"))
    t, first = F.col("text"), F.substring("text", 1, 1)
    comment = t.startswith("//") | t.startswith("/*") | ((F.col("family") == "python") & t.startswith("#"))
    kind = (
        F.when((F.col("family") != "python") & comment | (F.col("family") == "python") & t.startswith("#"), "comment")
        .when(first.isin('"', "'", "`") & (F.char_length(t) > 1) | t.rlike(r"^[rRbBuUfF]{0,2}(\"\"\"|''')"), "string")
        .when(t == "\n", "newline")
        .when(t.rlike(r"^(\s|\\\n)"), "space")
        .when(t.rlike(r"^[\p{L}_$]"), "word")
        .when(t.rlike(r"^[0-9]"), "number")
        .when(t.isin("(", "[", "{"), "open")
        .when(t.isin(")", "]", "}"), "close")
        .otherwise("mark")
    )
    before = Window.partitionBy("file_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.coalesce(F.sum(F.regexp_count("text", F.lit("\n"))).over(before), F.lit(0)) + 1
    return each.select("file_id", "language", "no", "text", kind.alias("kind"), lines.cast("int").alias("line"), F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("long").alias("byte"))


def brackets(rows: DataFrame) -> DataFrame:
    """The tokens with depth (brackets open before the token, a closing one's own not counted), partner (no of the
    bracket that closes an opening one, or opened a closing one; null without), close_line (of an opening one), inner (round and square brackets
    open behind it) and block (braces outside of these, and a Go parenthesis after const, var, type or import)."""
    order = Window.partitionBy("file_id").orderBy("no")
    significant = F.when(~F.col("kind").isin("space", "comment", "newline"), F.col("text"))
    before = F.last(significant, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    after = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("before", before).withColumn("depth", F.when(F.col("kind") == "open", after - 1).otherwise(after).cast("int"))
    bracket = F.col("kind").isin("open", "close")
    level = Window.partitionBy("file_id", F.when(bracket, F.col("depth")), bracket).orderBy("no")
    pair = F.when((F.col("kind") == "open") & (F.lead("kind").over(level) == "close"), F.lead("no").over(level)).when((F.col("kind") == "close") & (F.lag("kind").over(level) == "open"), F.lag("no").over(level))
    grouping = (F.col("language") == "go") & (F.col("text") == "(") & F.coalesce(F.col("before").isin("const", "var", "type", "import"), F.lit(False))
    rows = rows.withColumn("partner", F.when(bracket, pair)).withColumn("_group", grouping)
    rows = rows.withColumn("close_line", F.when((F.col("kind") == "open") & F.col("partner").isNotNull(), F.lead("line").over(level)))
    rows = rows.withColumn("_group", F.col("_group") | (F.col("kind") == "close") & F.coalesce(F.lag("_group").over(level), F.lit(False)))
    round_ = F.when(F.col("text").isin("(", "[") & ~F.col("_group"), 1).when(F.col("text").isin(")", "]") & ~F.col("_group"), -1).otherwise(0)
    rows = rows.withColumn("inner", F.sum(F.when(bracket, round_).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return rows.withColumn("block", F.col("_group") | bracket & F.col("text").isin("{", "}") & (F.col("inner") <= 0)).drop("_group")


_SPACE = " \\t\\n\\x0b\\f\\r"
#: The lexers for Python's `re`: kinds as groups; what is none of the others is a mark.
_CUT = {
    name: re.compile(
        rf"(?P<comment>{comment})|(?P<string>{string})|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>[0-9][0-9A-Za-z_.]*)|(?P<newline>\n)|(?P<space>{space}[ \t\x0b\f\r]+)|(?P<mark>\+\+|--|[\s\S])"
    )
    for name, comment, string, space in (
        ("c", r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", rf"{_STRING}|{_QUOTE}|`[^`]*+`?", ""),
        ("rust", r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", rf"{_STRING}|'(?:[^'\\\n]|\\[^\n']{{1,10}}|\\')'", ""),
        ("python", r"#[^\n]*", rf"[rRbBuUfF]{{0,2}}\"\"\"[\s\S]*?(?:\"\"\"|\Z)|[rRbBuUfF]{{0,2}}'''[\s\S]*?(?:'''|\Z)|{_STRING}|{_QUOTE}", r"\\\n|"),
    )
}
_WHITE = re.compile(rf"(?:\\\n|[{_SPACE}])+")
_ALONE = ("}", ")", "};", ";")


def _cut_statements(content: str, language: str) -> list[dict]:
    """The statements of one file in order, without parent and end_line."""
    indented, depth, inner, level, line, before = language in INDENTED, 0, 0, 0, 1, None
    rows: list[list] = []  # kind, text, line, block, level behind it, outside, before
    openers: dict[int, list] = {}  # the last bracket of each depth, if it opens: [row, whether it groups]
    closes: dict[int, int] = {}
    for m in _CUT[FAMILY.get(language, "c")].finditer(content):
        kind, text = m.lastgroup, m[0]
        here, line = line, line + text.count("\n")
        if kind == "comment":
            continue
        block = False
        if kind == "mark" and text in "()[]{}":
            opens = text in "([{"
            if opens:
                grouping = language == "go" and text == "(" and before in ("const", "var", "type", "import")
                openers[depth] = [len(rows), grouping]
                depth += 1
            else:
                depth -= 1
                at, grouping = openers.pop(depth, (None, False))
                if at is not None:
                    closes[at] = here
            if text in "()[]" and not grouping:
                inner += 1 if opens else -1
            block = not indented and (grouping or text in "{}" and inner <= 0)
            if block:
                level += 1 if opens else -1
        rows.append([kind, text, here, block, level, (depth if indented else inner) <= 0, before])
        if kind not in ("space", "newline"):
            before = text
    out, after, ends = [], None, [False] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        kind, text, _, block, _, outside, before = rows[i]
        goes_on = after in GOES_ON or after in ("{", ".") or before in OPEN_END
        ends[i] = block or outside and (text == ";" or kind == "newline" and (indented or not goes_on))
        if kind not in ("space", "newline"):
            after = text
    start = 0
    for i in range(len(rows)):
        if not ends[i] and i + 1 < len(rows):
            continue
        own = rows[start : i + 1]
        said = [r[2] for r in own if r[0] not in ("space", "newline")]
        if said and (text := _WHITE.sub(" ", "".join(r[1] for r in own)).strip(" ")) not in _ALONE:
            opener = [start + j for j, r in enumerate(own) if r[3] and r[1] in "([{"]
            # a statement that is a brace alone was counted inside its own block
            on = own[0][4] - bool(opener and text in ("{", "("))
            out.append({"text": text, "line": said[0], "last_line": said[-1], "level": on, "opens": bool(opener), "end_line": max((closes[j] for j in opener if j in closes), default=said[-1]), "indent": len(own[0][1]) if own[0][0] == "space" else 0})
        start = i + 1
    return out


def _statements_of(content: str, language: str) -> list[dict]:
    """The statements of one file with stmt, parent and end_line."""
    rows = _cut_statements(content, language)
    if language not in INDENTED:
        opened: dict[int, int] = {}  # the last statement that opened a level
        for no, r in enumerate(rows):
            r["stmt"], r["parent"] = no, opened.get(r["level"]) if r["level"] > 0 else None
            if r["opens"]:
                opened[r["level"] + 1] = no
        return rows
    widths = {w: i for i, w in enumerate(sorted({r["indent"] for r in rows}))}
    last: dict[int, int] = {}  # the last statement of each width
    waiting: list[dict] = []  # blocks that may go on
    for no, r in enumerate(rows):
        r["stmt"], r["level"], r["opens"] = no, widths[r["indent"]], r["text"].endswith(":")
        r["parent"] = max((at for w, at in last.items() if w < r["indent"]), default=None)
        last[r["indent"]] = no
        while waiting and waiting[-1]["indent"] >= r["indent"]:
            waiting.pop()["end_line"] = rows[no - 1]["last_line"]
        waiting.append(r)
    for r in waiting:
        r["end_line"] = rows[-1]["last_line"]
    return rows


_COLUMNS = {"stmt": (T.LongType(), pa.int64()), "text": (T.StringType(), pa.string()), "line": (T.IntegerType(), pa.int32()), "last_line": (T.IntegerType(), pa.int32()), "end_line": (T.IntegerType(), pa.int32()), "level": (T.LongType(), pa.int64()), "parent": (T.LongType(), pa.int64()), "opens": (T.BooleanType(), pa.bool_())}


def statements(files: DataFrame) -> DataFrame:
    """file_id, language, stmt (number in the file), text (comments left out, white space as one space), line,
    last_line (of its own text), end_line (of its block, else last_line), level (blocks around it), parent (stmt
    whose block it stands in), opens (whether it has a block). Files of no language have none.

    Files are cut one by one in Arrow batches, dealt by file_id, as a table of few partitions may hold very many:
    a file's tokens are far more than its statements, and are neither rows nor shuffled.
    """
    ship_package(files.sparkSession)
    schema = T.StructType([files.schema["file_id"], T.StructField("language", T.StringType()), *[T.StructField(c, t) for c, (t, _) in _COLUMNS.items()]])
    arrow = pa.schema([(c, t) for c, (_, t) in _COLUMNS.items()])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, FILES_A_SLICE):
                some, found, owners = batch.slice(lo, FILES_A_SLICE), [], []
                for i in range(some.num_rows):
                    own = _statements_of(some.column(2)[i].as_py(), some.column(1)[i].as_py())
                    found += own
                    owners += [i] * len(own)
                at = pa.array(owners, pa.int32())
                columns = pa.Table.from_pylist(found, arrow).combine_chunks().columns
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), *[x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in columns]], names=schema.names)

    return files.where("language IS NOT NULL AND content IS NOT NULL").select("file_id", "language", "content").repartition("file_id").mapInArrow(run, schema)


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|readonly|partial|export|default|declare|pub(?:\([a-z]+\))?|unsafe|const|extern|open|data|inline)\s+)*"
_INSIDE = r"[^<>(){}=;]"
_BALANCED = rf"<(?:{_INSIDE}|<(?:{_INSIDE}|<{_INSIDE}*>)*>)*>"
_ANGLES = rf"(?:\s*{_BALANCED})?"
_N = r"([\p{L}_$][\p{L}\p{N}_$]*)"
#: (languages, kind, pattern with the name as its group), the first that fits; tried on the text without decorators.
RULES = (
    (("go",), "method", rf"^func\s*\([^)]*\)\s*{_N}"),
    (("go",), "function", rf"^func\s+{_N}"),
    (("go",), "struct", rf"^(?:type\s+)?{_N}(?:\s*\[[^\]]*\])?\s+struct\b"),
    (("go",), "interface", rf"^(?:type\s+)?{_N}(?:\s*\[[^\]]*\])?\s+interface\b"),
    (("go",), "type", rf"^type\s+{_N}"),
    (("go",), "constant", rf"^const\s+{_N}"),
    (("go",), "variable", rf"^var\s+{_N}"),
    (("python",), "class", rf"^class\s+{_N}"),
    (("python",), "function", rf"^(?:async\s+)?def\s+{_N}"),
    (("python",), "constant", r"^([A-Z][A-Z0-9_]+)\s*(?::[^=]*)?=(?!=)"),
    (("rust",), "function", rf"^{_MODS}fn\s+{_N}"),
    (("rust",), "struct", rf"^{_MODS}struct\s+{_N}"),
    (("rust",), "enum", rf"^{_MODS}enum\s+{_N}"),
    (("rust",), "trait", rf"^{_MODS}trait\s+{_N}"),
    (("rust",), "impl", rf"^impl{_ANGLES}\s+(?:[\p{{L}}_][\p{{L}}\p{{N}}_:]*{_ANGLES}\s+for\s+)?{_N}"),
    (("rust",), "constant", rf"^(?:pub(?:\([a-z]+\))?\s+)?(?:const|static)\s+(?:mut\s+)?{_N}\s*:"),
    (("typescript", "javascript", "java", "csharp", "kotlin"), "interface", rf"^{_MODS}interface\s+{_N}"),
    (("typescript", "javascript", "java", "csharp", "kotlin"), "enum", rf"^{_MODS}enum\s+(?:class\s+)?{_N}"),
    (("typescript", "javascript", "java", "csharp", "kotlin"), "class", rf"^{_MODS}(?:class|record|struct)\s+{_N}"),
    (("typescript", "javascript"), "function", rf"^{_MODS}function\s*\*?\s*{_N}"),
    (("kotlin",), "function", rf"^{_MODS}fun\s+(?:<[^>]*>\s*)?{_N}"),
    (("typescript",), "type", rf"^{_MODS}type\s+{_N}{_ANGLES}\s*="),
    (("typescript", "javascript"), "function", rf"^(?:export\s+)?(?:const|let|var)\s+{_N}\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\([^()]*\)|{_N})\s*(?::[^=]*)?=>"),
    (("typescript", "javascript"), "constant", rf"^(?:export\s+)?const\s+{_N}"),
    (("typescript", "javascript"), "variable", rf"^(?:export\s+)?(?:let|var)\s+{_N}"),
)
#: Members, by the kind of what they stand in: (languages, kinds around, kind, pattern).
MEMBERS = (
    (("go",), ("constants",), "constant", rf"^{_N}\b"),
    (("go",), ("variables",), "variable", rf"^{_N}\b"),
    (("go",), ("types",), "type", rf"^{_N}\b"),
    (("go",), ("struct",), "field", rf"^{_N}\s+[\p{{L}}_*\[(]"),
    (("go",), ("interface",), "method", rf"^{_N}\s*\("),
    (("rust",), ("struct",), "field", rf"^(?:pub(?:\([a-z]+\))?\s+)?{_N}\s*:"),
    (("rust",), ("enum",), "member", rf"^{_N}\b"),
    (("java", "csharp"), ("class", "interface"), "method", rf"^{_MODS}(?:<[^()]*>\s*)?(?:[\p{{L}}_][\p{{L}}\p{{N}}_.]*(?:<[^()]*>)?(?:\[\])?\??\s+)?{_N}{_ANGLES}\s*\("),
    (("csharp",), ("class", "interface"), "property", rf"^{_MODS}[\p{{L}}_][\p{{L}}\p{{N}}_.<>,?\[\] ]*\s+{_N}\s*\{{"),
    (("java", "csharp"), ("class",), "field", rf"^{_MODS}[\p{{L}}_][\p{{L}}\p{{N}}_.<>,?\[\] ]*\s+{_N}\s*(?:=|;)"),
    (("typescript", "javascript"), ("class", "interface"), "method", rf"^{_MODS}(?:get\s+|set\s+|\*\s*)?{_N}\??{_ANGLES}\s*\("),
    (("typescript", "javascript"), ("class", "interface"), "property", rf"^{_MODS}{_N}[?!]?\s*(?::|=|;|$)"),
)
#: Go's grouped declarations are kinds of their own, which hold members and aren't symbols.
GROUPS = (("constants", r"^const\s*\($"), ("variables", r"^var\s*\($"), ("types", r"^type\s*\($"), ("imports", r"^import\s*\($"))
#: Words that look like a method's name before a parenthesis.
NOT_NAMES = ("if", "for", "while", "switch", "catch", "return", "new", "throw", "await", "else", "do", "using", "lock", "foreach", "function", "super", "this")
_DECORATED = r"^(?:(?:@[\p{L}_][\p{L}\p{N}_.]*(?:\((?:[^()]|\([^()]*\))*\))?|#!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]|\[[\p{L}_](?:[^\[\]]|\[[^\[\]]*\])*\])\s*)+"


def declarations(files: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """file_id, stmt, name, kind, line, end_line, level, parent_name, parent_kind, signature, generics,
    decorators, exported of every declaration. said: the statements of the files, if they are at hand."""
    rows = statements(files) if said is None else said
    first = F.regexp_extract("text", _DECORATED, 0)
    first = F.when(F.col("language") == "go", "").otherwise(first)
    rows = rows.withColumn("_own", F.trim(first)).withColumn("body", F.expr("substring(text, char_length(_own) + 1)")).withColumn("body", F.trim("body"))
    order = Window.partitionBy("file_id").orderBy("stmt")
    # decorators alone on their lines go to the next statement that is none
    run = F.coalesce(F.count_if(F.col("body") != "").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_run", run)
    inside = Window.partitionBy("file_id", "_run").orderBy("stmt").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("decorators", F.array_join(F.filter(F.collect_list("_own").over(inside), lambda x: x != ""), " ")).where("body != ''")
    named = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    grouped = [F.when((F.col("language") == "go") & F.col("body").rlike(rx), F.lit(kind)) for kind, rx in GROUPS]
    read = [F.when(g.isNotNull(), named(kind, F.lit(None).cast("string"))) for g, (kind, _) in zip(grouped, GROUPS, strict=True)]
    read += [F.when(F.col("language").isin(*langs) & F.col("body").rlike(rx), named(kind, F.regexp_extract("body", rx, 1))) for langs, kind, rx in RULES]
    rows = rows.withColumn("_read", F.coalesce(*read)).withColumns({"kind": F.col("_read.kind"), "name": F.col("_read.name")}).drop("_read")
    scratch = Scratch(files.sparkSession, "declarations")
    rows = scratch.write(rows, "read")
    around = rows.select("file_id", F.col("stmt").alias("parent"), F.col("kind").alias("parent_kind"), F.col("name").alias("parent_name"))
    rows = rows.join(around, ["file_id", "parent"], "left")
    fits = lambda langs, kinds_around, rx: F.col("language").isin(*langs) & F.col("parent_kind").isin(*kinds_around) & F.col("body").rlike(rx) & ~F.regexp_extract("body", rx, 1).isin(*NOT_NAMES)
    member = [F.when(fits(langs, near, rx), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("body", rx, 1).alias("name"))) for langs, near, kind, rx in MEMBERS]
    own = F.when(F.col("name").isNotNull(), F.struct("kind", "name"))
    method = F.when((F.col("parent_kind").isin("class", "impl", "trait")) & (own["kind"] == "function") & F.col("language").isin("python", "rust", "kotlin"), F.struct(F.lit("method").alias("kind"), own["name"].alias("name")))
    # exploded, so that conditions on what was found don't read the statement again
    found = F.coalesce(method, F.when(F.coalesce(*grouped).isNull(), F.coalesce(own, *member)))
    rows = rows.withColumn("found", F.explode(F.array_compact(F.array(found))))
    local = F.col("parent").isNotNull() & F.coalesce(~F.col("parent_kind").isin("class", "interface", "trait", "impl", "struct", "enum", *[k for k, _ in GROUPS]), F.lit(True))
    rows = scratch.write(rows.where(~(F.col("found.kind").isin("constant", "variable") & local)).drop("parent_kind", "parent_name"), "found")
    scratch.drop("read")
    around = rows.select("file_id", F.col("stmt").alias("parent"), F.col("found.kind").alias("parent_kind"), F.col("found.name").alias("parent_name"))
    rows = rows.join(around, ["file_id", "parent"], "left")
    name = F.col("found.name")
    after = F.concat(F.lit(r"(?<![\p{L}\p{N}_$])\Q"), name, F.lit(rf"\E\s*({_BALANCED}|\[[\p{{L}}_][^\[\]]*\s[^\[\]]*\])"))
    generics = F.call_function("regexp_extract", F.col("body"), after, F.lit(1))
    exported = F.when(F.col("language") == "go", name.rlike(r"^\p{Lu}")).when(F.col("language") == "python", ~name.startswith("_")).when(F.col("language") == "rust", F.col("body").startswith("pub")).when(F.col("language").isin("java", "csharp"), F.col("body").rlike(r"^(?:[a-z]+\s+)*public\b")).otherwise(F.col("body").startswith("export"))
    return rows.select("file_id", "stmt", name.alias("name"), F.col("found.kind").alias("kind"), "line", "end_line", F.col("level").cast("int").alias("level"), "parent_name", "parent_kind", F.trim(F.regexp_replace("body", r"\s*[{:]?$", "")).alias("signature"), generics.alias("generics"), "decorators", exported.alias("exported"))


def content_ranges(files: DataFrame) -> DataFrame:
    """file_id, kind (code, comment, string), start, end: bytes, end exclusive; neighbours of one kind are one."""
    kind = F.when(F.col("kind").isin("comment", "string"), F.col("kind")).otherwise("code")
    rows = tokens(files).withColumn("kind", kind).withColumn("stop", F.col("byte") + F.octet_length("text"))
    order = Window.partitionBy("file_id").orderBy("no")
    changed = (F.coalesce(F.lag("kind").over(order), F.lit("")) != F.col("kind")).cast("int")
    rows = rows.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(order))
    return rows.groupBy("file_id", "run", "kind").agg(F.min("byte").alias("start"), F.max("stop").alias("end")).drop("run")
