"""Queries of the extractors over six languages: each part is a source file of one of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import extraction as X
from loomtext.operators import ranking as R
from loomtext.operators import search as S
from loomtext.registry import query
from loomtext.runtime import table
from loomtext.sources import corpus as C

_FILES = {
    "py": "from os import path as p, sep\nimport json\n\nclass Dog{k}(Animal):\n    def bark(self, times):\n        for i in range(times):\n            if i > 2 and times:\n                say(json.loads(i))\n\ndef _private(): pass\nLIMIT = 10\n",
    "js": "import React, { useState as us } from 'react';\nexport class View{k} extends Base {\n  async render(a, b) {\n    const x = await load(a);\n    const y = await load(b);\n    for (const q of x) { await save(q); }\n  }\n}\nconst add = (a, b) => a + b;\n",
    "rs": "use std::io::{Read, Write as W};\npub struct P{k} {\n    n: i32,\n}\nimpl P{k} {\n    pub fn get(&self, i: usize) -> i32 {\n        if i > 1 { 0 } else { self.n }\n    }\n}\nenum Color { Red }\nconst MAX: i32 = 3;\n",
    "java": "package p;\nimport java.util.List;\npublic class C{k} {\n    private int n;\n    public int get(int a, int b) {\n        for (int i = 0; i < a; i++) {\n            if (a > 0 && b > 0) { use(Pattern.compile(b)); }\n        }\n    }\n}\ninterface I{k} {\n}\n",
    "php": "<?php\nuse Foo\\Bar as Baz;\nclass A{k} {\n    public function run($x) {\n        while ($x) { $x--; }\n    }\n}\nfunction free($a, $b) { return 1; }\n",
    "rb": "require 'json'\nclass R{k}\n  def go(x)\n    puts(x) if x\n  end\nend\n",
}
_EXT = list(_FILES)


def sources(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("file_id"), F.concat(F.lit("p/f"), k.cast("string"), F.lit("."), pick(_EXT)).alias("path"), F.replace(pick(list(_FILES.values())), F.lit("{k}"), k.cast("string")).alias("content"))


def _rows(columns: str, rows: list[tuple]) -> str:
    """SQL: the rows of each file; the first column is the language, {k} in texts the file's key."""
    values = ", ".join("(" + ", ".join("NULL" if x is None else repr(x).replace('"', "'") if not isinstance(x, bool) else str(x) for x in r) + ")" for r in rows)
    return f"f AS (SELECT p_partkey AS k, {_EXT}[p_partkey % 6 + 1] AS ext FROM part), v AS (SELECT * FROM (VALUES {values}) v(ext, {columns})), j AS (SELECT f.k AS file_id, v.* FROM f JOIN v USING (ext))"


#: language, number, name, kind, line, end line, receiver, parameters, complexity, cognitive, exported
_SYMBOLS = [
    ("py", 0, "Dog{k}", "class", 4, 8, None, 0, None, None, True),
    ("py", 1, "bark", "method", 5, 8, "Dog{k}", 1, 4, 4, True),
    ("py", 2, "_private", "function", 10, 10, None, 0, 1, 0, False),
    ("py", 3, "LIMIT", "constant", 11, 11, None, 0, None, None, True),
    ("js", 0, "View{k}", "class", 2, 8, None, 0, None, None, True),
    ("js", 1, "render", "method", 3, 7, "View{k}", 2, 2, 1, True),
    ("js", 2, "add", "function", 9, 9, None, 2, 1, 0, True),
    ("rs", 0, "P{k}", "struct", 2, 4, None, 0, None, None, True),
    ("rs", 1, "P{k}", "impl", 5, 9, None, 0, None, None, True),
    ("rs", 2, "get", "method", 6, 8, "P{k}", 1, 2, 1, True),
    ("rs", 3, "Color", "enum", 10, 10, None, 0, None, None, True),
    ("rs", 4, "MAX", "constant", 11, 11, None, 0, None, None, True),
    ("java", 0, "C{k}", "class", 3, 10, None, 0, None, None, True),
    ("java", 1, "n", "field", 4, 4, None, 0, None, None, True),
    ("java", 2, "get", "method", 5, 9, "C{k}", 2, 4, 4, True),
    ("java", 3, "I{k}", "interface", 11, 12, None, 0, None, None, True),
    ("php", 0, "A{k}", "class", 3, 7, None, 0, None, None, True),
    ("php", 1, "run", "method", 4, 6, "A{k}", 1, 2, 1, True),
    ("php", 2, "free", "function", 8, 8, None, 2, 1, 0, True),
    ("rb", 0, "R{k}", "class", 2, 6, None, 0, None, None, True),
    ("rb", 1, "go", "method", 3, 5, "R{k}", 1, 2, 0, True),
]
_NAMED = "replace(name, '{k}', file_id::VARCHAR) AS name"


@query(f"WITH {_rows('symbol_no, name, kind, line, end_line, receiver, n_params, cc, cognitive, exported', _SYMBOLS)} SELECT file_id, symbol_no, {_NAMED}, kind, line, end_line, coalesce(replace(receiver, '{{k}}', file_id::VARCHAR), '') AS receiver, n_params, exported FROM j")
def grammar_symbols(spark, sf_dir):
    return X.symbols(sources(spark, sf_dir)).select("file_id", "symbol_no", "name", "kind", "line", "end_line", F.coalesce("receiver", F.lit("")).alias("receiver"), "n_params", "exported")


@query(f"WITH {_rows('symbol_no, name, kind, line, end_line, receiver, n_params, cc, cognitive, exported', _SYMBOLS)} SELECT file_id, {_NAMED}, cc, cognitive FROM j WHERE cc IS NOT NULL")
def grammar_complexity(spark, sf_dir):
    return X.symbols(sources(spark, sf_dir)).where("cc is not null").select("file_id", "name", "cc", "cognitive")


_IMPORTS = [("py", "os", "p", 1), ("py", "os", "sep", 1), ("py", "json", "json", 2), ("js", "react", "React", 1), ("js", "react", "us", 1), ("rs", "std::io", "Read", 1), ("rs", "std::io", "W", 1), ("java", "java.util.List", "List", 2), ("php", "Foo\\Bar", "Baz", 2), ("rb", "json", "json", 1)]


@query(f"WITH {_rows('path, name, line', _IMPORTS)} SELECT file_id, path, name, line FROM j".replace("Foo\\\\Bar", "Foo\\Bar"))
def grammar_imports(spark, sf_dir):
    return X.imports(sources(spark, sf_dir)).select("file_id", "path", "name", "line")


_SCOPES = [("py", 0, -1, 0), ("py", 1, 0, 1), ("py", 2, -1, 0), ("py", 3, -1, 0), ("js", 0, -1, 0), ("js", 1, 0, 1), ("js", 2, -1, 0), ("rs", 0, -1, 0), ("rs", 1, -1, 0), ("rs", 2, 1, 1), ("rs", 3, -1, 0), ("rs", 4, -1, 0), ("java", 0, -1, 0), ("java", 1, 0, 1), ("java", 2, 0, 1), ("java", 3, -1, 0), ("php", 0, -1, 0), ("php", 1, 0, 1), ("php", 2, -1, 0), ("rb", 0, -1, 0), ("rb", 1, 0, 1)]


@query(f"WITH {_rows('symbol_no, parent_no, depth', _SCOPES)} SELECT file_id, symbol_no, parent_no, depth FROM j")
def grammar_scopes(spark, sf_dir):
    return X.scopes(sources(spark, sf_dir)).select("file_id", "symbol_no", F.coalesce("parent_no", F.lit(-1)).alias("parent_no"), "depth")


_SLOW = [("py", 8, "expensive_call_in_loop", "medium"), ("js", 5, "sequential_awaits", "medium"), ("js", 6, "await_in_loop", "high"), ("java", 7, "expensive_call_in_loop", "medium")]


@query(f"WITH {_rows('line, issue, severity', _SLOW)} SELECT file_id, line, issue, severity FROM j")
def grammar_performance(spark, sf_dir):
    return X.performance(sources(spark, sf_dir)).select("file_id", "line", "issue", "severity")


_CALLS = [("py", "range", 6), ("py", "say", 8), ("py", "loads", 8), ("js", "load", 4), ("js", "load", 5), ("js", "save", 6), ("java", "use", 7), ("java", "compile", 7), ("rb", "puts", 4)]


@query(f"WITH {_rows('name, line', _CALLS)} SELECT file_id, name, line FROM j")
def grammar_references(spark, sf_dir):
    return X.references(sources(spark, sf_dir)).where("type = 'call'").select("file_id", "name", "line")


#: Two modules a part: one imports a function of the other, and one name that it doesn't export.
def modules(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    a = F.struct(F.concat(F.lit("src/x"), k, F.lit("a.js")).alias("path"), F.concat(F.lit("import { f, g } from './x"), k, F.lit("b';\nimport z from 'lib';\n")).alias("content"))
    b = F.struct(F.concat(F.lit("src/x"), k, F.lit("b.js")).alias("path"), F.lit("export function f(a) { return a; }\n").alias("content"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(a, b)).alias("i", "f")).select((F.col("p_partkey") * 2 + F.col("i")).alias("file_id"), "f.path", "f.content")


@query("SELECT p_partkey * 2 AS file_id, './x' || p_partkey || 'b' AS import_path, p_partkey * 2 + 1 AS target, 'file' AS kind FROM part UNION ALL SELECT p_partkey * 2, 'lib', -1, 'external' FROM part")
def import_paths(spark, sf_dir):
    files = modules(spark, sf_dir)
    return X.candidate_paths(X.imports(files), files).select("file_id", "import_path", F.coalesce("target", F.lit(-1)).alias("target"), "kind")


@query("SELECT p_partkey * 2 AS file_id, 'f' AS name, p_partkey * 2 + 1 AS target, 0 AS target_symbol FROM part")
def import_links(spark, sf_dir):
    files = modules(spark, sf_dir)
    found = X.imports(files)
    return X.links(found, X.candidate_paths(found, files), X.symbols(files)).select("file_id", "name", "target", "target_symbol")


def noted(spark, sf_dir):
    k = F.col("p_partkey")
    body = F.concat(F.lit("// @note: labels[core,l"), (k % 3).cast("string"), F.lit("] category[c"), (k % 2).cast("string"), F.lit("] tags[owner=t"), (k % 4).cast("string"), F.lit("] deps[db:users:read,api:mail] weight="), (k % 5).cast("string"), F.lit(".5\nfunc F() {}\n"))
    return table(spark, sf_dir, "part").select(k.alias("file_id"), F.concat(F.lit("p/n"), k.cast("string"), F.lit(".go")).alias("path"), body.alias("content"))


@query("SELECT p_partkey AS file_id, round(p_partkey % 5 + 0.5, 6)::DOUBLE AS weight, 'db:users:read,api:mail:' AS deps FROM part")
def annotation_hints(spark, sf_dir):
    deps = F.array_join(F.transform("deps", lambda d: F.concat_ws(":", d["type"], d["name"], F.coalesce(d["mode"], F.lit("")))), ",")
    return X.annotations(noted(spark, sf_dir)).select("file_id", F.element_at("hints", F.lit("weight")).alias("weight"), deps.alias("deps"))


@query("SELECT p_partkey AS file_id FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0 AND p_partkey % 4 = 2")
def annotation_conjunction(spark, sf_dir):
    from loomtext.operators import context as X2

    return X2.annotation_match(X.annotations(noted(spark, sf_dir)), ["core", "l1"], "c0", {"owner": "t2"}, ["mail"]).select("file_id")


@query("SELECT p_partkey AS id, ['true', '-12', '3.5', 'word'][p_partkey % 4 + 1] AS value, ['boolean', 'integer', 'double', 'string'][p_partkey % 4 + 1] AS kind FROM part")
def typed_values(spark, sf_dir):
    value = F.element_at(F.array(*map(F.lit, ("true", "-12", "3.5", "word"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.typed_value(value).alias("v")).select("id", "v.value", "v.kind")


_MATCHED = [("py", 5, "bark", "method"), ("js", 3, "render", "method"), ("rs", 6, "get", "method"), ("java", 5, "get", "method"), ("php", 4, "run", "method"), ("rb", 3, "go", "method")]


def _symbols_at_depth(files):
    return X.symbols(files).join(X.scopes(files).select("file_id", "symbol_no", "depth"), ["file_id", "symbol_no"])


@query(f"WITH {_rows('line, symbol, kind', _MATCHED)} SELECT file_id, line::BIGINT AS line, symbol, kind FROM j")
def search_symbol_lines(spark, sf_dir):
    files = sources(spark, sf_dir)
    rows = S.matching_lines(files, r"\((self|a|&self|int a|\$x|x)", S.Options(regex=True))
    return S.with_symbols(rows, _symbols_at_depth(files), kinds=["method"], declared=True).select("file_id", "line", "symbol", "kind")


_HELD = [("py", 11, "LIMIT", "constant"), ("rs", 11, "MAX", "constant")]


@query(f"WITH {_rows('line, symbol, kind', _HELD)} SELECT file_id, line::BIGINT AS line, symbol, kind FROM j")
def search_constants(spark, sf_dir):
    files = sources(spark, sf_dir)
    rows = S.matching_lines(files, "=")
    found = S.with_symbols(rows, _symbols_at_depth(files), kinds=["constant", "variable", "field"], declared=True, mutable=False, top_level=True)
    return found.select("file_id", "line", "symbol", "kind")


_INSIDE = [("py", 7, "bark"), ("rs", 7, "get"), ("java", 7, "get"), ("rb", 4, "go")]


@query(f"WITH {_rows('line, symbol', _INSIDE)} SELECT file_id, line::BIGINT AS line, symbol FROM j")
def search_inside_methods(spark, sf_dir):
    files = sources(spark, sf_dir)
    rows = S.matching_lines(files, r"\bif\b", S.Options(regex=True))
    return S.with_symbols(rows, _symbols_at_depth(files), kinds=["method"]).select("file_id", "line", "symbol")


_BLOCKS = [("py", 8, "bark", 5, 8), ("js", 6, "render", 3, 7), ("java", 7, "get", 5, 9), ("php", 5, "run", 4, 6), ("rb", 4, "go", 3, 5), ("rs", 10, "Color", 10, 10)]


@query(f"WITH {_rows('line, symbol, start_line, end_line', _BLOCKS)} SELECT file_id, line::BIGINT AS line, symbol, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, end_line - start_line + 1 AS n_lines FROM j")
def search_block_context(spark, sf_dir):
    files = sources(spark, sf_dir)
    hits = S.matching_lines(files, r"say\(|save\(|Pattern|x--|puts|Red", S.Options(regex=True))
    rows = R.block_context(C.lines(files), hits, X.symbols(files))
    return rows.select("file_id", "line", "symbol", "start_line", "end_line", F.size(F.split("text", "\n")).alias("n_lines"))
