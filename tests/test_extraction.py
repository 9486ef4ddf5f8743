from loomtext.operators import extraction as X

GO = '''package main

import (
\t"fmt"
\tlog "github.com/x/logger"
)

// Server handles requests.
// @note: labels[api,core] category[net] deps[db:users:read] weight=2.5
type Server struct {
\tport int
}

func (s *Server) Start(port int, host string) error {
\tif port == 0 && host != "" {
\t\tfor i := 0; i < 3; i++ {
\t\t\tlog.Info("if for while")
\t\t}
\t}
\treturn helper(port)
}

func helper(n int) error { return nil }
'''
PY = '''from os import path as p, sep
import json

class Dog(Animal):
    """A dog."""
    def bark(self, times):
        for i in range(times):
            if i > 2:
                say(i)

def _private(): pass
LIMIT = 10
'''
JS = '''import React, { useState as us } from 'react';
export class View extends Base {
  async render(a, b) {
    const x = await load(a);
    const y = await load(b);
    for (const q of x) { await save(q); }
  }
}
const add = (a, b) => a + b;
'''


def test_go():
    got = {s["name"]: s for s in X.symbols_of(GO, "go")}
    assert got["Server"]["kind"] == "struct" and got["Server"]["doc"].startswith("Server handles")
    assert (got["Start"]["kind"], got["Start"]["receiver"], got["Start"]["n_params"], got["Start"]["cc"]) == ("method", "Server", 2, 4)
    assert got["Start"]["end_line"] - got["Start"]["line"] == 7 and not got["helper"]["exported"]
    assert [(i["path"], i["name"]) for i in X.imports_of(GO, "go")] == [("fmt", "fmt"), ("github.com/x/logger", "log")]
    refs = {(r["name"], r["on"]) for r in X.references_of(GO, "go")}
    assert ("helper", None) in refs and ("Info", "log") in refs
    (note,) = X.annotations_of(GO, "go")
    assert note["labels"] == ["api", "core"] and note["category"] == "net" and note["hints"] == {"weight": 2.5}
    assert note["deps"] == [{"type": "db", "name": "users", "mode": "read"}]


def test_python():
    got = {s["name"]: s for s in X.symbols_of(PY, "python")}
    assert got["bark"]["kind"] == "method" and got["bark"]["receiver"] == "Dog" and got["bark"]["n_params"] == 1 and got["bark"]["cc"] == 3
    assert got["LIMIT"]["kind"] == "constant" and not got["_private"]["exported"]
    assert [(i["path"], i["name"], i["original"]) for i in X.imports_of(PY, "python")] == [("os", "p", "path"), ("os", "sep", "sep"), ("json", "json", "json")]
    assert ("Animal", "inheritance") in {(r["name"], r["type"]) for r in X.references_of(PY, "python")}
    assert {s["symbol_no"]: s["depth"] for s in X.scopes_of(PY, "python")}[1] == 1


def test_javascript():
    got = {s["name"]: s for s in X.symbols_of(JS, "javascript")}
    assert got["View"]["kind"] == "class" and got["render"]["receiver"] == "View" and got["add"]["kind"] == "function" and got["add"]["n_params"] == 2
    assert {i["name"] for i in X.imports_of(JS, "javascript")} == {"React", "us"}
    issues = {p["issue"] for p in X.performance_of(JS, "javascript")}
    assert issues == {"await_in_loop", "sequential_awaits"}


def test_tables(spark):
    files = spark.createDataFrame([(1, "a/main.go", GO), (2, "a/dog.py", PY), (3, "a/v.js", JS), (4, "x.bin", None), (5, "a/use.py", "from dog import Dog\n"), (6, "e.go", "")], "file_id long, path string, content string")
    found = X.symbols(files).cache()
    assert found.where("file_id in (4, 6)").count() == 0 and found.where("kind = 'method'").count() == 3
    assert X.references(files).where("name = 'helper'").count() == 1
    notes = X.annotated_symbols(found, X.annotations(files)).collect()
    assert [(n["name"], n["labels"]) for n in notes] == [("Server", ["api", "core"])]
    imports = X.imports(files)
    resolved = X.candidate_paths(imports, files)
    kinds = {(r["file_id"], r["import_path"]): (r["target"], r["kind"]) for r in resolved.collect()}
    assert kinds[5, "dog"] == (2, "file") and kinds[2, "json"] == (None, "external")
    assert [(r["name"], r["target"]) for r in X.links(imports, resolved, found).collect()] == [("Dog", 2)]
    assert X.scopes(files).count() == found.count() and X.performance(files).count() > 0
