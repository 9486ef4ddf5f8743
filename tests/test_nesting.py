"""Tokens, brackets, statements and declarations of sources that nest."""

import pytest

from loomtext.operators import nesting as N


def files(spark, *rows):
    return spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "file_id long, language string, content string")


def names(spark, lang, text):
    return [(r["name"], r["kind"], r["line"], r["end_line"], r["parent_name"]) for r in N.declarations(files(spark, (lang, text))).orderBy("line", "stmt").collect()]


def test_every_character_is_a_token(spark):
    odd = ["", "a\n", "x = \"open\ny", "/* open", "'''open", "\\\n", "a 'b\\'c' `d\ne` é\U0001f600 // z", "\r\n\t \u00a0", "#"]
    for lang in ("go", "python", "rust"):
        rows = N.tokens(files(spark, *[(lang, t) for t in odd])).orderBy("file_id", "no").collect()
        for i, t in enumerate(odd):
            own = [r for r in rows if r["file_id"] == i]
            assert "".join(r["text"] for r in own) == t
            at = 0
            for r in own:
                assert (r["byte"], r["line"]) == (at, t.encode()[:at].count(b"\n") + 1)
                at += len(r["text"].encode())


def test_brackets_pair_by_level(spark):
    text = "f(a[1], {b: (c)}) } ("
    rows = {r["no"]: r for r in N.brackets(N.tokens(files(spark, ("javascript", text)))).collect()}
    stack, want = [], {}
    for no in sorted(rows):
        if rows[no]["kind"] == "open":
            stack.append(no)
        elif rows[no]["kind"] == "close" and stack:
            opened = stack.pop()
            want[opened], want[no] = no, opened
    assert {no: r["partner"] for no, r in rows.items() if r["partner"] is not None} == want


def test_go_groups_and_locals(spark):
    text = "import (\n\t\"os\"\n)\nvar (\n\tA int\n\tb = 2 // c\n)\ntype (\n\tP struct {\n\t\tx, y int\n\t}\n\tQ interface {\n\t\tDo(\n\t\t\ta int,\n\t\t) error\n\t}\n)\nfunc F(g func(a int) {\n}) {\n\tvar local = 1\n}\n"
    got = names(spark, "go", text)
    assert ("A", "variable", 5, 5, None) in got and ("b", "variable", 6, 6, None) in got
    assert ("P", "struct", 9, 11, None) in got and ("Do", "method", 13, 15, "Q") in got
    assert ("F", "function", 18, 21, None) in got and "local" not in {n for n, *_ in got}


def test_python_blocks_end_with_their_indentation(spark):
    text = "class A:\n    def f(self):\n        def g():\n            return 1\n\n        return g\n    # note\n    async def h(self,\n                x): pass\nB_C = 1\nif x:\n  class D: pass\n"
    assert names(spark, "python", text) == [("A", "class", 1, 9, None), ("f", "method", 2, 6, "A"), ("g", "function", 3, 4, "f"), ("h", "method", 8, 9, "A"), ("B_C", "constant", 10, 10, None), ("D", "class", 12, 12, None)]


def test_braces_on_their_own_line_and_unbalanced_files(spark):
    assert names(spark, "csharp", "class A\n{\n  void F()\n  {\n  }\n}\n") == [("A", "class", 1, 6, None), ("F", "method", 3, 5, "A")]
    assert names(spark, "java", "class A {\n int f(\n")[0][:3] == ("A", "class", 1)
    assert names(spark, "java", "}}}\nclass B {}\n") == [("B", "class", 2, 2, None)] or names(spark, "java", "}}}\nclass B {}\n")[0][0] == "B"


def test_nothing_inside_comments_or_strings(spark):
    text = "/* class A { */ // class B {\nconst s = \"class C {\";\nconst t = `class D {\nclass E {`;\n"
    assert [n for n, *_ in names(spark, "javascript", text)] == ["s", "t"]
    ranges = N.content_ranges(files(spark, ("javascript", text))).orderBy("start").collect()
    assert [text[r["start"] : r["end"]] for r in ranges if r["kind"] == "comment"] == ["/* class A { */", "// class B {"]
    assert [text[r["start"] : r["end"]] for r in ranges if r["kind"] == "string"] == ['"class C {"', "`class D {\nclass E {`"]
    assert all(a["end"] == b["start"] for a, b in zip(ranges, ranges[1:], strict=False)) and ranges[-1]["end"] == len(text)


@pytest.mark.parametrize("rows", [[], [("go", None)], [("go", "")], [("nothing", "a b c")]])
def test_defined_cases(spark, rows):
    assert N.declarations(files(spark, *rows)).count() == 0


def test_tokens_of_statements_are_no_rows(spark):
    rows = N.statements(files(spark, ("go", "func F(\n\ta int,\n) {\n\tx := \"}\" // {\n}\n"), ("python", "def f():\n  if a:\n    b\n  c\n"), (None, "a")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    got = [(r["file_id"], r["text"], r["line"], r["last_line"], r["end_line"], r["level"], r["parent"], r["opens"]) for r in rows.orderBy("file_id", "stmt").collect()]
    assert got == [
        (0, "func F( a int, ) {", 1, 3, 5, 0, None, True), (0, 'x := "}"', 4, 4, 4, 1, 0, False),
        (1, "def f():", 1, 1, 4, 0, None, True), (1, "if a:", 2, 2, 3, 1, 0, True), (1, "b", 3, 3, 3, 2, 1, False), (1, "c", 4, 4, 4, 1, 0, False),
    ]
