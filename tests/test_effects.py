"""Side effects read from sources of several languages."""

from loomtext.operators import effects as X
from loomtext.operators.measures import EFFECTS


def masks(spark, lang, text):
    files = spark.createDataFrame([(1, lang, text)], "file_id long, language string, content string")
    return {r["name"]: {k for k, v in EFFECTS.items() if r["mask"] & v} for r in X.masks(files).collect()}


def test_fields_and_types(spark):
    java = "class A {\n  private int n;\n  void set(int[] xs, int k) {\n    n = k;\n    this.n++;\n    int m = 1;\n    m = 2;\n    xs[0] = m;\n  }\n  int pure(int k) {\n    List<String> l = null;\n    return k == 1 ? 2 : 3;\n  }\n}\n"
    assert masks(spark, "java", java) == {"set": {"receiver_write", "param_write"}, "pure": set()}
    rust = "impl P {\n    pub fn set(&mut self, x: &mut Vec<i32>) {\n        self.n = 1;\n        x[0] += 1;\n        let mut y = 1;\n        y = 2;\n    }\n}\n"
    assert masks(spark, "rust", rust) == {"set": {"receiver_write", "param_write"}}


def test_shadowing_and_globals(spark):
    python = "n = 0\ndef f(xs):\n    n = 1\n    def g():\n        nonlocal n\n        n = 2\n    def h(n):\n        n = 3\n        n.x = 4\n    for a, b in xs:\n        a.y = 1\n    other.z = 1\n"
    assert masks(spark, "python", python) == {"f": {"global_write"}, "g": {"closure_write"}, "h": {"param_write"}}


def test_defined_cases(spark):
    assert masks(spark, "go", "") == {} and masks(spark, "go", None) == {}
    assert masks(spark, "go", "func f() {\n\t// x = 1\n\ts := \"y = 2\"\n\tif s == \"a\" {\n\t\tg(s)\n\t}\n}\n") == {"f": set()}


def test_sources_are_cut_once(spark, monkeypatch):
    calls, real = [], X.N.statements
    monkeypatch.setattr(X.N, "statements", lambda files: calls.append(1) or real(files))
    assert masks(spark, "go", "func f(a *int) {\n\t*a = 1\n}\n") == {"f": {"param_write"}}
    assert len(calls) == 1
