"""Queries of side effects read from sources: each part is a file of one of three languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import effects as X
from loomtext.registry import query
from loomtext.runtime import table

#: A file of each language, and the mask of each of its functions; {k} is the part's key.
FILES = {
    "go": "package p\nvar total int\nfunc Pure{k}(a int) int {\n\tb := a * 2\n\tb += 1\n\ta = 3\n\treturn b\n}\nfunc (r *Box) Fill(items []int, n *int) {\n\tr.size = len(items)\n\titems[0] = 4\n}\nfunc Count{k}(n *int) {\n\ttotal++\n\t*n = 5\n\tfmt.Println(total)\n}\nfunc Send{k}(c chan int) {\n\tc <- 1\n\tgo work()\n\tpanic(\"x = 1\")\n}\n",
    "python": "total = 0\ndef pure{k}(a, b=1):\n    c, d = a, b\n    c += 1\n    return c == d\ndef count{k}():\n    global total\n    total = 1\nclass Box:\n    def fill(self, items: list[int], *rest):\n        self.size = len(items)\n        items[0] = 4\ndef outer{k}(xs):\n    seen = {}\n    def inner(x):\n        seen[x] = 1\n        raise ValueError('a = b')\n    return inner\n",
    "typescript": "let total = 0;\nfunction pure{k}(a: number, b = 1) {\n  const c = a + b;\n  let d = c;\n  d += 1;\n  return d;\n}\nclass Box {\n  size = 0;\n  async fill(items: number[], opts: { a: number }): Promise<void> {\n    this.size = items.length;\n    opts.a = 2;\n    await save(items);\n  }\n}\nfunction count{k}() {\n  total++;\n  console.log(total);\n}\nfunction outer{k}(xs: number[]) {\n  let n = 0;\n  function inner(x: number) {\n    n += x;\n  }\n  return inner;\n}\n",
}
LANGUAGES = list(FILES)
_WANT = {
    "go": {"Pure{k}": 0, "Fill": 4 | 2, "Count{k}": 8 | 2 | 64, "Send{k}": 1024 | 2048 | 512},
    "python": {"pure{k}": 0, "count{k}": 8, "fill": 4 | 2, "outer{k}": 0, "inner": 16 | 512},
    "typescript": {"pure{k}": 0, "fill": 4 | 2 | 2048, "count{k}": 8 | 64, "outer{k}": 0, "inner": 16},
}
_ROWS = ", ".join(f"('{lang}', '{name}', {mask})" for lang, names in _WANT.items() for name, mask in names.items())


@query(f"SELECT p_partkey AS file_id, replace(name, '{{k}}', p_partkey::VARCHAR) AS name, mask FROM part JOIN (VALUES {_ROWS}) v(language, name, mask) ON language = {LANGUAGES}[p_partkey % 3 + 1]")
def effects_of_sources(spark, sf_dir):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), pick(LANGUAGES).alias("language"), F.replace(pick(FILES.values()), F.lit("{k}"), F.col("p_partkey").cast("string")).alias("content"))
    return X.masks(files).select("file_id", "name", "mask")
