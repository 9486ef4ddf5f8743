"""Queries of nested sources: each part is a file of one of six languages, with as many members as its size asks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import nesting as N
from loomtext.registry import query
from loomtext.runtime import table

#: language: (text before, the line that stands n times, text behind); {k} is the part's key, {i} counts from 1.
FILES = {
    "go": ("package p{k}\n\nconst (\n", "\tA{i} = iota // const {\n", ")\ntype Box{k}[T any, U comparable] struct {\n\tsize int\n}\nfunc (b *Box{k}[T, U]) Put(\n\tkey string, // the key {\n\tvalue T,\n) (\n\tint,\n\terror,\n) {\n\ts := \"} func Fake() {\"\n\treturn 0, nil\n}\n"),
    "python": ("import os\n@decorate(\n    \"x\", [1, {\"a\": 2}])\n@other\nclass Dog{k}(Base):\n    \"\"\"doc:\n    def fake(): \"\"\"\n    LIMIT = 3\n    @staticmethod\n    def bark(\n        a,\n        *args,\n    ) -> Dict[str, int]:\n        if a:\n            return {\n  \"k\": 1}\n", "        x{i} = '#'  # note\n", "def tail(): pass\n"),
    "typescript": ("@Component({\n  selector: 'a{',\n})\nexport class View{k}<T extends Base> {\n  private items: Map<string, T> = new Map();\n  @Input() name: string;\n  async render(\n    a: number,\n    b?: string,\n  ): Promise<void> {\n    const q = `template } ${a} {`;\n", "    call{i}(q, { x: [{i}] });\n", "  }\n}\nexport type Pair<A, B> = { a: A };\nexport const add = (a: number, b: number) => a + b;\n"),
    "java": ("package p;\n@Service(\"x{\")\npublic final class Svc{k}<K extends Comparable<K>, V>\n    extends Base<K>\n    implements Runnable {\n  private Map<K, V> cache = new HashMap<>();\n  /* class Fake {\n  */\n  @Override\n  public <R> List<R> find(\n      K key,\n      V value)\n      throws IOException {\n", "    if (key == {i}) { return null; }\n", "  }\n}\n"),
    "csharp": ("[Table(\"t\")]\n[Serializable]\npublic class Row{k}<T> where T : class\n{\n    [Key, Column(Order = 1)]\n    public int Id { get; set; }\n    public string Name = \"}\";\n    public async Task<T> LoadAsync(\n        int a,\n        string b)\n    {\n", "        Run{i}('{');\n", "    }\n}\n"),
    "rust": ("#[derive(Debug, Clone)]\npub struct P{k}<'a, T: Copy> {\n    pub n: &'a T,\n}\nimpl<'a, T: Copy> P{k}<'a, T> {\n    #[inline]\n    pub fn get(\n        &self,\n        i: usize,\n    ) -> Option<char> {\n", "        let c{i} = '{';\n", "    }\n}\n"),
}
LANGUAGES = list(FILES)


def sources(spark, sf_dir):
    """file_id, language, content."""
    k = F.col("p_partkey").cast("string")
    of = lambda j: F.element_at(F.array(*[F.lit(FILES[x][j]) for x in LANGUAGES]), (F.col("p_partkey") % 6 + 1).cast("int"))
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 5 + 1), lambda i: F.replace(of(1), F.lit("{i}"), i.cast("string"))), "")
    named = lambda c: F.replace(c, F.lit("{k}"), k)
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), language.alias("language"), F.concat(named(of(0)), many, named(of(2))).alias("content"))


#: language, name, kind, line and last line (from the start, and how many times n is added), parent, decorators, generics, exported
_WANT = [
    ("go", "Box{k}", "struct", 5, 1, 7, 1, None, "", "[T any, U comparable]", True),
    ("go", "size", "field", 6, 1, 6, 1, "Box{k}", "", "", False),
    ("go", "Put", "method", 8, 1, 17, 1, None, "", "", True),
    ("python", "Dog{k}", "class", 5, 0, 16, 1, None, '@decorate( "x", [1, {"a": 2}]) @other', "", True),
    ("python", "LIMIT", "constant", 8, 0, 8, 0, "Dog{k}", "", "", True),
    ("python", "bark", "method", 10, 0, 16, 1, "Dog{k}", "@staticmethod", "", True),
    ("python", "tail", "function", 17, 1, 17, 1, None, "", "", True),
    ("typescript", "View{k}", "class", 4, 0, 13, 1, None, "@Component({ selector: 'a{', })", "<T extends Base>", True),
    ("typescript", "items", "property", 5, 0, 5, 0, "View{k}", "", "", False),
    ("typescript", "name", "property", 6, 0, 6, 0, "View{k}", "@Input()", "", False),
    ("typescript", "render", "method", 7, 0, 12, 1, "View{k}", "", "", False),
    ("typescript", "Pair", "type", 14, 1, 14, 1, None, "", "<A, B>", True),
    ("typescript", "add", "function", 15, 1, 15, 1, None, "", "", True),
    ("java", "Svc{k}", "class", 3, 0, 15, 1, None, '@Service("x{")', "<K extends Comparable<K>, V>", True),
    ("java", "cache", "field", 6, 0, 6, 0, "Svc{k}", "", "", False),
    ("java", "find", "method", 10, 0, 14, 1, "Svc{k}", "@Override", "", True),
    ("csharp", "Row{k}", "class", 3, 0, 13, 1, None, '[Table("t")] [Serializable]', "<T>", True),
    ("csharp", "Id", "property", 6, 0, 6, 0, "Row{k}", "[Key, Column(Order = 1)]", "", True),
    ("csharp", "Name", "field", 7, 0, 7, 0, "Row{k}", "", "", True),
    ("csharp", "LoadAsync", "method", 8, 0, 12, 1, "Row{k}", "", "", True),
    ("rust", "P{k}", "struct", 2, 0, 4, 0, None, "#[derive(Debug, Clone)]", "<'a, T: Copy>", True),
    ("rust", "n", "field", 3, 0, 3, 0, "P{k}", "", "", True),
    ("rust", "P{k}", "impl", 5, 0, 12, 1, None, "", "<'a, T>", False),
    ("rust", "get", "method", 7, 0, 11, 1, "P{k}", "#[inline]", "", True),
]


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, bool | int) else "'" + x.replace("'", "''") + "'"


_VALUES = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in _WANT)
_FILES = f"f AS (SELECT p_partkey AS file_id, p_partkey::VARCHAR AS k, p_size % 5 + 1 AS n, {LANGUAGES}[p_partkey % 6 + 1] AS language FROM part)"


@query(f"WITH {_FILES}, v AS (SELECT * FROM (VALUES {_VALUES}) v(language, name, kind, line, more, last, more_last, parent, decorators, generics, exported)), g AS (SELECT file_id, n, unnest(range(1, n + 1)) AS i FROM f WHERE language = 'go') SELECT file_id, replace(name, '{{k}}', k) AS name, kind, line + more * n AS line, last + more_last * n AS end_line, replace(parent, '{{k}}', k) AS parent_name, decorators, generics, exported FROM f JOIN v USING (language) UNION ALL SELECT file_id, 'A' || i, 'constant', 3 + i, 3 + i, NULL, '', '', true FROM g")
def nested_declarations(spark, sf_dir):
    rows = N.declarations(sources(spark, sf_dir))
    return rows.select("file_id", "name", "kind", "line", "end_line", "parent_name", "decorators", "generics", "exported")


#: The comments and strings of each language's file: those that stand once, and those that stand n times.
_PIECES = {
    "go": {"comment": (["// the key {"], ["// const {"]), "string": (['"} func Fake() {"'], [])},
    "python": {"comment": ([], ["# note"]), "string": (['"x"', '"a"', '"""doc:\n    def fake(): """', '"k"'], ["'#'"])},
    "typescript": {"comment": ([], []), "string": (["'a{'", "`template } ${a} {`"], [])},
    "java": {"comment": (["/* class Fake {\n  */"], []), "string": (['"x{"'], [])},
    "csharp": {"comment": ([], []), "string": (['"t"', '"}"'], ["'{'"])},
    "rust": {"comment": ([], []), "string": ([], ["'{'"])},
}
_RANGES = ", ".join(f"('{lang}', '{kind}', {len(once)}, {len(often)}, {sum(map(len, once))}, {sum(map(len, often))})" for lang, kinds in _PIECES.items() for kind, (once, often) in kinds.items())


@query(f"WITH {_FILES}, v AS (SELECT * FROM (VALUES {_RANGES}) v(language, kind, once, often, bytes, more)) SELECT file_id, kind, once + often * n AS n_ranges, bytes + more * n AS n_bytes FROM f JOIN v USING (language) WHERE once + often * n > 0")
def content_kinds(spark, sf_dir):
    rows = N.content_ranges(sources(spark, sf_dir)).where("kind != 'code'")
    return rows.groupBy("file_id", "kind").agg(F.count("*").alias("n_ranges"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"))


@query("SELECT doc_id AS file_id, 0::BIGINT AS gaps, strlen(text) AS n_bytes, len(regexp_extract_all(text, '[(]')) AS n_round FROM documents WHERE text <> ''")
def content_coverage(spark, sf_dir):
    """Every byte of every document is in one range: no gap between ranges, and all bracket tokens are seen."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.lit("text").alias("language"), F.translate("text", "\"'`/", "    ").alias("content"))
    ranges = N.content_ranges(docs).groupBy("file_id").agg((F.max("end") - F.sum(F.col("end") - F.col("start"))).alias("gaps"), F.max("end").alias("n_bytes"))
    round_ = N.tokens(docs).groupBy("file_id").agg(F.count_if(F.col("text") == "(").alias("n_round"))
    return ranges.join(round_, "file_id").select("file_id", "gaps", "n_bytes", "n_round")
