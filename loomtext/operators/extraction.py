"""Symbols, references, imports, scopes and annotations out of source files.

No parser is installed here, so languages are read by line grammars: one list of patterns each. Files are
handled one by one in Arrow batches; a file's rows depend on that file alone. Grammars are approximate
where a construct spans lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import paths as P
from loomtext.runtime import ship_package

_ID = r"([A-Za-z_$][\w$]*)"
#: kind and pattern by language; group `name`, and where there is one `recv` and `args`.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "go": [
        ("method", r"^func\s+\(\s*\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*(?P<name>\w+)\s*\((?P<args>[^)]*)\)"),
        ("function", r"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<args>[^)]*)\)"),
        ("interface", r"^type\s+(?P<name>\w+)\s+interface\b"),
        ("struct", r"^type\s+(?P<name>\w+)\s+struct\b"),
        ("type", r"^type\s+(?P<name>\w+)\s+"),
        ("constant", r"^const\s+(?P<name>\w+)"),
        ("variable", r"^var\s+(?P<name>\w+)"),
    ],
    "python": [
        ("class", r"^\s*class\s+(?P<name>\w+)"),
        ("method", r"^\s+(?:async\s+)?def\s+(?P<name>\w+)\s*\((?P<args>[^)]*)"),
        ("function", r"^(?:async\s+)?def\s+(?P<name>\w+)\s*\((?P<args>[^)]*)"),
        ("constant", r"^(?P<name>[A-Z][A-Z0-9_]+)\s*(?::[^=]+)?="),
        ("variable", r"^(?P<name>[a-z_]\w*)\s*(?::[^=]+)?=[^=]"),
    ],
    "javascript": [
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
        ("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>[\w$]+)"),
        ("type", r"^\s*(?:export\s+)?type\s+(?P<name>[\w$]+)\s*="),
        ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)"),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*\((?P<args>[^)]*)"),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s*)?\(?(?P<args>[^)=]*)\)?\s*=>"),
        ("method", r"^\s+(?:static\s+|async\s+|public\s+|private\s+|protected\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[\w$]+)\s*\((?P<args>[^)]*)\)\s*(?::[^{]+)?\{"),
        ("constant", r"^(?:export\s+)?const\s+(?P<name>[\w$]+)\s*[:=]"),
        ("variable", r"^(?:export\s+)?(?:let|var)\s+(?P<name>[\w$]+)"),
    ],
    "rust": [
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)"),
        ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"),
        ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"),
        ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)"),
        ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)"),
        ("constant", r"^\s*(?:pub\s+)?(?:const|static)\s+(?P<name>\w+)"),
    ],
    "java": [
        ("class", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+|sealed\s+|partial\s+)*(?:class|record)\s+(?P<name>\w+)"),
        ("interface", r"^\s*(?:public\s+|private\s+|protected\s+)*interface\s+(?P<name>\w+)"),
        ("enum", r"^\s*(?:public\s+|private\s+|protected\s+)*enum\s+(?P<name>\w+)"),
        ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+|override\s+|virtual\s+|async\s+|synchronized\s+)+[\w<>\[\],.? ]*?\b(?P<name>\w+)\s*\((?P<args>[^)]*)\)"),
        ("field", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+|readonly\s+)+[\w<>\[\],.?]+\s+(?P<name>\w+)\s*[;=]"),
    ],
    "cpp": [
        ("class", r"^\s*class\s+(?P<name>\w+)[^;]*$"),
        ("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)[^;]*$"),
        ("enum", r"^\s*enum\s+(?:class\s+)?(?P<name>\w+)"),
        ("method", r"^[\w:<>*&~ ]+?\b(?P<recv>\w+)::(?P<name>~?\w+)\s*\((?P<args>[^)]*)\)"),
        ("function", r"^(?!\s*(?:if|for|while|switch|return|else)\b)[\w:<>*& ]+?\b(?P<name>\w+)\s*\((?P<args>[^)]*)\)\s*(?:const\s*)?\{?\s*$"),
    ],
    "php": [
        ("class", r"^\s*(?:abstract\s+|final\s+)*class\s+(?P<name>\w+)"),
        ("interface", r"^\s*interface\s+(?P<name>\w+)"),
        ("trait", r"^\s*trait\s+(?P<name>\w+)"),
        ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+)*function\s+(?P<name>\w+)\s*\((?P<args>[^)]*)"),
        ("function", r"^function\s+(?P<name>\w+)\s*\((?P<args>[^)]*)"),
    ],
    "ruby": [("class", r"^\s*class\s+(?P<name>\w+)"), ("module", r"^\s*module\s+(?P<name>\w+)"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)\s*\(?(?P<args>[^)]*)")],
}
GRAMMARS |= {"typescript": GRAMMARS["javascript"], "csharp": GRAMMARS["java"], "kotlin": GRAMMARS["java"] + [("function", r"^\s*(?:\w+\s+)*fun\s+(?P<name>\w+)\s*\((?P<args>[^)]*)")], "c": GRAMMARS["cpp"], "zig": [("function", r"^\s*(?:pub\s+)?fn\s+(?P<name>\w+)\s*\((?P<args>[^)]*)"), ("constant", r"^\s*(?:pub\s+)?const\s+(?P<name>\w+)")]}
IMPORTS: dict[str, list[str]] = {
    "go": [r'^import\s+(?:(?P<alias>[\w.]+)\s+)?"(?P<path>[^"]+)"', r'^\s+(?:(?P<alias>[\w.]+)\s+)?"(?P<path>[^"]+)"\s*$'],
    "python": [r"^\s*from\s+(?P<path>[\w.]+)\s+import\s+(?P<names>.+)$", r"^\s*import\s+(?P<path>[\w.]+)(?:\s+as\s+(?P<alias>\w+))?"],
    "javascript": [r"^\s*import\s+(?P<names>.+?)\s+from\s+['\"](?P<path>[^'\"]+)['\"]", r"^\s*import\s+['\"](?P<path>[^'\"]+)['\"]", r"(?:const|let|var)\s+(?P<names>\{?[\w$,\s]+\}?)\s*=\s*require\(['\"](?P<path>[^'\"]+)['\"]\)", r"^\s*export\s+(?P<names>.+?)\s+from\s+['\"](?P<path>[^'\"]+)['\"]"],
    "rust": [r"^\s*(?:pub\s+)?use\s+(?P<path>\w+(?:::\w+)*)(?:::\{(?P<names>[^}]+)\})?(?:\s+as\s+(?P<alias>\w+))?"],
    "java": [r"^\s*import\s+(?:static\s+)?(?P<path>[\w.*]+)\s*;"],
    "csharp": [r"^\s*using\s+(?:(?P<alias>\w+)\s*=\s*)?(?P<path>[\w.]+)\s*;"],
    "cpp": [r"^\s*#\s*include\s+[<\"](?P<path>[^>\"]+)[>\"]"],
    "php": [r"^\s*use\s+(?P<path>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;"],
    "ruby": [r"^\s*require(?:_relative)?\s+['\"](?P<path>[^'\"]+)['\"]"],
}
IMPORTS |= {"typescript": IMPORTS["javascript"], "c": IMPORTS["cpp"], "kotlin": [r"^\s*import\s+(?P<path>[\w.*]+)(?:\s+as\s+(?P<alias>\w+))?"]}
_BRANCH = re.compile(r"\b(?:if|elif|for|while|case|catch|except|when)\b|&&|\|\||\?(?=[^.?:])|\band\b|\bor\b")
_CALL = re.compile(r"(?:(?P<on>[\w$]+)\.)?" + _ID + r"\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return func function def class new sizeof elif except with and or not in fn fun make print".split())
_STRINGS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`")
_LOOP = re.compile(r"\b(?:for|while|foreach|loop)\b")
_AWAIT = re.compile(r"(?:(?:const|let|var)?\s*(?P<var>[\w$]+)\s*=\s*)?\bawait\s+(?P<call>[\w$.]+)\s*\((?P<args>[^)]*)")

SYMBOLS = "file_id long, symbol_no int, name string, kind string, line int, end_line int, receiver string, n_params int, cc int, cognitive int, nesting int, n_lines int, exported boolean, doc string, signature string"
REFS = "file_id long, source_no int, name string, on string, line int, type string"
IMPORT_ROWS = "file_id long, path string, name string, original string, line int, wildcard boolean"
SCOPES = "file_id long, symbol_no int, parent_no int, depth int"


def is_exported(language: Column, name: Column) -> Column:
    """Go: an upper-case first letter; Python, JavaScript, Ruby: no leading underscore (nor #); else true."""
    return F.when(language == "go", name.rlike(r"^\p{Lu}")).when(language.isin("python", "ruby"), ~name.startswith("_")).when(language.isin("javascript", "typescript"), ~name.rlike("^[_#]")).otherwise(F.lit(True))


def exported(language: str, name: str) -> bool:
    if language == "go":
        return name[:1].isupper()
    if language in ("python", "ruby"):
        return not name.startswith("_")
    return not name.startswith(("_", "#")) if language in ("javascript", "typescript") else True


def _code(line: str, language: str) -> str:
    """A line without strings and trailing comments."""
    bare = _STRINGS.sub('""', line)
    return bare.split("#", 1)[0] if language in ("python", "ruby") else bare.split("//", 1)[0]


def _end(lines: list[str], at: int, language: str) -> int:
    """Last line (from 0) of the construct that starts at a line."""
    if language in ("python", "ruby"):
        indent = len(lines[at]) - len(lines[at].lstrip())
        last = at
        for i in range(at + 1, len(lines)):
            if lines[i].strip():
                own = len(lines[i]) - len(lines[i].lstrip())
                if own <= indent:
                    return i if language == "ruby" and lines[i].strip() == "end" else last
                last = i
        return last
    depth, opened = 0, False
    for i in range(at, len(lines)):
        bare = _code(lines[i], language)
        depth += bare.count("{") - bare.count("}")
        opened = opened or "{" in bare
        if opened and depth <= 0:
            return i
        if not opened and (i > at + 3 or bare.rstrip().endswith(";")):
            return at
    return len(lines) - 1 if opened else at


def symbols_of(content: str, language: str) -> list[dict]:
    """Symbols of one file, by line."""
    rules = [(k, re.compile(p)) for k, p in GRAMMARS.get(language, [])]
    lines = content.split("\n")
    out = []
    for i, line in enumerate(lines):
        if line.lstrip().startswith(("//", "*", "/*")) or (language in ("python", "ruby") and line.lstrip().startswith("#")):
            continue
        for kind, rx in rules:
            m = rx.match(line)
            if not m:
                continue
            got = m.groupdict()
            block = kind not in ("constant", "variable", "field", "type")
            end = _end(lines, i, language) if block else i
            body = [_code(x, language) for x in lines[i : end + 1]]
            calls = kind in ("function", "method")
            args = [a.strip() for a in (got.get("args") or "").split(",") if a.strip() and a.strip() not in ("self", "cls", "&self", "&mut self")]
            doc = []
            for j in range(i - 1, -1, -1):
                mark = re.match(r"\s*(?://+|#+|\*|/\*+)\s?(.*?)(?:\*/)?$", lines[j])
                if not mark or lines[j].lstrip().startswith("#include"):
                    break
                doc.insert(0, mark[1].strip())
            out.append({"name": got["name"], "kind": kind, "line": i + 1, "end_line": end + 1, "receiver": got.get("recv"), "n_params": len(args), "cc": 1 + sum(len(_BRANCH.findall(b)) for b in body) if calls else None, "cognitive": _cognitive(body, language) if calls else None, "nesting": _nesting(body, language) if calls else None, "n_lines": end - i + 1, "exported": exported(language, got["name"]), "doc": "\n".join(doc).strip() or None, "signature": line.strip()})
            break
    classes = [s for s in out if s["kind"] in ("class", "interface", "struct", "impl", "trait")]
    for s in out:
        if s["kind"] in ("method", "function") and not s["receiver"]:
            holders = [c for c in classes if c["line"] < s["line"] <= c["end_line"]]
            if holders:
                s["receiver"], s["kind"] = holders[-1]["name"], "method"
    return out


def _nesting(body: list[str], language: str) -> int:
    if language == "python":
        base = len(body[0]) - len(body[0].lstrip())
        steps = sorted({len(b) - len(b.lstrip()) for b in body[1:] if b.strip() and len(b) - len(b.lstrip()) > base})
        return max(0, len(steps) - 1)
    depth = deepest = 0
    for b in body:
        for c in b:
            depth += (c == "{") - (c == "}")
            deepest = max(deepest, depth)
    return max(0, deepest - 1)


_CONTROL = re.compile(r"\s*(?:\}\s*)?(else if|elif|else|elsif|if|unless|for|foreach|while|loop|until|switch|match|select|catch|except|rescue)\b")


def _cognitive(body: list[str], language: str) -> int:
    """One for each control statement and one more for each level it is nested; one for each other branch of it
    and for each `&&`, `||`, `and` and `or`."""
    score, depth, held = 0, 0, []
    indented = language in ("python", "ruby")
    for i, b in enumerate(body):
        size = len(b) - len(b.lstrip())
        if indented and b.strip():
            while held and size <= held[-1]:
                held.pop()
        m = _CONTROL.match(b) if i else None
        level = len(held) if indented else max(0, depth - 1 - (b.lstrip().startswith("}")))
        if m:
            score += 1 if m[1] in ("else", "else if", "elif", "elsif", "except", "rescue", "catch") else 1 + level
            if indented:
                held.append(size)
        score += len(re.findall(r"&&|\|\||\band\b|\bor\b", b)) if language == "python" else len(re.findall(r"&&|\|\|", b))
        depth += b.count("{") - b.count("}")
    return score


def holder(symbols: list[dict], line: int) -> int | None:
    """Number of the smallest function or method that holds a line."""
    inside = [(s["end_line"] - s["line"], i) for i, s in enumerate(symbols) if s["line"] <= line <= s["end_line"] and s["kind"] in ("function", "method")]
    return min(inside)[1] if inside else None


def references_of(content: str, language: str) -> list[dict]:
    found = symbols_of(content, language)
    own = {(s["name"], s["line"]) for s in found}
    out = []
    for i, line in enumerate(content.split("\n"), 1):
        bare = _code(line, language)
        if bare.lstrip().startswith(("*", "/*")):
            continue
        for m in _CALL.finditer(bare):
            if m[2] not in _NOT_CALLS and (m[2], i) not in own:
                out.append({"source_no": holder(found, i), "name": m[2], "on": m["on"], "line": i, "type": "call"})
        parents = re.search(r"\b(?:extends|implements)\s+([\w$., ]+)", bare) or (re.match(r"\s*class\s+\w+\(([\w., ]+)\)", bare) if language == "python" else None)
        for name in re.split(r"[,\s]+", parents[1].strip()) if parents else ():
            if name and name not in ("extends", "implements"):
                out.append({"source_no": next((k for k, s in enumerate(found) if s["line"] == i), None), "name": name, "on": None, "line": i, "type": "inheritance"})
    return out


def imports_of(content: str, language: str) -> list[dict]:
    """One row for each imported name; the whole module where no name is given."""
    rules, out, block = [re.compile(p) for p in IMPORTS.get(language, [])], [], False
    for i, line in enumerate(content.split("\n"), 1):
        if language == "go":
            if re.match(r"^import\s*\(", line):
                block = True
                continue
            if block and line.strip() == ")":
                block = False
            if line.startswith((" ", "\t")) and not block:
                continue
        for rx in rules:
            m = rx.search(line)
            if not m:
                continue
            got = m.groupdict()
            path, names = got["path"], got.get("names")
            if names:
                for part in re.sub(r"[{}()]", ",", names).split(","):
                    part = part.strip().rstrip(";")
                    if part:
                        original, _, alias = part.partition(" as ")
                        out.append({"path": path, "name": (alias or original).strip(), "original": original.strip(), "line": i, "wildcard": "*" in part})
            else:
                name = got.get("alias") or re.split(r"[/.:\\]+", path.rstrip("*./"))[-1]
                out.append({"path": path, "name": name, "original": path, "line": i, "wildcard": path.endswith("*") or got.get("alias") == "."})
            break
    return out


def scopes_of(content: str, language: str) -> list[dict]:
    """The enclosing symbol of each symbol, and how deep it stands."""
    found = symbols_of(content, language)
    out = []
    for i, s in enumerate(found):
        above = [k for k, o in enumerate(found) if k != i and o["line"] <= s["line"] and s["end_line"] <= o["end_line"] and (o["line"], -o["end_line"]) < (s["line"], -s["end_line"])]
        out.append({"symbol_no": i, "parent_no": max(above, key=lambda k: found[k]["line"]) if above else None, "depth": len(above)})
    return out


#: Calls that are worth taking out of a loop, by language.
EXPENSIVE = {
    "go": r"regexp\.(?:Must)?Compile|json\.(?:Unm|M)arshal|(?:os|ioutil)\.ReadFile|sql\.Open|http\.(?:Get|Post)",
    "javascript": r"JSON\.(?:parse|stringify)|new RegExp|readFileSync|querySelector(?:All)?|structuredClone",
    "python": r"re\.compile|json\.(?:loads|dumps)|\bopen\(|requests\.\w+\(|read_csv",
    "java": r"Pattern\.compile|\.getConnection\(|new ObjectMapper|String\.format",
    "rust": r"Regex::new|fs::read|serde_json::",
}
EXPENSIVE |= {"typescript": EXPENSIVE["javascript"], "kotlin": EXPENSIVE["java"], "csharp": r"new Regex|JsonConvert\.|File\.ReadAll"}


def performance_of(content: str, language: str) -> list[dict]:
    """Loops inside loops, awaits and expensive calls inside loops, and awaits in a row that don't use one another."""
    lines = content.split("\n")
    found = symbols_of(content, language)
    loops = [(i, _end(lines, i, language)) for i, x in enumerate(lines) if _LOOP.search(_code(x, language)) and not x.lstrip().startswith(("//", "#", "*"))]
    out = []
    for a, b in loops:
        depth = sum(c <= a and b <= d for c, d in loops)
        if depth >= 2:
            out.append({"source_no": holder(found, a + 1), "line": a + 1, "issue": "nested_loop", "severity": "high" if depth >= 3 else "medium"})
    costly = EXPENSIVE.get(language)
    for i, x in enumerate(lines) if costly else ():
        if any(a < i <= b for a, b in loops) and re.search(costly, _code(x, language)):
            out.append({"source_no": holder(found, i + 1), "line": i + 1, "issue": "expensive_call_in_loop", "severity": "medium"})
    waits: dict[int | None, list[tuple[int, str | None, str]]] = {}
    for i, x in enumerate(lines):
        for m in _AWAIT.finditer(_code(x, language)):
            who = holder(found, i + 1)
            bare = _code(x, language)
            if any(a < i <= b or (a == i and _LOOP.search(bare).start() < bare.find("await")) for a, b in loops):
                out.append({"source_no": who, "line": i + 1, "issue": "await_in_loop", "severity": "high"})
            waits.setdefault(who, []).append((i + 1, m["var"], m["args"]))
    for who, each in waits.items():
        free = [w for k, w in enumerate(each) if not any(v and re.search(rf"\b{re.escape(v)}\b", w[2]) for _, v, _ in each[:k])]
        if len(free) >= 2:
            out.append({"source_no": who, "line": free[1][0], "issue": "sequential_awaits", "severity": "medium"})
    return out



ANNOTATIONS = "file_id long, line int, labels array<string>, category string, tags map<string,string>, deps array<struct<type:string,name:string,mode:string>>, excludes array<string>, hints map<string,double>"


def annotation_of(body: str) -> dict:
    """labels[a,b] category[x] tags[k=v] deps[type:name:mode] exclude[a] and numeric hints k=1.5."""
    part = {m[1]: m[2] for m in re.finditer(r"([\w-]+)\[([^\]]*)\]", body)}
    split = lambda k: [x.strip() for x in part.get(k, "").split(",") if x.strip()]
    deps = [dict(zip(("type", "name", "mode"), [*d.split(":"), None, None], strict=False)) for d in split("deps")]
    rest = re.sub(r"[\w-]+\[[^\]]*\]", " ", body)
    return {"labels": split("labels"), "category": part.get("category"), "tags": dict(t.partition("=")[::2] for t in split("tags")), "deps": [{k: d.get(k) for k in ("type", "name", "mode")} for d in deps], "excludes": split("exclude"), "hints": {m[1]: float(m[2]) for m in re.finditer(r"([\w-]+)=(-?\d+(?:\.\d+)?)\b", rest)}}


def annotations_of(content: str, language: str, prefix: str = "@note:") -> list[dict]:
    """Comment lines with the prefix."""
    mark = re.compile(r"^\s*(?://|#|\*|--)\s*" + re.escape(prefix) + r"(.*)$")
    return [{"line": i, **annotation_of(m[1])} for i, x in enumerate(content.split("\n"), 1) if (m := mark.match(x))]


def typed_value(c: Column) -> Column:
    """struct(kind, value): boolean, integer, double or string of a text."""
    low = F.lower(c)
    kind = F.when(low.isin("true", "false"), "boolean").when(c.rlike(r"^[+-]?\d+$"), "integer").when(c.rlike(r"^[+-]?\d+\.\d+$"), "double").otherwise("string")
    return F.struct(kind.alias("kind"), c.alias("value"))


def _table(files: DataFrame, read, schema: str) -> DataFrame:
    """files: file_id, path, content -> rows of `read` for each."""
    ship_package(files.sparkSession)
    names = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, content, language in zip(batch["file_id"], batch["content"], batch["language"], strict=True):
                for no, row in enumerate(read(content or "", language or "")):
                    rows.append({"file_id": file_id, "symbol_no": no} | row)
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    source = files.select("file_id", "content", P.language(F.col("path")).alias("language"))
    return source.mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    return _table(files, symbols_of, SYMBOLS)


def references(files: DataFrame) -> DataFrame:
    return _table(files, references_of, REFS)


def imports(files: DataFrame) -> DataFrame:
    return _table(files, imports_of, IMPORT_ROWS)


def scopes(files: DataFrame) -> DataFrame:
    return _table(files, scopes_of, SCOPES)


def performance(files: DataFrame) -> DataFrame:
    return _table(files, performance_of, "file_id long, source_no int, line int, issue string, severity string")


def annotations(files: DataFrame) -> DataFrame:
    return _table(files, annotations_of, ANNOTATIONS)


def annotated_symbols(found: DataFrame, notes: DataFrame, reach: int = 3) -> DataFrame:
    """Each annotation with the first symbol at most `reach` lines below it."""
    near = notes.withColumn("at", F.explode(F.sequence(F.col("line"), F.col("line") + reach)))
    rows = near.join(found.select("file_id", "symbol_no", "name", F.col("line").alias("at")), ["file_id", "at"])
    return rows.groupBy("file_id", "line").agg(F.min_by("symbol_no", "at").alias("symbol_no"), F.min_by("name", "at").alias("name"), F.first("labels").alias("labels"), F.first("category").alias("category"))


def candidate_paths(imports_: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, import path -> target file or external, by the language's rules in order of priority.

    Relative paths are taken from the importing file's directory; dotted and `::` paths become slashes.
    """
    f = files.select("file_id", P.directory(F.col("path")).alias("dir"), P.language(F.col("path")).alias("language"))
    rows = imports_.select("file_id", F.col("path").alias("import_path")).distinct().join(f, "file_id")
    slashed = F.when(F.col("import_path").startswith("."), F.regexp_replace("import_path", r"^\./", "")).otherwise(F.regexp_replace("import_path", r"[.\\]|::", "/"))
    plain = F.when(F.col("language").isin("javascript", "typescript", "cpp", "c", "go", "ruby"), F.regexp_replace("import_path", r"^\./", "")).otherwise(slashed)
    here = F.when(F.col("dir") == ".", plain).otherwise(F.concat_ws("/", "dir", plain))
    ends = F.when(F.col("language") == "python", F.array(F.lit(".py"), F.lit("/__init__.py"))).when(F.col("language").isin("javascript", "typescript"), F.array(*map(F.lit, ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")))).when(F.col("language") == "java", F.array(F.lit(".java"))).when(F.col("language") == "rust", F.array(F.lit(".rs"), F.lit("/mod.rs"))).otherwise(F.array(F.lit("")))
    tries = F.concat(F.transform(ends, lambda e: F.concat(here, e)), F.transform(ends, lambda e: F.concat(plain, e)))
    each = rows.select("file_id", "import_path", F.posexplode(tries).alias("priority", "path"))
    hits = each.join(files.select(F.col("file_id").alias("target"), "path"), "path").groupBy("file_id", "import_path").agg(F.min_by("target", "priority").alias("target"))
    return rows.select("file_id", "import_path").join(hits, ["file_id", "import_path"], "left").withColumn("kind", F.when(F.col("target").isNotNull(), "file").otherwise("external"))


def links(imports_: DataFrame, resolved: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, name -> target file and symbol: imported names that the target exports."""
    rows = imports_.join(resolved.where("kind = 'file'").withColumnRenamed("import_path", "path"), ["file_id", "path"])
    s = found.where("exported").select(F.col("file_id").alias("target"), F.col("name").alias("original"), F.col("symbol_no").alias("target_symbol"))
    return rows.join(s, ["target", "original"]).select("file_id", "name", "target", "target_symbol")
