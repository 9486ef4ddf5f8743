"""Path scalars: parts, file categories, binary and test predicates, glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension classes that results must agree on.
CODE = "go rs py js jsx ts tsx java c cpp cc cxx h hpp cs php rb swift kt scala lua pl pm r jl ex exs erl hrl hs clj cljs elm vue svelte zig nim v d m mm".split()
DOCS = "md markdown txt rst adoc asciidoc rdoc org wiki textile pod rmd".split()
CONFIG = "json yaml yml toml ini cfg conf xml kdl env properties".split()
BINARY = "woff woff2 ttf otf eot png jpg jpeg gif bmp ico webp tiff tif zip tar gz bz2 xz 7z rar jar war ear exe dll so dylib a o obj bin mp3 mp4 avi mov wmv flv wav flac ogg pdf doc docx xls xlsx ppt pptx db sqlite sqlite3 pyc pyo class pickle pkl".split()
LANGUAGES = {"go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "kt": "kotlin", "zig": "zig"}
TEST_NAMES = r"_test\.|\.test\.|\.spec\.|test_"
TEST_DIRS = "/test/|/tests/|/__tests__/|/spec/"
#: First bytes of binary formats, in hex.
MAGIC = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "zip": "504B0304", "gzip": "1F8B", "pdf": "25504446", "elf": "7F454C46", "pe": "4D5A", "class": "CAFEBABE", "bzip2": "425A68", "xz": "FD377A585A00", "7z": "377ABCAF271C"}


def base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    """Up to the last slash; `.` at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(base(path), r"\.([^.]*)$", 1))


def category(path: Column) -> Column:
    """test, code, doc, config or unknown."""
    low, ext = F.lower(base(path)), extension(path)
    return F.when(low.rlike(r"_test\.|\.test\.|\.spec\.|^test_"), "test").when(ext.isin(CODE), "code").when(ext.isin(DOCS), "doc").when(ext.isin(CONFIG), "config").otherwise("unknown")


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(f"{TEST_NAMES}|{TEST_DIRS}")


def is_binary_name(path: Column) -> Column:
    return extension(path).isin(BINARY) & ~path.rlike(r"\.min\.(js|css)$")


def is_binary_content(content: Column, looked_at: int = 512) -> Column:
    """By format signature, or a zero byte among the first bytes."""
    head = F.hex(F.substring(content, 1, looked_at))
    signed = head.startswith("00000000")
    for mark in MAGIC.values():
        signed = signed | head.startswith(mark)
    return signed | head.rlike("^(..)*?00")


def language(path: Column) -> Column:
    ext = extension(path)
    out = F.lit("")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.[^/.]")


def priority(path: Column) -> Column:
    """Scan order: code first, then config, docs, tests and the rest."""
    kind = category(path)
    return F.when(kind == "code", 0).when(kind == "config", 1).when(kind == "doc", 2).when(kind == "test", 3).otherwise(4)


def module(path: Column) -> Column:
    """The first two directories; `.` at the root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), n - 1)), "/")).otherwise(F.lit("."))


def glob_regex(glob: str, anchored: bool = True) -> str:
    """`**` any depth, `*` within a part, `?` one character, `[...]` a class, `{a,b}` alternatives."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out.append(glob[i : end + 1].replace("[!", "[^"))
            i = end + 1
            continue
        if c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        i += 1
    return f"^{''.join(out)}$" if anchored else "".join(out)


def matches_glob(path: Column, glob: str) -> Column:
    """A pattern without a slash is held against the base name."""
    return (path if "/" in glob else base(path)).rlike(glob_regex(glob))


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(regex, ignored) of each line of an ignore file, in order; `!` takes back."""
    out = []
    for line in lines:
        rule = line.rstrip("\n").rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        rooted = rule.startswith("/") or "/" in rule.rstrip("/")
        inner = glob_regex(rule.strip("/"), anchored=False)
        tail = "/.*" if rule.endswith("/") else "(?:/.*)?"
        out.append((f"^{'' if rooted else '(?:.*/)?'}{inner}{tail}$", not keep))
    return out


def ignored(path: Column, lines: list[str]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for regex, ignore in ignore_rules(lines):
        out = F.when(path.rlike(regex), F.lit(ignore)).otherwise(out)
    return out
