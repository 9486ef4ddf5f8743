"""Search planning on the driver: query syntax, literal downgrade, choice of scan or index."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from loomtext.operators import index as I
from loomtext.operators import regexplan as R
from loomtext.operators import search as S

MOST_PATTERN = 1000


@dataclass(frozen=True)
class Plan:
    pattern: str
    options: S.Options
    use_index: bool


def parse(text: str, options: S.Options = S.Options()) -> tuple[str, S.Options]:
    """`path:`, `dir:` and `ext:` fields of a query become path filters; the rest is the pattern."""
    include = list(options.include)
    rest = []
    for word in text.split(" "):
        m = re.match(r"^(path|dir|ext):(.+)$", word)
        if not m:
            rest.append(word)
        elif m[1] == "ext":
            include.append(rf"\.{re.escape(m[2].lstrip('.'))}$")
        elif m[1] == "dir":
            include.append(rf"(^|/){re.escape(m[2].strip('/'))}/")
        else:
            include.append(m[2] if re.search(r"[*?]", m[2]) else re.escape(m[2]))
    return " ".join(rest).strip(), replace(options, include=tuple(include))


def plan(text: str, options: S.Options = S.Options(), index_at_hand: bool = False) -> Plan:
    pattern, o = parse(text, options)
    if len(pattern) > MOST_PATTERN:
        raise ValueError(f"a pattern has at most {MOST_PATTERN} characters")
    if o.regex and S.is_literal(pattern):
        o = replace(o, regex=False)
    return Plan(pattern, o, index_at_hand and not o.invert and R.useful(S.needed(pattern, o)))


def run(corpus: DataFrame, text: str, options: S.Options = S.Options(), trigrams: DataFrame | str | None = None, buckets: int = 64) -> DataFrame:
    """Matching lines of a query; a scan unless a persisted trigram table is given, or its place: then only the
    buckets of the trigrams that the pattern asks about are read."""
    p = plan(text, options, trigrams is not None)
    if not p.use_index:
        return S.matching_lines(corpus, p.pattern, p.options)
    if isinstance(trigrams, str):
        trigrams = I.read_grams(corpus.sparkSession, trigrams, R.all_grams(S.needed(p.pattern, p.options)), buckets)
    return S.by_trigrams(corpus, trigrams, p.pattern, p.options)
