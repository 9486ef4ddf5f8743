"""Configuration: a node language and JSON, merging, and propagation rules; of one file on the driver, or of a table."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.runtime import ship_package

# Defaults.
DEFAULTS = {"index": {"max_file_size": 10 * 1024 * 1024, "max_file_count": 10_000, "max_total_size": 500 * 1024 * 1024, "watch_debounce_ms": 300}, "search": {"max_results": 100, "max_context_lines": 0}, "include": [], "exclude": ["**/.git/**", "**/node_modules/**", "**/vendor/**"]}
MODES = ("reachability", "accumulation", "decay", "max")
_TOKEN = re.compile(r'"((?:\\.|[^"\\])*)"|([{};])|(//[^\n]*)|(\n)|([^\s{};"]+)')


def parse_nodes(text: str) -> dict:
    """Nodes `name value...` and `name { ... }`; repeated names and several values become lists."""
    stack: list[dict] = [{}]
    names: list[str] = []
    words: list = []

    def put() -> None:
        if words:
            name, values = str(words[0]), words[1:]
            value = values[0] if len(values) == 1 else values
            was = stack[-1].get(name)
            stack[-1][name] = value if was is None else (was if isinstance(was, list) else [was]) + (value if isinstance(value, list) else [value])
            words.clear()

    for m in _TOKEN.finditer(text):
        quoted, mark, note, line, bare = m.groups()
        if quoted is not None:
            words.append(quoted.replace('\\"', '"').replace("\\\\", "\\"))
        elif note is not None:
            continue
        elif line is not None or mark == ";":
            put()
        elif mark == "{":
            names.append(str(words[0]) if words else "")
            words.clear()
            stack.append({})
        elif mark == "}":
            put()
            inner = stack.pop()
            if not stack:
                raise ValueError("a brace closes nothing")
            stack[-1].setdefault(names.pop(), {}).update(inner)
        else:
            words.append({"true": True, "false": False, "null": None}.get(bare, int(bare) if re.fullmatch(r"[+-]?\d+", bare) else float(bare) if re.fullmatch(r"[+-]?\d+\.\d+", bare) else bare))
    put()
    if len(stack) != 1:
        raise ValueError("a brace is not closed")
    return stack[0]


def load(text: str, kind: str = "nodes") -> dict:
    return json.loads(text) if kind == "json" else parse_nodes(text)


def flat(tree: dict, path: str = "") -> dict[str, str]:
    """A configuration's values by dotted path; lists are joined by commas."""
    out: dict[str, str] = {}
    for k, v in tree.items():
        out |= flat(v, f"{path}{k}.") if isinstance(v, dict) else {path + k: ",".join(map(str, v)) if isinstance(v, list) else str(v)}
    return out


def settings(files: DataFrame, base: dict | None = None) -> DataFrame:
    """id, key, value of each configuration file (id, content), over `base` if given; a file that can't be read has
    one row, key null and the reason as value. Null content is empty."""
    ship_package(files.sparkSession)
    schema = T.StructType([files.schema["id"], T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    own = parse_nodes(text or "")
                    rows += [(i, k, v) for k, v in flat(merged(base, own) if base else own).items()]
                except ValueError as e:
                    rows.append((i, None, str(e)))
            at, keys, values = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(values, pa.string())], names=schema.names)

    return files.select("id", "content").mapInArrow(run, schema)


def merged(base: dict, project: dict) -> dict:
    """Project values over base values; exclusions of both."""
    out = dict(base)
    for k, v in project.items():
        if k == "exclude":
            v = v if isinstance(v, list) else [v]
            out[k] = list(dict.fromkeys([*base.get(k, []), *v]))
        elif isinstance(v, dict) and isinstance(base.get(k), dict):
            out[k] = merged(base[k], v)
        else:
            out[k] = v
    return out


@dataclass(frozen=True)
class PropagationRule:
    label: str
    mode: str = "reachability"
    direction: str = "upstream"
    decay: float = 0.8
    max_hops: int = 10
    boost: float = 1.0
    boost_on: str = ""
    min_strength: float = 0.001


@dataclass(frozen=True)
class Propagation:
    rules: tuple[PropagationRule, ...] = field(default=())
    max_iterations: int = 10
    epsilon: float = 0.001


def problems(config: Propagation) -> list[str]:
    """What is out of range in a configuration; empty if all is well."""
    out = []
    if not 1 <= config.max_iterations <= 100:
        out.append("max_iterations is not in 1..100")
    if not 0 < config.epsilon < 1:
        out.append("epsilon is not in 0..1")
    for r in config.rules:
        if r.mode not in MODES:
            out.append(f"{r.label}: unknown mode {r.mode}")
        if r.direction not in ("upstream", "downstream", "bidirectional"):
            out.append(f"{r.label}: unknown direction {r.direction}")
        if not 0 < r.decay <= 1:
            out.append(f"{r.label}: decay is not in 0..1")
        if r.max_hops < 0:
            out.append(f"{r.label}: max_hops is negative")
    if len({r.label for r in config.rules}) < len(config.rules):
        out.append("a label has two rules")
    return out


def rule_problems(rules: DataFrame) -> DataFrame:
    """label, problem: what is out of range in a table of rules (columns as of rules_table)."""
    label = F.col("label")
    found = F.array(
        F.when(~F.col("mode").isin(*MODES), F.concat(label, F.lit(": unknown mode "), "mode")),
        F.when(~F.col("direction").isin("upstream", "downstream", "bidirectional"), F.concat(label, F.lit(": unknown direction "), "direction")),
        F.when(~((F.col("decay") > 0) & (F.col("decay") <= 1)), F.concat(label, F.lit(": decay is not in 0..1"))),
        F.when(F.col("max_hops") < 0, F.concat(label, F.lit(": max_hops is negative"))),
    )
    each = rules.select("label", F.explode(F.array_compact(found)).alias("problem"))
    twice = rules.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label", F.concat("label", F.lit(": a label has two rules")).alias("problem"))
    return each.union(twice)


def rules_table(spark: SparkSession, config: Propagation) -> DataFrame:
    return spark.createDataFrame([(r.label, r.mode, r.direction, r.decay, r.max_hops, r.boost, r.boost_on, r.min_strength) for r in config.rules], "label string, mode string, direction string, decay double, max_hops int, boost double, boost_on string, min_strength double")
