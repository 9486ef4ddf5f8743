"""What surrounds a symbol: relationships, hierarchy, expansion of manifests, object context, overviews.

Symbols are rows (symbol_id, name, kind, file_id, receiver, exported, ...); edges are rows (source, target,
type) of symbol ids: call, reference, implements, extends, type (a type in a signature).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import paths as P
from loomtext.operators import graph as G
from loomtext.runtime import first_rows

#: Edge types of a type hierarchy.
HIERARCHY = ("implements", "extends")


def _of(edges: DataFrame, types: tuple[str, ...], up: bool) -> DataFrame:
    """symbol_id -> other along edges of some types, from source to target, or back."""
    a, b = ("target", "source") if up else ("source", "target")
    return edges.where(F.col("type").isin(*types)).select(F.col(a).alias("symbol_id"), F.col(b).alias("other")).distinct()


def base_types(edges: DataFrame) -> DataFrame:
    """symbol_id, base: what a type extends or implements."""
    return _of(edges, HIERARCHY, up=False).withColumnRenamed("other", "base")


def derived_types(edges: DataFrame) -> DataFrame:
    """symbol_id, derived: what extends or implements a type."""
    return _of(edges, HIERARCHY, up=True).withColumnRenamed("other", "derived")


def type_hierarchy(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, name, n_implementors, n_derived, n_bases of interfaces and classes that have any."""
    n = lambda types, up, name: _of(edges, types, up).groupBy("symbol_id").agg(F.count("*").alias(name))
    rows = symbols.select("symbol_id", "name").join(n(("implements",), True, "n_implementors"), "symbol_id", "left").join(n(("extends",), True, "n_derived"), "symbol_id", "left").join(n(HIERARCHY, False, "n_bases"), "symbol_id", "left")
    return rows.na.fill(0, ["n_implementors", "n_derived", "n_bases"]).where("n_implementors + n_derived + n_bases > 0")


def call_evidence(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """source, implementor, confidence: calls of an interface as calls of what implements it, 1 / n each."""
    implementors = _of(edges, ("implements",), up=True).select(F.col("symbol_id").alias("target"), F.col("other").alias("implementor"))
    n = implementors.groupBy("target").agg(F.count("*").alias("n"))
    calls = edges.where("type = 'call'").select("source", "target").distinct()
    rows = calls.join(implementors, "target").join(n, "target").select("source", "implementor", F.round(1 / F.col("n"), 6).alias("confidence"))
    return rows.groupBy("source", "implementor").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") >= least)


def expanded_calls(refs: DataFrame, edges: DataFrame, why: str, depth: int) -> DataFrame:
    """ref_id, symbol_id, why, depth: callers (or callees) of a manifest's symbols over up to `depth` calls, each
    once a reference at its least depth. A symbol of the reference itself is left out.

    A symbol that many references name is followed once; the references are joined to what it reached at the end.
    """
    calls = _of(edges, ("call",), why == "callers").select(F.col("symbol_id").alias("source"), F.col("other").alias("target")).where("target is not null")
    at = refs.select("ref_id", "symbol_id").where("ref_id is not null and symbol_id is not null").distinct()
    far = G.closure(calls, at.select(F.col("symbol_id").alias("id")), depth).where("depth > 0")
    rows = at.join(far, F.col("symbol_id") == F.col("seed")).groupBy("ref_id", F.col("id").alias("symbol_id")).agg(F.min("depth").alias("depth"))
    return rows.join(at, ["ref_id", "symbol_id"], "left_anti").select("ref_id", "symbol_id", F.lit(why).alias("why"), "depth")


#: Methods of a receiver that stand in one row while references are joined to them.
BLOCK = 1024


def _siblings(at: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, symbol_id: methods of the receivers (file_id, receiver) of a reference's symbols, once each.

    A reference's symbols are grouped by receiver before the join, and methods stand in blocks, so what is shuffled
    grows with the symbols and the pairs are only written: a method of one receiver can't meet a reference twice.
    Ids that stand under several receivers are made distinct behind the join.
    """
    named = symbols.where("file_id is not null and receiver is not null")
    asked = at.join(named.select("symbol_id", "file_id", "receiver"), "symbol_id").groupBy("ref_id", "file_id", "receiver").agg(F.min("symbol_id").alias("least"), F.max("symbol_id").alias("most"))
    methods = named.where("kind = 'method' and symbol_id is not null").select(F.col("symbol_id").alias("other"), "file_id", "receiver").distinct()
    under = methods.groupBy("other").agg(F.count("*").alias("n"), F.min(F.struct("file_id", "receiver")).alias("m"))
    own = under.where("n = 1").select("other", "m.file_id", "m.receiver")
    again = methods.join(under.where("n > 1").select("other"), "other", "left_semi").select("other", "file_id", "receiver")

    def pairs(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("file_id", "receiver").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
        dealt = rows.join(sizes, ["file_id", "receiver"]).withColumn("block", F.pmod(F.xxhash64("other"), F.col("n")))
        held = dealt.groupBy("file_id", "receiver", "block").agg(F.collect_list("other").alias("others")).hint("merge")
        each = asked.join(held, ["file_id", "receiver"]).select("ref_id", "least", "most", F.explode("others").alias("symbol_id"))
        # a symbol doesn't bring in itself, but another symbol of the reference does
        return each.where("symbol_id != least or symbol_id != most").select("ref_id", "symbol_id")

    return pairs(own).union(pairs(again).distinct())


def expanded(refs: DataFrame, symbols: DataFrame, edges: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """ref_id, symbol_id, why, depth 1: symbols that a manifest's symbols bring in.

    by: callers, callees, implementations, interface, siblings (methods of the same receiver), type_deps
    (types of the signature), tests (callers in test files). most: at most so many a reference and reason, by
    symbol_id. A reference never brings in itself.
    """
    at = refs.select("ref_id", "symbol_id").distinct()
    step = lambda types, up: at.join(_of(edges, types, up), "symbol_id").select("ref_id", "symbol_id", "other")
    rows = {
        "callers": lambda: step(("call",), True),
        "callees": lambda: step(("call",), False),
        "implementations": lambda: step(("implements",), True),
        "interface": lambda: step(("implements",), False),
        "type_deps": lambda: step(("type",), False),
        "tests": lambda: step(("call",), True).join(symbols.where(P.is_test(F.col("path"))).select(F.col("symbol_id").alias("other")), "other", "left_semi").select("ref_id", "symbol_id", "other"),
    }
    out = None
    for why in by:
        got = _siblings(at, symbols) if why == "siblings" else rows[why]().where("other != symbol_id").select("ref_id", F.col("other").alias("symbol_id")).distinct()
        got = got.withColumn("why", F.lit(why))
        out = got if out is None else out.union(got)
    if most is not None:
        w = Window.partitionBy("ref_id", "why").orderBy("symbol_id")
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    return out.withColumn("depth", F.lit(1))


def object_context(symbols: DataFrame, edges: DataFrame, wanted: DataFrame, shown: int = 10) -> DataFrame:
    """symbol_id, name, relationships, structure, usage of each wanted symbol: one struct a section.

    relationships: callers and callees by name (the first `shown`) and their numbers; structure: siblings of
    its file, methods of its receiver, its bases; usage: references, files that refer to it, whether a test does.
    """
    want = symbols.join(wanted.select("symbol_id").distinct(), "symbol_id", "left_semi")
    names = symbols.select(F.col("symbol_id").alias("other"), F.col("name").alias("other_name"), F.col("path").alias("other_path"), F.col("file_id").alias("other_file"))
    around = lambda types, up: want.select("symbol_id").join(_of(edges, types, up), "symbol_id").join(names, "other")
    first = lambda: F.slice(F.sort_array(F.collect_set("other_name")), 1, shown)
    up = around(("call",), True).groupBy("symbol_id").agg(first().alias("callers"), F.count("*").alias("n_callers"), F.count_distinct("other_file").alias("n_files"), F.max(P.is_test(F.col("other_path"))).alias("tested"))
    down = around(("call",), False).groupBy("symbol_id").agg(first().alias("callees"), F.count("*").alias("n_callees"))
    bases = around(HIERARCHY, False).groupBy("symbol_id").agg(first().alias("bases"))
    per_file = symbols.groupBy("file_id").agg(F.count("*").alias("in_file"))
    per_receiver = symbols.where("receiver is not null").groupBy("file_id", "receiver").agg(F.count("*").alias("in_receiver"))
    rows = want.join(per_file, "file_id").join(per_receiver, ["file_id", "receiver"], "left").join(up, "symbol_id", "left").join(down, "symbol_id", "left").join(bases, "symbol_id", "left")
    rows = rows.na.fill(0, ["n_callers", "n_callees", "n_files", "in_receiver"])
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c), none).alias(c)
    return rows.select(
        "symbol_id",
        "name",
        F.struct(some("callers"), "n_callers", some("callees"), "n_callees").alias("relationships"),
        F.struct((F.col("in_file") - 1).alias("n_siblings"), "in_receiver", some("bases")).alias("structure"),
        F.struct("n_files", F.coalesce("tested", F.lit(False)).alias("tested")).alias("usage"),
    )


def confident(rows: DataFrame, least: float, k: int) -> DataFrame:
    """Rows of confidence `least` or more, surest first."""
    return rows.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "source", "implementor").limit(k)


def annotated(direct: DataFrame, spread: DataFrame, label: str | None = None, category: str | None = None, least: float = 0.0) -> DataFrame:
    """id, label, strength, direct: symbols with a label or category of their own (strength 1) or by spreading.

    direct: id, label, category; spread: id, label, strength, hops.
    """
    own = direct
    if label:
        own, spread = own.where(F.col("label") == label), spread.where(F.col("label") == label)
    if category:
        own = own.where(F.col("category") == category)
        spread = spread.join(direct.where(F.col("category") == category).select("label").distinct(), "label", "left_semi")
    rows = own.select("id", "label", F.lit(1.0).alias("strength"), F.lit(True).alias("direct")).union(spread.where("hops > 0").select("id", "label", "strength", F.lit(False)))
    return rows.groupBy("id", "label").agg(F.max("strength").alias("strength"), F.max("direct").alias("direct")).where(F.col("strength") >= least)


def annotation_match(notes: DataFrame, labels: list[str] = (), category: str | None = None, tags: dict[str, str] | None = None, deps: list[str] = ()) -> DataFrame:
    """Annotations (labels, category, tags, deps) that meet every condition asked for."""
    for x in labels:
        notes = notes.where(F.array_contains("labels", x))
    if category:
        notes = notes.where(F.col("category") == category)
    for k, v in (tags or {}).items():
        notes = notes.where(F.try_element_at("tags", F.lit(k)) == v)
    for d in deps:
        notes = notes.where(F.array_contains(F.transform("deps", lambda x: x["name"]), d))
    return notes


def scope_stats(symbols: DataFrame) -> DataFrame:
    """One row: files, functions, variables, types."""
    of = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return symbols.agg(F.count_distinct("path").alias("n_files"), of("function", "method").alias("n_functions"), of("variable", "constant", "field").alias("n_variables"), of("class", "struct", "interface", "type", "enum").alias("n_types"))


def critical_functions(symbols: DataFrame, k: int | None = None) -> DataFrame:
    """Exported functions with a score of 30 + half the name's length over 25, longest first."""
    score = F.when(F.col("exported"), 30.0).otherwise(0.0) + 0.5 * F.char_length("name")
    rows = symbols.where("kind in ('function', 'method')").select("symbol_id", "name", score.alias("score")).where("score > 25")
    return first_rows(rows.orderBy(F.desc("score"), "name", "symbol_id"), k)


def abstraction(symbols: DataFrame, fans: DataFrame) -> DataFrame:
    """symbol_id, abstraction: interface 1, class in / (in + out), else 0. fans: symbol_id, n_in, n_out."""
    rows = symbols.select("symbol_id", "kind").join(fans, "symbol_id", "left").na.fill(0, ["n_in", "n_out"])
    n = F.col("n_in") + F.col("n_out")
    level = F.when(F.col("kind") == "interface", 1.0).when((F.col("kind") == "class") & (n > 0), F.col("n_in") / n).otherwise(0.0)
    return rows.select("symbol_id", F.round(level, 6).alias("abstraction"))


def child_methods(symbols: DataFrame) -> DataFrame:
    """symbol_id, n_methods: methods that start within a class's lines; spread over 64-line buckets, so that it
    is an equi-join."""
    spread = F.explode(F.sequence(F.floor(F.col("line") / 64), F.floor(F.col("end_line") / 64)))
    classes = symbols.where("kind in ('class', 'struct')").select("file_id", "symbol_id", "line", "end_line", spread.alias("_b"))
    methods = symbols.where("kind = 'method'").select("file_id", F.col("line").alias("at"), F.floor(F.col("line") / 64).alias("_b"))
    hits = classes.join(methods, ["file_id", "_b"]).where("at > line and at <= end_line")
    return hits.groupBy("symbol_id").agg(F.count("*").alias("n_methods"))


#: Default keyword rules of module types, in order.
MODULES = (("test", "test|spec"), ("api", "api|handler|route|controller"), ("data", "model|entity|store|repo|db"), ("service", "service|manager|core"), ("config", "config|setting"), ("util", "util|helper|common"), ("ui", "view|ui|component|page"))


def module_type(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike(p), k) for k, p in MODULES], F.lit("general"))


def architecture_patterns(layers: DataFrame) -> DataFrame:
    """One row, patterns: what a set of layers (rows: layer) amounts to."""
    has = layers.agg(F.collect_set("layer").alias("have"))  # a handful of layers
    h = F.col("have")
    every = lambda *xs: F.forall(F.array(*map(F.lit, xs)), lambda x: F.array_contains(h, x))
    found = F.array(F.when(every("presentation", "business", "data"), "layered"), F.when(every("api", "business"), "service_oriented"), F.when(every("data", "business"), "repository"), F.when(every("presentation", "data") & ~F.array_contains(h, "business"), "two_tier"))
    return has.select(F.array_join(F.array_compact(found), ",").alias("patterns"))


def repository_map(symbols: DataFrame, k: int | None = None) -> DataFrame:
    """module, kind, n_files, n_symbols, n_exported, n_functions: the k largest modules (None: all)."""
    rows = symbols.withColumn("module", P.module(F.col("path"))).groupBy("module").agg(F.count_distinct("path").alias("n_files"), F.count("*").alias("n_symbols"), F.count_if("exported").alias("n_exported"), F.count_if(F.col("kind").isin("function", "method")).alias("n_functions"))
    rows = rows.select("module", module_type(F.col("module")).alias("kind"), "n_files", "n_symbols", "n_exported", "n_functions")
    return first_rows(rows.orderBy(F.desc("n_symbols"), "module"), k)


MODES = ("overview", "statistics", "structure", "detailed")


def insight(symbols: DataFrame, mode: str, modules: int | None = None) -> DataFrame:
    """section, key, value rows of a report: overview (totals), statistics (by kind), structure (by module),
    detailed (all of them). modules: at most so many, the largest; None: all."""
    long = lambda rows, section, key, value: rows.select(F.lit(section).alias("section"), F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    totals = scope_stats(symbols)
    parts = {
        "overview": lambda: totals.select(F.lit("overview").alias("section"), F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("key", "value")),
        "statistics": lambda: long(symbols.groupBy("kind").agg(F.count("*").alias("n")), "statistics", "kind", "n"),
        "structure": lambda: long(repository_map(symbols, modules), "structure", "module", "n_symbols"),
    }
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    wanted = list(parts) if mode == "detailed" else [mode]
    out = parts[wanted[0]]()
    for m in wanted[1:]:
        out = out.union(parts[m]())
    return out


def line_symbols(symbols: DataFrame) -> DataFrame:
    """file_id, line, symbols: the ids of symbols that start on a line."""
    return symbols.groupBy("file_id", "line").agg(F.sort_array(F.collect_list("symbol_id")).alias("symbols"))


def metric_map(symbols: DataFrame, metrics: list[str]) -> DataFrame:
    """file_id, name, metrics: a map of a symbol's numbers; of several of one name in a file the largest."""
    rows = symbols.groupBy("file_id", "name").agg(*[F.max(m).cast("double").alias(m) for m in metrics])
    return rows.select("file_id", "name", F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))]).alias("metrics"))


def complement(ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """file_id, start, end (exclusive): what the ranges leave of 0..size in each file. ranges: file_id, start,
    end; sizes: file_id, size. Overlapping and touching ranges count once."""
    edge = sizes.select("file_id", F.col("size").alias("start"), F.col("size").alias("end"))
    w = Window.partitionBy("file_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.select("file_id", "start", "end").union(edge).withColumn("before", F.coalesce(F.max("end").over(w), F.lit(0)))
    return rows.where("before < start").select("file_id", F.col("before").alias("start"), F.col("start").alias("end"))


def consecutive(hits: DataFrame, gap: int = 2) -> DataFrame:
    """Rows (path, line) with whether the hit before in the file is at most `gap` lines away."""
    w = Window.partitionBy("path").orderBy("line")
    return hits.withColumn("follows", F.coalesce(F.col("line") - F.lag("line").over(w) <= gap, F.lit(False)))


def similar_objects(symbols: DataFrame, most: int = 5) -> DataFrame:
    """symbol_id, similar: other symbols of the same name and kind, the first `most` ids of each name.

    A name's list of ids is bounded before it is joined, so no pair of a common name is made beyond it.
    """
    w = Window.partitionBy("name", "kind").orderBy("symbol_id")
    first = symbols.select("name", "kind", F.col("symbol_id").alias("similar"), F.row_number().over(w).alias("r")).where(F.col("r") <= most + 1)
    rows = symbols.select("symbol_id", "name", "kind").join(first, ["name", "kind"]).where("symbol_id != similar")
    v = Window.partitionBy("symbol_id").orderBy("similar")
    return rows.withColumn("n", F.row_number().over(v)).where(F.col("n") <= most).select("symbol_id", "similar")


def usage_hot_spots(edges: DataFrame, k: int) -> DataFrame:
    """The k symbols that most edges point at."""
    return edges.groupBy(F.col("target").alias("symbol_id")).agg(F.count("*").alias("n_refs")).orderBy(F.desc("n_refs"), "symbol_id").limit(k)
