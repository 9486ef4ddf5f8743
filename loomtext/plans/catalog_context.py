"""Queries of context, hierarchy, expansion and overviews: parts stand for symbols, line items for edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import context as X
from loomtext.operators import duplicates as D
from loomtext.operators import exploration as E
from loomtext.operators import graph as G
from loomtext.plans.catalog_graphs import RING, ring_edges
from loomtext.plans.catalog_measures import _LAYER, NAMED, named
from loomtext.registry import query
from loomtext.runtime import Scratch, table
from loomtext.sources import config as K

SYM = "s AS (SELECT p_partkey AS symbol_id, p_name AS name, ['function', 'method', 'class', 'interface', 'variable'][p_size % 5 + 1] AS kind, p_partkey % 40 AS file_id, 'm' || (p_partkey % 4) || '/' || CASE WHEN p_partkey % 40 % 10 = 0 THEN 'test_' ELSE 'f' END || (p_partkey % 40) || '.go' AS path, CAST(p_partkey // 40 * 10 + 1 AS BIGINT) AS line, CAST(p_partkey // 40 * 10 + 1 + p_size % 30 AS BIGINT) AS end_line, p_partkey % 2 = 0 AS exported, CASE WHEN p_size % 5 = 1 THEN 'R' || (p_partkey % 3) END AS receiver, CAST(p_size AS BIGINT) AS cc FROM part)"
EDGE = "e AS (SELECT l_suppkey AS source, l_partkey AS target, ['call', 'implements', 'extends', 'type', 'reference'][l_linenumber % 5 + 1] AS type FROM lineitem)"
_KINDS, _TYPES = ("function", "method", "class", "interface", "variable"), ("call", "implements", "extends", "type", "reference")


def symbols(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    path = F.concat(F.lit("m"), (k % 4).cast("string"), F.when(k % 40 % 10 == 0, "/test_").otherwise("/f"), (k % 40).cast("string"), F.lit(".go"))
    line = (F.floor(k / 40) * 10 + 1).cast("long")
    return table(spark, sf_dir, "part").select(k.alias("symbol_id"), F.col("p_name").alias("name"), pick(_KINDS, F.col("p_size") % 5).alias("kind"), (k % 40).alias("file_id"), path.alias("path"), line.alias("line"), (line + F.col("p_size") % 30).alias("end_line"), (k % 2 == 0).alias("exported"), F.when(F.col("p_size") % 5 == 1, F.concat(F.lit("R"), (k % 3).cast("string"))).alias("receiver"), F.col("p_size").cast("long").alias("cc"))


def edges(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), kind.alias("type"))


@query(f"WITH {EDGE} SELECT DISTINCT source AS symbol_id, target AS base FROM e WHERE type IN ('implements', 'extends')")
def base_types(spark, sf_dir):
    return X.base_types(edges(spark, sf_dir))


@query(f"WITH {EDGE} SELECT DISTINCT target AS symbol_id, source AS derived FROM e WHERE type IN ('implements', 'extends')")
def derived_types(spark, sf_dir):
    return X.derived_types(edges(spark, sf_dir))


@query(f"WITH {SYM}, {EDGE}, i AS (SELECT target AS id, count(DISTINCT source) AS n FROM e WHERE type = 'implements' GROUP BY 1), d AS (SELECT target AS id, count(DISTINCT source) AS n FROM e WHERE type = 'extends' GROUP BY 1), b AS (SELECT source AS id, count(DISTINCT target) AS n FROM e WHERE type IN ('implements', 'extends') GROUP BY 1), j AS (SELECT symbol_id, name, coalesce(i.n, 0) AS n_implementors, coalesce(d.n, 0) AS n_derived, coalesce(b.n, 0) AS n_bases FROM s LEFT JOIN i ON i.id = symbol_id LEFT JOIN d ON d.id = symbol_id LEFT JOIN b ON b.id = symbol_id) SELECT * FROM j WHERE n_implementors + n_derived + n_bases > 0")
def type_hierarchy(spark, sf_dir):
    return X.type_hierarchy(symbols(spark, sf_dir), edges(spark, sf_dir))


_EVIDENCE = f"{EDGE}, i AS (SELECT DISTINCT target, source AS implementor FROM e WHERE type = 'implements'), n AS (SELECT target, count(*) AS n FROM i GROUP BY 1), c AS (SELECT DISTINCT source, target FROM e WHERE type = 'call'), v AS (SELECT source, implementor, max(round(1.0 / n, 6))::DOUBLE AS confidence FROM c JOIN i USING (target) JOIN n USING (target) GROUP BY ALL)"


@query(f"WITH {_EVIDENCE} SELECT * FROM v")
def call_evidence(spark, sf_dir):
    return X.call_evidence(edges(spark, sf_dir))


@query(f"WITH {_EVIDENCE} SELECT * FROM v WHERE confidence >= 0.2 ORDER BY confidence DESC, source, implementor LIMIT 100")
def confident_evidence(spark, sf_dir):
    return X.confident(X.call_evidence(edges(spark, sf_dir)), 0.2, 100)


#: Every 7th symbol is in a manifest.
_REFS = "r AS (SELECT symbol_id AS ref_id, symbol_id FROM s WHERE symbol_id % 7 = 0)"
_STEP = {
    "callers": "SELECT ref_id, source FROM r JOIN e ON target = symbol_id AND type = 'call'",
    "callees": "SELECT ref_id, target FROM r JOIN e ON source = symbol_id AND type = 'call'",
    "implementations": "SELECT ref_id, source FROM r JOIN e ON target = symbol_id AND type = 'implements'",
    "interface": "SELECT ref_id, target FROM r JOIN e ON source = symbol_id AND type = 'implements'",
    "type_deps": "SELECT ref_id, target FROM r JOIN e ON source = symbol_id AND type = 'type'",
    "siblings": "SELECT ref_id, b.symbol_id FROM r JOIN s a USING (symbol_id) JOIN s b ON b.file_id = a.file_id AND b.receiver = a.receiver AND b.kind = 'method'",
    "tests": "SELECT ref_id, source FROM r JOIN e ON target = symbol_id AND type = 'call' JOIN s t ON t.symbol_id = source AND contains(t.path, 'test_')",
}


def _expansion(*by: str) -> str:
    return f"WITH {SYM}, {EDGE}, {_REFS}, x AS ({' UNION ALL '.join(f'SELECT DISTINCT ref_id, o AS symbol_id, {chr(39)}{k}{chr(39)} AS why FROM ({_STEP[k]}) t(ref_id, o) WHERE o <> ref_id' for k in by)}) SELECT ref_id, symbol_id, why, 1 AS depth FROM x"


def _expanded(spark, sf_dir, *by, most=None):
    s = symbols(spark, sf_dir)
    return X.expanded(s.where("symbol_id % 7 = 0").select(F.col("symbol_id").alias("ref_id"), "symbol_id"), s, edges(spark, sf_dir), list(by), most)


@query(_expansion("callers", "callees"))
def manifest_expand_calls(spark, sf_dir):
    return _expanded(spark, sf_dir, "callers", "callees")


@query(_expansion("implementations", "interface"))
def manifest_expand_implementations(spark, sf_dir):
    return _expanded(spark, sf_dir, "implementations", "interface")


@query(_expansion("siblings", "type_deps", "tests"))
def manifest_expand_siblings(spark, sf_dir):
    return _expanded(spark, sf_dir, "siblings", "type_deps", "tests")


def _deep(why: str) -> tuple[str, str]:
    a, b = ("target", "source") if why == "callers" else ("source", "target")
    return f"SELECT ref_id, symbol_id, '{why}' AS why, CAST(min(d) AS INTEGER) AS depth FROM {why} WHERE d > 0 AND symbol_id <> ref_id GROUP BY ALL", f"{why}(ref_id, symbol_id, d) AS (SELECT ref_id, symbol_id, 0 FROM r UNION SELECT ref_id, c.{b}, d + 1 FROM {why} JOIN c ON c.{a} = symbol_id WHERE d < 3)"


@query(f"WITH RECURSIVE {SYM}, {EDGE}, {_REFS}, c AS (SELECT DISTINCT source, target FROM e WHERE type = 'call'), {_deep('callers')[1]}, {_deep('callees')[1]} {_deep('callers')[0]} UNION ALL {_deep('callees')[0]}")
def manifest_expand_deep(spark, sf_dir):
    s, calls = symbols(spark, sf_dir), edges(spark, sf_dir)
    refs = s.where("symbol_id % 7 = 0").select(F.col("symbol_id").alias("ref_id"), "symbol_id")
    return X.expanded_calls(refs, calls, "callers", 3).union(X.expanded_calls(refs, calls, "callees", 3))


@query(f"WITH {SYM}, {EDGE}, {_REFS}, x AS (SELECT DISTINCT ref_id, o AS symbol_id FROM ({_STEP['callers']}) t(ref_id, o) WHERE o <> ref_id), n AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY symbol_id) AS k FROM x) SELECT ref_id, symbol_id, 'callers' AS why, 1 AS depth FROM n WHERE k <= 2")
def manifest_expand_bounded(spark, sf_dir):
    return _expanded(spark, sf_dir, "callers", most=2)


@query(f"""WITH {SYM}, {EDGE}, up AS (SELECT DISTINCT target AS symbol_id, source AS o FROM e WHERE type = 'call'), u AS (SELECT up.symbol_id, list_sort(list(DISTINCT t.name))[1:10] AS callers, count(*) AS n_callers, count(DISTINCT t.file_id) AS n_files, bool_or(contains(t.path, 'test_')) AS tested FROM up JOIN s t ON t.symbol_id = o GROUP BY 1),
d AS (SELECT x.symbol_id, count(*) AS n_callees FROM (SELECT DISTINCT source AS symbol_id, target AS o FROM e WHERE type = 'call') x JOIN s t ON t.symbol_id = o GROUP BY 1), f AS (SELECT file_id, count(*) AS n FROM s GROUP BY 1), g AS (SELECT file_id, receiver, count(*) AS n FROM s WHERE receiver IS NOT NULL GROUP BY 1, 2),
b AS (SELECT x.symbol_id, array_to_string(list_sort(list(DISTINCT t.name))[1:10], ',') AS bases FROM (SELECT DISTINCT source AS symbol_id, target AS o FROM e WHERE type IN ('implements', 'extends')) x JOIN s t ON t.symbol_id = o GROUP BY 1)
SELECT s.symbol_id, name, coalesce(array_to_string(callers, ','), '') AS callers, coalesce(n_callers, 0) AS n_callers, coalesce(n_callees, 0) AS n_callees, f.n - 1 AS n_siblings, coalesce(g.n, 0) AS in_receiver, coalesce(bases, '') AS bases, coalesce(n_files, 0) AS n_files, coalesce(tested, false) AS tested
FROM s JOIN f USING (file_id) LEFT JOIN g ON g.file_id = s.file_id AND g.receiver = s.receiver LEFT JOIN u ON u.symbol_id = s.symbol_id LEFT JOIN d ON d.symbol_id = s.symbol_id LEFT JOIN b ON b.symbol_id = s.symbol_id""")
def object_context(spark, sf_dir):
    s = symbols(spark, sf_dir)
    rows = X.object_context(s, edges(spark, sf_dir), s.select("symbol_id"))
    return rows.select("symbol_id", "name", F.array_join("relationships.callers", ",").alias("callers"), "relationships.n_callers", "relationships.n_callees", "structure.n_siblings", "structure.in_receiver", F.array_join("structure.bases", ",").alias("bases"), "usage.n_files", "usage.tested")


_LAB = f"{RING}, lab AS (SELECT source AS id, CASE WHEN source % 2 = 0 THEN 'io' ELSE 'db' END AS label, CASE WHEN source % 3 = 0 THEN 'core' ELSE 'edge' END AS category FROM ring WHERE source % 4 = 0)"


def _labels(spark, sf_dir):
    rows = ring_edges(spark, sf_dir).where("source % 4 = 0")
    return rows.select(F.col("source").alias("id"), F.when(F.col("source") % 2 == 0, "io").otherwise("db").alias("label"), F.when(F.col("source") % 3 == 0, "core").otherwise("edge").alias("category"))


@query(f"WITH RECURSIVE {_LAB}, w(id, label, hops) AS (SELECT id, label, 0 FROM lab UNION SELECT ring.target, label, hops + 1 FROM w JOIN ring ON source = id WHERE hops < 3), m AS (SELECT id, label, min(hops) AS h FROM w GROUP BY ALL), x AS (SELECT id, label, 1.0::DOUBLE AS strength, true AS direct FROM lab UNION ALL SELECT id, label, round(pow(0.8, h), 6), false FROM m WHERE h > 0) SELECT id, label, max(strength)::DOUBLE AS strength, bool_or(direct) AS direct FROM x GROUP BY ALL HAVING max(strength) >= 0.6")
def annotation_query(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    return X.annotated(labels, G.propagate_labels(ring_edges(spark, sf_dir), labels.select("id", "label"), max_hops=3), least=0.6)


#: Rules that differ in direction, mode and boost; the ring has no multiple ways within two hops but by them.
_RULES = K.Propagation((K.PropagationRule("io", "decay", "downstream", 0.5, 3), K.PropagationRule("db", "max", "upstream", 0.9, 2), K.PropagationRule("api", "reachability", "bidirectional", 0.5, 1, 1.5, "public")))


@query(f"""WITH RECURSIVE {RING}, lab AS (SELECT source AS id, 'io' AS label FROM ring WHERE source % 4 = 0 UNION ALL SELECT source, 'db' FROM ring WHERE source % 4 = 1 UNION ALL SELECT source, 'api' FROM ring WHERE source % 4 = 2),
step AS (SELECT 'io' AS label, source, target FROM ring UNION SELECT 'db', target, source FROM ring UNION SELECT 'api', source, target FROM ring UNION SELECT 'api', target, source FROM ring),
rule AS (SELECT * FROM (VALUES ('io', 3), ('db', 2), ('api', 1)) v(label, most)),
w(id, label, hops) AS (SELECT id, label, 0 FROM lab UNION SELECT step.target, w.label, w.hops + 1 FROM w JOIN step ON step.source = w.id AND step.label = w.label JOIN rule ON rule.label = w.label WHERE w.hops < most),
m AS (SELECT id, label, min(hops) AS hops FROM w GROUP BY ALL)
SELECT id, label, CASE label WHEN 'io' THEN pow(0.5, hops) WHEN 'db' THEN 1.0 ELSE CASE WHEN hops = 0 THEN 1.0 WHEN id % 2 = 0 THEN 0.75 ELSE 0.5 END END AS strength, CAST(hops AS INTEGER) AS hops FROM m""")
def propagate_by_rules(spark, sf_dir):
    ring = ring_edges(spark, sf_dir)
    labels = ring.select(F.col("source").alias("id"), F.get(F.array(F.lit("io"), F.lit("db"), F.lit("api")), (F.col("source") % 4).cast("int")).alias("label")).where("label is not null")
    nodes = ring.select(F.col("source").alias("id")).union(ring.select("target")).distinct()
    names = nodes.select("id", F.when(F.col("id") % 2 == 0, "Open").otherwise("close").alias("name"))
    return G.propagate_configured(ring.withColumn("type", F.lit("call")), labels, names, K.rules_table(spark, _RULES))


@query(f"WITH {RING}, c AS (SELECT n_regionkey, max(source) AS cycle, count(*) AS size FROM r WHERE n_regionkey < 3 GROUP BY 1) SELECT cycle, source AS id, size FROM r JOIN c USING (n_regionkey)")
def graph_cycle_listing(spark, sf_dir):
    return G.cycles(ring_edges(spark, sf_dir))


@query(f"WITH {RING} SELECT source, target FROM ring UNION SELECT target, source FROM ring")
def graph_connected(spark, sf_dir):
    return G.oriented(ring_edges(spark, sf_dir), "bidirectional")


@query(f"WITH {SYM}, {EDGE} SELECT a.file_id AS source_file, count(DISTINCT b.file_id) AS n_files FROM e JOIN s a ON a.symbol_id = source JOIN s b ON b.symbol_id = target WHERE a.file_id <> b.file_id GROUP BY 1")
def file_dependencies(spark, sf_dir):
    return G.reached_files(edges(spark, sf_dir), symbols(spark, sf_dir).select(F.col("symbol_id").alias("id"), "file_id"))


@query("SELECT p_partkey AS id, round(CASE WHEN regexp_matches(p_name, '^[A-Z]') THEN least(1.0, 0.8 * 1.5) ELSE 0.8 END, 6)::DOUBLE AS strength, round(greatest(0.3, pow(0.95, p_size)), 6)::DOUBLE AS confidence FROM part")
def boost_and_decay(spark, sf_dir):
    meets = F.col("p_name").rlike(G.BOOSTS["public"])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(F.when(meets, F.least(F.lit(1.0), F.lit(0.8) * 1.5)).otherwise(0.8), 6).alias("strength"), G.confidence_after(F.col("p_size")).alias("confidence"))


@query("SELECT p_partkey AS id, 'io' AS label, round(p_size / 50.0, 6)::DOUBLE AS strength, CAST(p_partkey % 4 AS INTEGER) AS hops, round(round(p_size / 50.0, 6) * pow(0.9, p_partkey % 4), 6)::DOUBLE AS confidence FROM part WHERE p_size / 50.0 > 0.7 AND p_partkey % 3 = 0")
def critical_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "io").otherwise("ui").alias("label"), F.round(F.col("p_size") / 50.0, 6).alias("strength"), (F.col("p_partkey") % 4).cast("int").alias("hops"))
    return G.critical(rows, ["io"])


@query(f"WITH {SYM} SELECT count(DISTINCT path) AS n_files, count(*) FILTER (kind IN ('function', 'method')) AS n_functions, count(*) FILTER (kind = 'variable') AS n_variables, count(*) FILTER (kind IN ('class', 'interface')) AS n_types FROM s")
def scope_statistics(spark, sf_dir):
    return X.scope_stats(symbols(spark, sf_dir))


@query(f"WITH {SYM}, c AS (SELECT symbol_id, name, CASE WHEN exported THEN 30.0 ELSE 0.0 END + 0.5 * length(name) AS score FROM s WHERE kind IN ('function', 'method')) SELECT symbol_id, name, score::DOUBLE AS score FROM c WHERE score > 25 ORDER BY score DESC, name, symbol_id LIMIT 20")
def critical_functions(spark, sf_dir):
    return X.critical_functions(symbols(spark, sf_dir), 20)


@query(f"WITH {SYM}, f AS (SELECT symbol_id, symbol_id % 7 AS n_in, symbol_id % 5 AS n_out FROM s) SELECT symbol_id, round(CASE WHEN kind = 'interface' THEN 1.0 WHEN kind = 'class' AND n_in + n_out > 0 THEN n_in * 1.0 / (n_in + n_out) ELSE 0.0 END, 6)::DOUBLE AS abstraction FROM s JOIN f USING (symbol_id)")
def abstraction_levels(spark, sf_dir):
    s = symbols(spark, sf_dir)
    return X.abstraction(s, s.select("symbol_id", (F.col("symbol_id") % 7).alias("n_in"), (F.col("symbol_id") % 5).alias("n_out")))


@query(f"WITH {SYM} SELECT c.symbol_id, count(*) AS n_methods FROM s c JOIN s m ON m.file_id = c.file_id AND m.kind = 'method' AND m.line > c.line AND m.line <= c.end_line WHERE c.kind = 'class' GROUP BY 1")
def child_methods(spark, sf_dir):
    return X.child_methods(symbols(spark, sf_dir))


@query(f"WITH {SYM} SELECT string_split(path, '/')[1] AS module, 'general' AS kind, count(DISTINCT path) AS n_files, count(*) AS n_symbols, count(*) FILTER (exported) AS n_exported, count(*) FILTER (kind IN ('function', 'method')) AS n_functions FROM s GROUP BY 1 ORDER BY n_symbols DESC, module LIMIT 50")
def repository_map(spark, sf_dir):
    return X.repository_map(symbols(spark, sf_dir), 50)


@query(f"WITH {SYM} SELECT 'overview' AS section, k AS key, v::DOUBLE AS value FROM (SELECT unnest(['n_files', 'n_functions', 'n_variables', 'n_types']) AS k, unnest([count(DISTINCT path), count(*) FILTER (kind IN ('function', 'method')), count(*) FILTER (kind = 'variable'), count(*) FILTER (kind IN ('class', 'interface'))]) AS v FROM s) UNION ALL SELECT 'statistics', kind, count(*) FROM s GROUP BY kind UNION ALL SELECT 'structure', string_split(path, '/')[1], count(*) FROM s GROUP BY ALL")
def code_insight(spark, sf_dir):
    return X.insight(symbols(spark, sf_dir), "detailed")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'test' WHEN s_suppkey % 5 = 1 THEN 'api' WHEN s_suppkey % 5 = 2 THEN 'data' WHEN s_suppkey % 5 = 3 THEN 'util' ELSE 'general' END AS type FROM supplier")
def module_types(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("SpecRunner", "route_table", "UserModel", "string_helper", "thing"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), X.module_type(name).alias("type"))


@query(f"WITH {NAMED}, h AS (SELECT DISTINCT {_LAYER} AS layer FROM n), g AS (SELECT list(layer) AS l FROM h) SELECT array_to_string(list_filter([CASE WHEN list_has_all(l, ['presentation', 'business', 'data']) THEN 'layered' END, CASE WHEN list_has_all(l, ['api', 'business']) THEN 'service_oriented' END, CASE WHEN list_has_all(l, ['data', 'business']) THEN 'repository' END, CASE WHEN list_has_all(l, ['presentation', 'data']) AND NOT list_contains(l, 'business') THEN 'two_tier' END], lambda x: x IS NOT NULL), ',') AS patterns FROM g")
def architecture_patterns(spark, sf_dir):
    from loomtext.operators import measures as Q

    return X.architecture_patterns(Q.layer_rollup(named(spark, sf_dir)))


@query(f"WITH {SYM} SELECT file_id, line, array_to_string(list_sort(list(symbol_id)), ',') AS symbols FROM s GROUP BY ALL")
def line_symbols(spark, sf_dir):
    rows = X.line_symbols(symbols(spark, sf_dir).withColumn("line", F.col("line")))
    return rows.select("file_id", "line", F.array_join(F.transform("symbols", lambda x: x.cast("string")), ",").alias("symbols"))


@query(f"WITH {SYM} SELECT file_id, name, max(cc)::DOUBLE AS cc, max(end_line)::DOUBLE AS end_line FROM s GROUP BY ALL")
def symbol_metric_map(spark, sf_dir):
    rows = X.metric_map(symbols(spark, sf_dir), ["cc", "end_line"])
    return rows.select("file_id", "name", F.element_at("metrics", F.lit("cc")).alias("cc"), F.element_at("metrics", F.lit("end_line")).alias("end_line"))


@query(f"""WITH {SYM}, z AS (SELECT file_id, max(end_line) + 10 AS size FROM s GROUP BY 1), r AS (SELECT file_id, line AS a, end_line AS b FROM s WHERE kind = 'function' UNION ALL SELECT file_id, size, size FROM z), w AS (SELECT *, coalesce(max(b) OVER (PARTITION BY file_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT file_id, before AS start, a AS "end" FROM w WHERE before < a""")
def range_complement(spark, sf_dir):
    s = symbols(spark, sf_dir)
    sizes = s.groupBy("file_id").agg((F.max("end_line") + 10).alias("size"))
    return X.complement(s.where("kind = 'function'").select("file_id", F.col("line").alias("start"), F.col("end_line").alias("end")), sizes)


@query(f"WITH {SYM} SELECT path, line, coalesce(line - lag(line) OVER (PARTITION BY path ORDER BY line) <= 20, false) AS follows FROM s WHERE kind = 'method'")
def consecutive_lines(spark, sf_dir):
    return X.consecutive(symbols(spark, sf_dir).where("kind = 'method'").select("path", "line"), 20)


@query("WITH s AS (SELECT p_partkey AS symbol_id, p_type AS name, p_size % 2 AS kind FROM part), j AS (SELECT a.symbol_id, b.symbol_id AS \"similar\", row_number() OVER (PARTITION BY a.symbol_id ORDER BY b.symbol_id) AS n FROM s a JOIN s b ON a.name = b.name AND a.kind = b.kind AND a.symbol_id <> b.symbol_id) SELECT symbol_id, \"similar\" FROM j WHERE n <= 5")
def similar_objects(spark, sf_dir):
    return X.similar_objects(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("name"), (F.col("p_size") % 2).alias("kind")))


@query(f"WITH {EDGE} SELECT target AS symbol_id, count(*) AS n_refs FROM e GROUP BY 1 ORDER BY n_refs DESC, symbol_id LIMIT 25")
def usage_hot_spots(spark, sf_dir):
    return X.usage_hot_spots(edges(spark, sf_dir), 25)


@query(f"WITH {SYM} SELECT symbol_id, name, line FROM s WHERE path = 'm1/f1.go'")
def browse_file(spark, sf_dir):
    return E.browse_file(symbols(spark, sf_dir), "m1/f1.go").select("symbol_id", "name", "line")


_ASKED = {"func,cls": "function,class", "all": "", "Methods, typedef": "method,type", "nonsense": "", "struct": "struct"}
_ASKED_ROWS = ", ".join(f"({i}, '{a}', '{k}')" for i, (a, k) in enumerate(_ASKED.items()))


@query(f"SELECT p_partkey AS id, asked, kinds FROM part JOIN (VALUES {_ASKED_ROWS}) v(i, asked, kinds) ON p_partkey % 5 = i")
def kind_parse(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), asked.alias("asked"))
    return rows.withColumn("kinds", F.array_join(E.kinds_of(F.col("asked")), ","))


@query("SELECT doc_id AS ref_id, CASE doc_id % 3 WHEN 0 THEN 'primary' ELSE 'context' END AS role FROM documents WHERE doc_id % 3 < 2")
def manifest_roles(spark, sf_dir):
    from loomtext.plans.catalog_exploration import refs

    return E.by_roles(refs(spark, sf_dir), include=["primary", "context", "test"], exclude=["test"]).select("ref_id", "role")


@query("SELECT doc_id AS ref_id, doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'context' ELSE 'test' END AS role, 2 AS start, 4 AS \"end\" FROM documents")
def manifest_saved(spark, sf_dir):
    from loomtext.plans.catalog_exploration import refs

    place = f"{Scratch(spark, 'manifest').root}/saved"
    E.save_manifest(refs(spark, sf_dir), place)
    return E.load_manifest(spark, place)


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def sink_json(spark, sf_dir):
    return E.as_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query(f"WITH {SYM} SELECT rpad(kind || ':', 12, ' ') || lpad(count(*)::VARCHAR, 8, ' ') AS value FROM s GROUP BY kind")
def sink_text(spark, sf_dir):
    return E.as_text(E.symbol_stats(symbols(spark, sf_dir)), "kind", "n")


@query("WITH t AS (SELECT p_partkey AS id, p_brand AS hash, list_distinct(regexp_extract_all(p_name || ' ' || p_type || ' size' || p_size, '[A-Za-z0-9_]+')) AS w FROM part), p AS (SELECT a.hash, len(list_intersect(a.w, b.w)) * 1.0 / greatest(1, len(list_distinct(a.w || b.w))) AS j FROM t a JOIN t b ON a.hash = b.hash AND a.id < b.id) SELECT hash, round(avg(j), 6)::DOUBLE AS similarity FROM p GROUP BY hash")
def duplicate_cluster_similarity(spark, sf_dir):
    """Groups whose members differ: the parts of a brand, by the words of their name, type and size."""
    text = F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("size"), "p_size"))
    return D.cluster_similarity(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), F.col("p_brand").alias("hash")))


@query("SELECT p_partkey AS id, CASE WHEN p_size / 50.0 >= 0.95 AND p_partkey % 40 >= 20 THEN 'critical' WHEN p_size / 50.0 >= 0.9 OR p_partkey % 40 >= 30 THEN 'warning' ELSE 'info' END AS severity FROM part")
def duplicate_severity(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), D.severity(F.col("p_size") / 50.0, F.col("p_partkey") % 40).alias("severity"))


@query("WITH t AS (SELECT item_id, text FROM benchmark), f AS (SELECT item_id, unnest(flatten([string_split(text, x) FOR x IN ['_', '-', '.', '/', ':', ' ', '=', '&', ',']])) AS fragment FROM t) SELECT DISTINCT item_id, fragment FROM f WHERE length(fragment) >= 4")
def assembly_fragments(spark, sf_dir):
    """The pieces of each benchmark text by every separator."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(D.fragment_list(F.col("text"))).alias("fragment"))
