"""Queries of rule tables: architecture checks, intents, components, memory, naming, propagation modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import graph as G
from loomtext.operators import history as H
from loomtext.operators import measures as Q
from loomtext.operators import namematch as X
from loomtext.operators import rules as U
from loomtext.operators import vocabulary as V
from loomtext.plans.catalog_graphs import RING, ring_edges
from loomtext.plans.catalog_measures import NAMED, named
from loomtext.plans.catalog_names import NAMES, SPLIT, made_names
from loomtext.plans.catalog_search import CORPUS
from loomtext.registry import query
from loomtext.runtime import table
from loomtext.sources import corpus as C

RULES = [("token_with_host", "token", "host", "", "warning"), ("no_pipes", "tion", "", r"\|", "critical")]
_VIOLATIONS = f"WITH {CORPUS}, v AS (SELECT path, 'token_with_host' AS rule, 'warning' AS severity FROM corpus WHERE contains(content, 'token') AND NOT contains(content, 'host') UNION ALL SELECT path, 'no_pipes', 'critical' FROM corpus WHERE contains(content, 'tion') AND contains(content, '|')) "


@query(_VIOLATIONS + "SELECT * FROM v")
def architecture_verification(spark, sf_dir):
    return U.verify(C.files(spark, sf_dir), RULES)


@query(_VIOLATIONS + ", n AS (SELECT count(DISTINCT path) AS n_files FROM corpus), b AS (SELECT count(DISTINCT path) AS n_violating FROM v) SELECT n_files, n_violating, round((n_files - n_violating) * 100.0 / n_files, 6) AS score FROM n, b")
def compliance_score(spark, sf_dir):
    files = C.files(spark, sf_dir)
    return U.compliance(files, U.verify(files, RULES))


def _sql_intents() -> str:
    parts = []
    for name, (expressions, words) in U.INTENTS.items():
        hit = [f"regexp_matches(text, '{p}')" for p, _ in expressions]
        points = " + ".join(f"CASE WHEN {h} THEN {c} ELSE 0 END" for h, (_, c) in zip(hit, expressions, strict=True))
        keys = " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN 0.1 ELSE 0 END" for k in words)
        n = " + ".join(f"CAST({h} AS INT)" for h in hit)
        parts.append(f"SELECT item_id AS id, '{name}' AS intent, round(least(1.0, ({points} + {keys}) / {len(expressions)} * CASE WHEN {n} > 1 THEN 1.2 ELSE 1 END), 6)::DOUBLE AS confidence FROM benchmark WHERE {' OR '.join(hit)}")
    return " UNION ALL ".join(parts)


@query(_sql_intents())
def intent_detection(spark, sf_dir):
    return U.intents(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


_COMPONENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{c}'" for c, p, _ in U.COMPONENTS) + " ELSE 'generic' END"
_SURE = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN {s}" for _, p, s in U.COMPONENTS) + " ELSE 0.5 END"


@query(f"WITH {NAMED} SELECT DISTINCT name, {_COMPONENT} AS component, CAST({_SURE} AS DOUBLE) AS confidence FROM n ORDER BY confidence DESC, name LIMIT 100")
def component_detection(spark, sf_dir):
    return U.components(named(spark, sf_dir), k=100)


CALLS = "c AS (SELECT l_orderkey AS function, CASE l_linenumber % 4 WHEN 0 THEN 'make' WHEN 1 THEN 'Append' WHEN 2 THEN 'readall' ELSE 'none' END AS callee, l_quantity > 25 AS in_loop, l_orderkey % 10 = 0 AS is_test FROM lineitem), s AS (SELECT function, round(sum(CASE lower(callee) WHEN 'make' THEN 2.0 WHEN 'append' THEN 1.5 ELSE 5.0 END * CASE WHEN in_loop THEN 10 ELSE 1 END * CASE WHEN is_test THEN 0.1 ELSE 1 END), 6) AS score FROM c WHERE callee <> 'none' GROUP BY function)"


def calls(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    callee = F.when(k == 0, "make").when(k == 1, "Append").when(k == 2, "readall").otherwise("none")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("function"), callee.alias("callee"), (F.col("l_quantity") > 25).alias("in_loop"), (F.col("l_orderkey") % 10 == 0).alias("is_test"))


@query(f"WITH {CALLS} SELECT function, CAST(score AS DOUBLE) AS score FROM s")
def memory_profile(spark, sf_dir):
    return U.memory_profile(calls(spark, sf_dir))


@query(f"WITH {CALLS}, p AS (SELECT score, cume_dist() OVER (ORDER BY score) * 100 AS p FROM s) SELECT count(*) AS n, round(avg(score), 6)::DOUBLE AS mean, count(*) FILTER (round(p, 6) >= 95) AS n_critical, count(*) FILTER (round(p, 6) >= 85 AND round(p, 6) < 95) AS n_high FROM p")
def memory_summary(spark, sf_dir):
    return U.memory_summary(Q.percentiles(U.memory_profile(calls(spark, sf_dir)), "score"))


@query("WITH a AS (SELECT l_suppkey AS target, l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_returnflag = 'N' THEN 'write' ELSE 'read' END AS kind FROM lineitem), g AS (SELECT target, min(k) FILTER (kind = 'read') AS r0, max(k) FILTER (kind = 'read') AS r1, min(k) FILTER (kind = 'write') AS w0, max(k) FILTER (kind = 'write') AS w1 FROM a GROUP BY target) SELECT target, CASE WHEN w0 IS NULL THEN 'read_only' WHEN r0 IS NULL THEN 'write_only' WHEN w1 < r0 THEN 'write_then_read' WHEN r1 < w0 THEN 'read_then_write' ELSE 'mixed' END AS pattern, coalesce(r0 < w0, false) AS read_first FROM g")
def access_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.when(F.col("l_returnflag") == "N", "write").otherwise("read").alias("kind"))
    return U.access_patterns(rows)


_STYLE = "CASE WHEN regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(name, '^[A-Z0-9]+(_[A-Z0-9]+)+$') THEN 'screaming' WHEN regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab' WHEN regexp_matches(name, '^[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*$') THEN 'pascal' WHEN regexp_matches(name, '^[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*$') THEN 'camel' ELSE 'unknown' END"


@query(f"WITH {NAMES}, s AS (SELECT name, {_STYLE} AS style FROM names) SELECT 'python' AS language, 'function' AS kind, name, style FROM s WHERE style NOT IN ('unknown', 'snake')")
def naming_findings(spark, sf_dir):
    return U.naming_findings(made_names(spark, sf_dir).select(F.lit("python").alias("language"), F.lit("function").alias("kind"), "name"))


_ABBR = " UNION ALL ".join(f"SELECT '{k}' AS short, '{w}' AS long" for k, v in sorted(U.N.ABBREVIATIONS.items()) for w in v)


@query(f"WITH {NAMES}, abbr AS ({_ABBR}), more AS (SELECT name FROM names UNION ALL SELECT replace(name, 'cfg', 'config') FROM names), w AS (SELECT unnest({SPLIT}) AS w FROM more), c AS (SELECT w, count(*) AS n FROM w GROUP BY w) SELECT short, long, x.n AS n_short, y.n AS n_long FROM abbr JOIN c x ON x.w = short JOIN c y ON y.w = long")
def abbreviation_findings(spark, sf_dir):
    names = made_names(spark, sf_dir)
    return U.abbreviation_findings(names.union(names.select(F.replace("name", F.lit("cfg"), F.lit("config")))))


@query("WITH e AS (SELECT DISTINCT l_returnflag AS grp, l_suppkey AS source, l_partkey AS target FROM lineitem), u AS (SELECT grp, target, count(*) AS n FROM e GROUP BY ALL) SELECT source, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS cohesion FROM e JOIN u USING (grp, target) GROUP BY source")
def dependency_cohesion(spark, sf_dir):
    return U.dependency_cohesion(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")))


@query(f"WITH RECURSIVE {RING}, w(seed, id, depth) AS (SELECT DISTINCT source, source, 0 FROM ring WHERE source % 2 = 0 UNION SELECT w.seed, ring.target, w.depth + 1 FROM w JOIN ring ON ring.source = w.id WHERE w.depth < 5), m AS (SELECT seed, id, min(depth) AS d FROM w GROUP BY seed, id) SELECT id, count(DISTINCT seed) AS n_sources, round(sum(greatest(0, 1 - 0.2 * d)), 6)::DOUBLE AS total, round(max(greatest(0, 1 - 0.2 * d)), 6)::DOUBLE AS best FROM m WHERE d > 0 AND 1 - 0.2 * d > 0 GROUP BY id")
def dependency_weights(spark, sf_dir):
    edges = ring_edges(spark, sf_dir)
    return G.dependency_weights(edges, edges.where("source % 2 = 0").select(F.col("source").alias("id")))


@query(f"WITH RECURSIVE {RING}, w(seed, id, depth) AS (SELECT DISTINCT source, source, 0 FROM ring UNION SELECT w.seed, ring.target, w.depth + 1 FROM w JOIN ring ON ring.source = w.id WHERE w.depth < 8), m AS (SELECT seed, id, min(depth) AS d FROM w GROUP BY seed, id) SELECT seed AS id, CAST(max(d) AS INTEGER) AS depth FROM m GROUP BY seed")
def dependency_depth(spark, sf_dir):
    return G.dependency_depth(ring_edges(spark, sf_dir), 8)


@query("WITH c AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS interface FROM lineitem), i AS (SELECT DISTINCT l_partkey AS interface, l_linenumber AS implementor FROM lineitem), n AS (SELECT interface, count(*) AS n FROM i GROUP BY interface) SELECT source, implementor AS target, round(1.0 / n, 6)::DOUBLE AS confidence FROM c JOIN i USING (interface) JOIN n USING (interface)")
def interface_attribution(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    calls_ = rows.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    return G.through_implementations(calls_, rows.select(F.col("l_partkey").alias("interface"), F.col("l_linenumber").alias("implementor")).distinct())


CLUSTERS = {"network": ["http", "server", "response"], "user": ["user", "msg"], "limits": ["max", "min"]}
_KEYWORDS = " UNION ALL ".join(f"SELECT '{c}' AS cluster, '{k}' AS keyword" for c, ks in CLUSTERS.items() for k in ks)


@query(f"WITH {NAMES}, kw AS ({_KEYWORDS}), w AS (SELECT unnest(list_filter({SPLIT}, lambda x: length(x) >= 3)) AS term FROM names), t AS (SELECT term, count(*) AS n FROM w GROUP BY term), h AS (SELECT DISTINCT cluster, term, n FROM t JOIN kw ON contains(term, keyword)), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS r FROM h) SELECT cluster, term, n FROM r WHERE r <= 20")
def term_clusters(spark, sf_dir):
    terms = made_names(spark, sf_dir).select(F.explode(V.N.terms(F.col("name"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return V.clusters(terms, CLUSTERS)


@query(f"WITH {NAMES}, kw AS ({_KEYWORDS}), w AS (SELECT DISTINCT unnest(list_filter({SPLIT}, lambda x: length(x) >= 3)) AS term FROM names), h AS (SELECT term, cluster AS domain, CASE WHEN term = keyword THEN 1.0 WHEN starts_with(term, keyword) OR ends_with(term, keyword) THEN 0.6 + 0.3 * length(keyword) / length(term) ELSE 0.5 END AS s FROM w JOIN kw ON contains(term, keyword)), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY s DESC, domain) AS r FROM h) SELECT term, domain, round(s, 6)::DOUBLE AS strength FROM r WHERE r = 1")
def term_domains(spark, sf_dir):
    return V.term_strength(made_names(spark, sf_dir).select(F.explode(V.N.terms(F.col("name"))).alias("term")), CLUSTERS)


@query(f"WITH {NAMES}, j AS (SELECT a.name, b.name AS other, jaro_winkler_similarity(lower(a.name), lower(b.name)) AS s FROM names a JOIN names b ON a.name <> b.name), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, other) AS r FROM j WHERE s >= 0.8) SELECT name, other AS \"similar\", round(s, 6) AS similarity FROM r WHERE r <= 3")
def similar_names(spark, sf_dir):
    names = made_names(spark, sf_dir)
    return X.similar_names(names, names)


#: Sources that each show one anti-pattern, as often as a part's size says.
_SMELL = "p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 6 AS m FROM part)"


def smelly_sources(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    line = ["app.register(x)", "case a = 1", "x", "export * from 'y'", "name: value", "switch (k) {%s}"]
    name = ["src/reg%s.js", "src/enum%s.js", "src/big%s.js", "src/%s/index.js", "src/settings%s.yaml", "src/make%s.js"]
    m = F.col("p_partkey") % 6
    pick = lambda xs: F.element_at(F.array(*xs), (m + 1).cast("int"))
    cases = F.concat(F.lit("switch (k) {\n"), F.repeat(F.lit("case 1: return new A();\n"), F.col("p_size")), F.lit("}\n"))
    body = pick([F.repeat(F.lit(x + "\n"), F.col("p_size") * (60 if i == 2 else 1)) for i, x in enumerate(line[:5])] + [cases])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), pick([F.format_string(x, k) for x in name]).alias("path"), body.alias("content"))


_GRADE = "CASE WHEN n >= 2 * most THEN 'critical' WHEN n >= 1.5 * most THEN 'warning' ELSE 'info' END"


@query(f"""WITH {_SMELL}, r AS (SELECT 'src/reg' || k || '.js' AS path, 'registration' AS pattern, n, 10 AS most FROM p WHERE m = 0
UNION ALL SELECT 'src/enum' || k || '.js', 'enum', n, 10 FROM p WHERE m = 1
UNION ALL SELECT 'src/big' || k || '.js', 'god_object', 60 * n + 1, 1500 FROM p WHERE m = 2
UNION ALL SELECT 'src/' || k || '/index.js', 'barrel', n, 10 FROM p WHERE m = 3
UNION ALL SELECT 'src/settings' || k || '.yaml', 'config', n, 10 FROM p WHERE m = 4
UNION ALL SELECT 'src/make' || k || '.js', 'switch_factory', n, 10 FROM p WHERE m = 5)
SELECT path, pattern, CAST(n AS INTEGER) AS n, {_GRADE} AS severity FROM r WHERE n >= most""")
def change_anti_patterns(spark, sf_dir):
    return H.anti_patterns(smelly_sources(spark, sf_dir))
