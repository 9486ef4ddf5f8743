"""Queries over references: line items stand for references from suppliers to parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import relations as J
from loomtext.registry import query
from loomtext.runtime import table

EDGES = "edges AS (SELECT l_suppkey AS source, l_partkey AS target, l_orderkey AS file_id, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'usage' ELSE 'import' END AS type, CASE l_linestatus WHEN 'O' THEN 'tight' ELSE 'loose' END AS strength FROM lineitem)"
PACKAGES = "pe AS (SELECT s_nationkey AS source_package, c_nationkey AS target_package FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey), sizes AS (SELECT n_nationkey AS package, count(s_suppkey) + 1 AS n_symbols FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey)"


def edges(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "usage").otherwise("import")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("file_id"), kind.alias("type"), F.when(F.col("l_linestatus") == "O", "tight").otherwise("loose").alias("strength"))


def package_edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("s_nationkey").alias("source_package"), F.col("c_nationkey").alias("target_package"))


def package_sizes(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.col("n_nationkey").alias("package")).agg((F.count("s_suppkey") + 1).alias("n_symbols"))


# source and target ids share one id space here, as symbols do
@query(f"WITH {EDGES}, b AS (SELECT target AS symbol, 1 AS i, 0 AS o, file_id, type FROM edges UNION ALL SELECT source, 0, 1, file_id, type FROM edges) SELECT symbol, count(*) FILTER (i = 1 AND type <> 'import') AS n_in, count(*) FILTER (o = 1 AND type <> 'import') AS n_out, count(DISTINCT file_id) AS n_files, count(*) FILTER (type = 'import') AS n_import FROM b GROUP BY symbol")
def ref_stats(spark, sf_dir):
    return J.ref_stats(edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT target, count(*) FILTER (type = 'call') AS n_call, count(*) FILTER (type = 'usage') AS n_usage, count(*) FILTER (type = 'import') AS n_import FROM edges GROUP BY target")
def ref_types(spark, sf_dir):
    return J.by_type(edges(spark, sf_dir), ["call", "usage", "import"])


@query(f"WITH {EDGES} SELECT DISTINCT target AS symbol, source AS other FROM edges WHERE type = 'call'")
def callers(spark, sf_dir):
    return J.neighbours(edges(spark, sf_dir), "call", incoming=True)


@query(f"WITH {EDGES} SELECT DISTINCT source AS symbol, target AS other FROM edges WHERE type = 'call'")
def callees(spark, sf_dir):
    return J.neighbours(edges(spark, sf_dir), "call", incoming=False)


@query("WITH needs AS (SELECT DISTINCT p_brand || p_size AS grp, p_partkey AS part FROM part), has AS (SELECT DISTINCT l_suppkey AS who, l_partkey AS part FROM lineitem) SELECT grp, who FROM has JOIN needs USING (part) GROUP BY grp, who HAVING count(*) = (SELECT count(*) FROM needs n WHERE n.grp = needs.grp)")
def implicit_implementations(spark, sf_dir):
    needs = table(spark, sf_dir, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("grp"), F.col("p_partkey").alias("part"))
    has = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("who"), F.col("l_partkey").alias("part"))
    return J.divide(has, needs, "who", "part", "grp")


@query("WITH e AS (SELECT l_partkey AS interface, l_suppkey AS implementor, CASE l_returnflag WHEN 'A' THEN 'assigned' WHEN 'N' THEN 'returned' ELSE 'heuristic' END AS quality, CASE l_returnflag WHEN 'A' THEN 100 WHEN 'N' THEN 90 ELSE 50 END AS rank FROM lineitem) SELECT interface, implementor, arg_max(quality, rank) AS quality, max(rank) AS rank FROM e GROUP BY interface, implementor")
def implementors_with_quality(spark, sf_dir):
    f = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("interface"), F.col("l_suppkey").alias("implementor"), F.when(f == "A", "assigned").when(f == "N", "returned").otherwise("heuristic").alias("quality"), F.when(f == "A", 100).when(f == "N", 90).otherwise(50).alias("rank"))
    return J.best_quality(rows)


@query("""WITH s AS (SELECT p_partkey AS symbol_id, p_partkey % 50 AS file_id, p_type AS name, p_size > 25 AS exported FROM part), r AS (SELECT c_custkey AS ref_id, c_custkey % 50 AS file_id, t.name FROM customer JOIN (SELECT row_number() OVER (ORDER BY name) - 1 AS k, name FROM (SELECT DISTINCT p_type AS name FROM part)) t ON t.k = c_custkey % 7), i AS (SELECT DISTINCT file_id, name FROM r WHERE ref_id % 3 = 0),
c AS (SELECT ref_id, symbol_id, CASE WHEN i.file_id IS NOT NULL AND s.file_id <> r.file_id THEN 0 WHEN s.file_id = r.file_id THEN 1 WHEN exported THEN 2 ELSE 3 END AS o FROM r LEFT JOIN s USING (name) LEFT JOIN i ON i.file_id = r.file_id AND i.name = r.name)
SELECT ref_id, arg_min(symbol_id, CAST(o AS BIGINT) * 1000000000 + symbol_id) AS target, count(symbol_id) AS n_candidates, count(symbol_id) > 1 AS ambiguous FROM c GROUP BY ref_id""")
def resolve_references(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    symbols = part.select(F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 50).alias("file_id"), F.col("p_type").alias("name"), (F.col("p_size") > 25).alias("exported"))
    from pyspark.sql import Window

    kinds = part.select(F.col("p_type").alias("name")).distinct().withColumn("k", F.row_number().over(Window.orderBy("name")) - 1)
    refs = customer.select(F.col("c_custkey").alias("ref_id"), (F.col("c_custkey") % 50).alias("file_id"), (F.col("c_custkey") % 7).alias("k")).join(F.broadcast(kinds), "k").drop("k")
    return J.resolve(refs, symbols, refs.where("ref_id % 3 = 0").select("file_id", "name"))


@query("""WITH r AS (SELECT n_nationkey * 40 + 1 AS start, n_nationkey * 40 + 60 AS "end", n_regionkey AS file_id, n_nationkey AS range_id FROM nation), p AS (SELECT c_custkey AS ref_id, c_nationkey % 5 AS file_id, CAST(c_custkey % 1000 AS BIGINT) AS line FROM customer)
SELECT p.ref_id, p.file_id, p.line, arg_min(range_id, ("end" - start) * 100000 + start) AS range_id FROM p JOIN r ON r.file_id = p.file_id AND p.line BETWEEN r.start AND r."end" GROUP BY ALL""")
def symbol_at_position(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    ranges = nation.select((F.col("n_nationkey") * 40 + 1).alias("start"), (F.col("n_nationkey") * 40 + 60).alias("end"), F.col("n_regionkey").alias("file_id"), F.col("n_nationkey").alias("range_id"))
    points = customer.select(F.col("c_custkey").alias("ref_id"), (F.col("c_nationkey") % 5).alias("file_id"), (F.col("c_custkey") % 1000).alias("line"))
    return J.at_position(points, ranges, "file_id", "line")


@query("WITH d AS (SELECT DISTINCT l_orderkey % 100 AS file_id, l_partkey % 50 AS target FROM lineitem WHERE l_returnflag = 'A'), u AS (SELECT l_orderkey % 100 AS file_id, l_partkey % 50 AS target, count(*) AS n_uses FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL) SELECT file_id, target, coalesce(n_uses, 0) AS n_uses, CASE WHEN n_uses IS NULL THEN 'unused' WHEN n_uses > 5 THEN 'coupled' ELSE 'missing' END AS status FROM d FULL JOIN u USING (file_id, target) WHERE n_uses IS NULL OR (file_id, target) NOT IN (SELECT file_id, target FROM d)")
def import_check(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("file_id"), (F.col("l_partkey") % 50).alias("target"), "l_returnflag", "l_quantity")
    return J.import_check(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag != 'A'"))


@query(f"""WITH {PACKAGES}, p AS (SELECT source_package AS a, target_package AS b, count(*) AS n FROM pe GROUP BY ALL), o AS (SELECT a AS package, sum(n) FILTER (a = b) AS i, sum(n) FILTER (a <> b) AS ce FROM p GROUP BY a), t AS (SELECT b AS package, sum(n) AS ca FROM p WHERE a <> b GROUP BY b), j AS (SELECT package, n_symbols, CAST(coalesce(i, 0) AS BIGINT) AS n_internal, CAST(coalesce(ca, 0) AS BIGINT) AS ca, CAST(coalesce(ce, 0) AS BIGINT) AS ce FROM sizes LEFT JOIN o USING (package) LEFT JOIN t USING (package))
SELECT package, n_internal, ca, ce, round(CASE WHEN ca + ce > 0 THEN ce * 1.0 / (ca + ce) ELSE 0.5 END, 6) AS instability, round(least(1.0, ce / (5.0 * n_symbols)), 6) AS coupling, round(CASE WHEN n_internal + ce > 0 THEN n_internal * 1.0 / (n_internal + ce) ELSE 0.5 END, 6) AS cohesion FROM j""")
def package_coupling(spark, sf_dir):
    return J.coupling(package_edges(spark, sf_dir), package_sizes(spark, sf_dir))


@query(f"WITH {EDGES}, n AS (SELECT p_partkey AS id FROM part UNION SELECT s_suppkey FROM supplier), c AS (SELECT * FROM edges WHERE type = 'call'), e AS (SELECT source AS id FROM c UNION SELECT target FROM c) SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM c) AS n_edges, (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM e)) AS n_orphans, round((SELECT count(*) FROM c) * 1.0 / (SELECT count(*) FROM n), 6) AS mean_out")
def call_stats(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()
    return J.call_stats(nodes, edges(spark, sf_dir).where("type = 'call'"))


@query(f"WITH {EDGES}, o AS (SELECT source AS symbol, count(DISTINCT target) AS fan_out FROM edges GROUP BY source), i AS (SELECT target AS symbol, count(DISTINCT source) AS fan_in FROM edges GROUP BY target) SELECT symbol, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, CASE WHEN greatest(coalesce(fan_in, 0), coalesce(fan_out, 0)) > 10 THEN 'high' WHEN greatest(coalesce(fan_in, 0), coalesce(fan_out, 0)) > 3 THEN 'medium' ELSE 'low' END AS risk FROM o FULL JOIN i USING (symbol)")
def fan_in_out(spark, sf_dir):
    return J.fans(edges(spark, sf_dir))


@query("SELECT p_partkey AS symbol_id, count(*) OVER (PARTITION BY p_brand) - 1 AS n_others FROM part")
def co_located_symbols(spark, sf_dir):
    return J.co_located(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file_id")))


@query("WITH f AS (SELECT 'src/' || p_brand || '/' || p_type || '.h' AS path FROM part), w AS (SELECT DISTINCT p_type || '.h' AS import_path FROM part UNION SELECT 'other/none.h'), j AS (SELECT import_path, path FROM w LEFT JOIN (SELECT DISTINCT path FROM f) ON path LIKE '%/' || import_path) SELECT import_path, CASE count(path) WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(path) = 1 THEN min(path) END AS path FROM j GROUP BY import_path")
def include_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    files = part.select(F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_type", F.lit(".h")).alias("path")).distinct()
    wanted = part.select(F.concat("p_type", F.lit(".h")).alias("import_path")).union(spark.createDataFrame([("other/none.h",)], "import_path string")).distinct()
    return J.include_status(wanted.join(J.path_suffix(files, wanted), "import_path", "left"))
