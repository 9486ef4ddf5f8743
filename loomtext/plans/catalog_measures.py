"""Queries of quality measures: orders stand for functions, with metrics made from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import measures as Q
from loomtext.registry import query
from loomtext.runtime import table

FUNCTIONS = "f AS (SELECT o_orderkey AS id, CAST(o_orderkey % 27 AS BIGINT) AS cc, CAST(floor(o_totalprice / 3000) AS BIGINT) AS n_lines, CAST(o_custkey % 19 AS BIGINT) AS n_in, CAST(o_custkey % 23 AS BIGINT) AS n_out, CAST(o_custkey % 29 AS BIGINT) AS n_methods FROM orders)"
MASKS = "m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST((o_custkey % 1024) * 2 AS INTEGER) END AS mask FROM orders)"


def functions(spark, sf_dir):
    c = lambda e: F.expr(e).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), c("o_orderkey % 27").alias("cc"), c("floor(o_totalprice / 3000)").alias("n_lines"), c("o_custkey % 19").alias("n_in"), c("o_custkey % 23").alias("n_out"), c("o_custkey % 29").alias("n_methods"))


def masks(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(((F.col("o_custkey") % 1024) * 2).cast("int")).alias("mask"))


@query(f"WITH {FUNCTIONS}, g AS (SELECT greatest(cc, 1) AS cc FROM f) SELECT count(*) AS n, round(avg(cc), 6) AS avg_cc, CAST(median(cc) AS DOUBLE) AS median_cc, round(quantile_cont(cc, 0.75), 6)::DOUBLE AS p75_cc, round(quantile_cont(cc, 0.9), 6)::DOUBLE AS p90_cc, count(*) FILTER (cc <= 10) AS n_low, count(*) FILTER (cc > 10 AND cc <= 20) AS n_medium, count(*) FILTER (cc > 20) AS n_high FROM g")
def complexity_metrics(spark, sf_dir):
    return Q.complexity_metrics(functions(spark, sf_dir))


@query(f"WITH {FUNCTIONS}, g AS (SELECT greatest(cc, 1) AS cc FROM f), a AS (SELECT count(*) AS n, round(avg(cc), 6) AS v, count(*) FILTER (cc > 10 AND cc <= 20) AS m, count(*) FILTER (cc > 20) AS h FROM g) SELECT n, round(greatest(0, least(10, 10 - 4.0 * h / n - 1.5 * m / n - CASE WHEN v > 10 THEN least(3.0, 0.15 * (v - 10)) ELSE 0 END)), 6) AS health FROM a")
def health_score(spark, sf_dir):
    return Q.health_score(Q.complexity_metrics(functions(spark, sf_dir)))


@query(f"WITH {FUNCTIONS} SELECT round(avg(CASE WHEN cc > 15 OR n_in > 10 THEN 1.0 ELSE 0.0 END), 6) AS debt_ratio FROM f")
def technical_debt(spark, sf_dir):
    return Q.debt_ratio(functions(spark, sf_dir))


@query(f"WITH {FUNCTIONS} SELECT id, cc, n_lines, round(least(10.0, 0.7 * cc + 0.03 * n_lines), 6) AS risk FROM f WHERE cc > 10 OR n_lines > 50 ORDER BY risk DESC, id LIMIT 100")
def complexity_hotspots(spark, sf_dir):
    return Q.hotspots(functions(spark, sf_dir), 100)


_SMELLS = f"""WITH {FUNCTIONS}, s AS (SELECT id, 'long_function' AS smell, CASE WHEN n_lines > 100 THEN 'high' ELSE 'medium' END AS severity FROM f WHERE n_lines > 50
UNION ALL SELECT id, 'high_complexity', CASE WHEN cc > 20 THEN 'high' ELSE 'medium' END FROM f WHERE cc > 10
UNION ALL SELECT id, 'god_class', CASE WHEN n_methods > 25 THEN 'high' ELSE 'medium' END FROM f WHERE n_methods > 15
UNION ALL SELECT id, 'shotgun_surgery', CASE WHEN n_in > 20 THEN 'high' ELSE 'medium' END FROM f WHERE n_in > 10) """


@query(_SMELLS + "SELECT * FROM s")
def code_smells(spark, sf_dir):
    return Q.smells(functions(spark, sf_dir))


@query(_SMELLS + "SELECT * FROM s ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, smell, id LIMIT 5")
def top_smells(spark, sf_dir):
    return Q.top_smells(Q.smells(functions(spark, sf_dir)))


@query(f"WITH {FUNCTIONS}, r AS (SELECT id, CAST(least(10, CASE WHEN cc > 15 THEN 3 ELSE 0 END + CASE WHEN n_lines > 100 THEN 2 ELSE 0 END + CASE WHEN n_in > 15 THEN 2 ELSE 0 END + CASE WHEN n_out > 15 THEN 2 ELSE 0 END) AS INTEGER) AS risk FROM f) SELECT * FROM r WHERE risk >= 5 ORDER BY risk DESC, id LIMIT 5")
def problem_symbols(spark, sf_dir):
    return Q.problems(functions(spark, sf_dir))


@query(f"WITH {FUNCTIONS} SELECT id, round(n_in * CASE WHEN id % 2 = 0 THEN 1.5 ELSE 1 END * CASE WHEN id % 100 = 1 THEN 2 ELSE 1 END * CASE WHEN id % 5 = 0 THEN 1.3 ELSE 1 END * (1 + cc / 20.0), 6) AS importance, least(10.0, 1 + least(n_in / 2.0, 5) + least(n_out / 2.0, 3) + CASE WHEN cc > 10 THEN 2 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END) AS impact, least(10.0, 0.5 * cc + CASE WHEN n_lines > 100 THEN 2 WHEN n_lines > 50 THEN 1 ELSE 0 END + CASE WHEN n_in > 10 THEN 2 WHEN n_in > 5 THEN 1 ELSE 0 END) AS risk FROM f")
def symbol_scores(spark, sf_dir):
    i, c = F.col("id"), F.col
    return functions(spark, sf_dir).select("id", Q.importance(c("n_in"), i % 2 == 0, i % 100 == 1, i % 5 == 0, c("cc")).alias("importance"), Q.impact(c("n_in"), c("n_out"), c("cc"), i % 2 == 0).alias("impact"), Q.simple_risk(c("cc"), c("n_lines"), c("n_in")).alias("risk"))


@query(f"WITH {FUNCTIONS}, h AS (SELECT id, cc, n_lines, round(CASE WHEN n_methods + n_out > 0 THEN (n_lines + n_in) * log2(n_methods + n_out) ELSE 0 END, 6) AS volume, round(CASE WHEN n_out > 0 THEN n_methods / 2.0 * n_in / n_out ELSE 0 END, 6) AS difficulty FROM f), m AS (SELECT *, round(greatest(0, least(100, 171 - 5.2 * ln(greatest(volume, 1)) - 0.23 * cc - 16.2 * ln(greatest(n_lines, 1)))), 6) AS maintainability FROM h) SELECT id, volume, difficulty, maintainability, CASE WHEN maintainability >= 90 THEN 'A' WHEN maintainability >= 80 THEN 'B' WHEN maintainability >= 70 THEN 'C' WHEN maintainability >= 60 THEN 'D' ELSE 'F' END AS rating FROM m")
def maintainability(spark, sf_dir):
    c = F.col
    volume, difficulty = Q.halstead(c("n_methods"), c("n_out"), c("n_lines"), c("n_in"))
    rows = functions(spark, sf_dir).select("id", "cc", "n_lines", volume.alias("volume"), difficulty.alias("difficulty"))
    rows = rows.withColumn("maintainability", Q.maintainability(c("volume"), c("cc"), c("n_lines")))
    return rows.select("id", "volume", "difficulty", "maintainability", Q.rating(c("maintainability")).alias("rating"))


@query(f"WITH {FUNCTIONS} SELECT id, array_to_string(list_filter([CASE WHEN cc > 10 THEN 'complex' END, CASE WHEN n_lines > 100 THEN 'long' END, CASE WHEN n_in > 4 THEN 'nested' END, CASE WHEN n_out > 5 THEN 'many_params' END], lambda x: x IS NOT NULL), ',') AS tags FROM f")
def risk_tags(spark, sf_dir):
    c = F.col
    return functions(spark, sf_dir).select("id", F.array_join(Q.risk_tags(c("cc"), c("n_lines"), c("n_in"), c("n_out")), ",").alias("tags"))


@query("WITH p AS (SELECT o_orderkey AS id, o_totalprice AS score, round(cume_dist() OVER (ORDER BY o_totalprice) * 100, 6) AS percentile FROM orders) SELECT *, CASE WHEN percentile >= 95 THEN 'critical' WHEN percentile >= 85 THEN 'high' WHEN percentile >= 70 THEN 'medium' ELSE 'low' END AS severity FROM p")
def percentile_severity(spark, sf_dir):
    return Q.percentiles(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), "score").select("id", "score", "percentile", "severity")


@query(f"WITH {MASKS}, l AS (SELECT id, mask, CASE WHEN mask = 0 THEN 1 WHEN mask & 3520 <> 0 THEN 5 WHEN mask & 8 <> 0 THEN 4 WHEN mask & 36 <> 0 THEN 3 ELSE 2 END AS level FROM m) SELECT id, mask, level, CASE level WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 ELSE 0.0 END::DOUBLE AS score FROM l")
def purity_levels(spark, sf_dir):
    rows = masks(spark, sf_dir).withColumn("level", Q.purity_level(F.col("mask")))
    return rows.withColumn("score", Q.purity_score(F.col("level")))


_BITS = ", ".join(f"CASE WHEN mask & {v} <> 0 THEN '{k}' END" for k, v in Q.EFFECTS.items())


@query(f"WITH {MASKS}, x AS (SELECT unnest([{_BITS}, CASE WHEN mask = 0 THEN 'pure' ELSE 'impure' END]) AS category FROM m) SELECT category, count(*) AS n FROM x WHERE category IS NOT NULL GROUP BY category")
def purity_summary(spark, sf_dir):
    return Q.purity_summary(masks(spark, sf_dir))


_LAYER = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{k}'" for k, p in Q.LAYERS) + " ELSE 'other' END"
NAMED = "n AS (SELECT CASE o_orderkey % 7 WHEN 0 THEN 'UserHandler' WHEN 1 THEN 'OrderService' WHEN 2 THEN 'order_repo' WHEN 3 THEN 'apiRoute' WHEN 4 THEN 'LogUtil' WHEN 5 THEN 'loginPage' ELSE 'zz' END || '_' || o_orderpriority AS name, o_orderstatus AS dir, o_orderpriority AS file FROM orders)"


def named(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    name = F.coalesce(*[F.when(k == i, n) for i, n in enumerate(("UserHandler", "OrderService", "order_repo", "apiRoute", "LogUtil", "loginPage"))], F.lit("zz"))
    return table(spark, sf_dir, "orders").select(F.concat(name, F.lit("_"), "o_orderpriority").alias("name"), F.col("o_orderstatus").alias("dir"), F.col("o_orderpriority").alias("file"))


@query(f"WITH {NAMED}, p AS (SELECT {_LAYER} AS layer, lower(substr(name, 1, 3)) AS p, count(*) AS k FROM n GROUP BY ALL) SELECT layer, CAST(sum(k) AS BIGINT) AS n, round(max(k) * 1.0 / sum(k), 6) AS cohesion, round(sum(k) / 10.0, 6) AS complexity FROM p GROUP BY layer")
def architecture_layers(spark, sf_dir):
    return Q.layer_rollup(named(spark, sf_dir))


#: Names of three layers only.
_THREE = "n AS (SELECT ['PageView', 'UserService', 'OrderRepo', 'thing'][p_partkey % 4 + 1] || p_partkey AS name FROM part)"


@query(f"WITH {_THREE}, r AS (SELECT {_LAYER} AS layer, count(*) AS n FROM n GROUP BY ALL) SELECT k AS layer, 'missing' AS violation FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k, _ in Q.LAYERS)}) v(k) WHERE k NOT IN (SELECT layer FROM r) UNION ALL SELECT layer, 'oversized' FROM r WHERE n > 5 * (SELECT avg(n) FROM r)")
def layer_violations(spark, sf_dir):
    first = F.element_at(F.array(*map(F.lit, ("PageView", "UserService", "OrderRepo", "thing"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    names = table(spark, sf_dir, "part").select(F.concat(first, F.col("p_partkey").cast("string")).alias("name"))
    return Q.layer_violations(Q.layer_rollup(names))



@query(f"WITH {NAMED}, p AS (SELECT dir, lower(substr(name, 1, 3)) AS p, count(*) AS k FROM n GROUP BY ALL), m AS (SELECT dir, max(k) AS m FROM p GROUP BY dir) SELECT dir, count(*) AS n, count(DISTINCT file) AS n_files, round(any_value(m) * 1.0 / count(*), 6) AS cohesion, round(1 / (1 + count(*) / 10.0), 6) AS stability FROM n JOIN m USING (dir) GROUP BY dir")
def module_rollup(spark, sf_dir):
    return Q.module_rollup(named(spark, sf_dir))


_FEATURE = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{k}'" for k, p in Q.FEATURES) + " ELSE 'general' END"


@query(f"WITH {NAMED} SELECT {_FEATURE} AS feature, count(*) AS n, round(count(DISTINCT CASE WHEN contains(lower(name), 'handler') THEN 'h' WHEN contains(lower(name), 'service') THEN 's' WHEN contains(lower(name), 'model') THEN 'm' WHEN contains(lower(name), 'test') THEN 't' END) / 4.0, 6) AS completeness FROM n GROUP BY ALL")
def feature_rollup(spark, sf_dir):
    return Q.feature_rollup(named(spark, sf_dir))


@query(f"WITH {NAMED} SELECT round(greatest(0, 100 - avg(length(name))), 6) AS quality, count(*) FILTER (length(name) > 30 OR length(name) - length(replace(name, '_', '')) > 3) AS n_smells FROM n")
def name_quality(spark, sf_dir):
    return Q.name_quality(named(spark, sf_dir))


@query("WITH p AS (SELECT l_orderkey AS file_id, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS m FROM lineitem GROUP BY l_orderkey) SELECT file_id, round(CASE WHEN m > 0 THEN 1 - (n - m) * 1.0 / m END, 6) AS cohesion FROM p")
def file_cohesion(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("m"))
    return Q.cohesion_lcom(per)


@query("WITH d AS (SELECT l_orderkey AS function, max(l_linenumber) AS depth FROM lineitem GROUP BY l_orderkey) SELECT function, depth, CASE WHEN depth >= 3 THEN 'high' ELSE 'medium' END AS severity FROM d WHERE depth >= 2")
def nested_loops(spark, sf_dir):
    return Q.loops(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("function"), F.col("l_linenumber").alias("depth")))
