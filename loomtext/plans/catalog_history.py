"""Queries of change history: events stand for file changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import names as N
from loomtext.operators import history as H
from loomtext.plans.catalog_measures import FUNCTIONS, functions
from loomtext.registry import query
from loomtext.runtime import table

AS_OF = "2024-01-31 00:00:00"
CHANGES = "ch AS (SELECT event_type || '/k' || (json_extract_string(props, '$.k')::BIGINT % 7) || '/f' || (json_extract_string(props, '$.k')) || '.go' AS path, user_id AS author, ts, value AS lines FROM events)"
_RECENT = f"{CHANGES}, w AS (SELECT * FROM ch WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS AND ts <= TIMESTAMP '{AS_OF}')"


def changes(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    path = F.concat("event_type", F.lit("/k"), (k % 7).cast("string"), F.lit("/f"), k.cast("string"), F.lit(".go"))
    return table(spark, sf_dir, "events").select(path.alias("path"), F.col("user_id").alias("author"), "ts", F.col("value").alias("lines"))


@query(f"WITH {_RECENT}, f AS (SELECT path, count(*) AS n_changes, round(sum(lines), 6) AS n_lines, min(ts) AS first_change, max(ts) AS last_change, count(DISTINCT author) AS n_authors, round(count(*) / 30.0, 6) AS rate FROM w GROUP BY path) SELECT *, round(0.4 * least(rate, 1) + 0.4 * least(n_lines / 100, 1) + 0.2 * least(n_authors / 5.0, 1), 6) AS volatility FROM f")
def change_frequency(spark, sf_dir):
    return H.frequency(changes(spark, sf_dir), AS_OF)


@query(f"WITH {_RECENT}, f AS (SELECT path, count(*) AS n_changes, round(0.4 * least(round(count(*) / 30.0, 6), 1) + 0.4 * least(round(sum(lines), 6) / 100, 1) + 0.2 * least(count(DISTINCT author) / 5.0, 1), 6) AS volatility FROM w GROUP BY path) SELECT * FROM f WHERE n_changes >= 3 ORDER BY volatility DESC, n_changes DESC, path LIMIT 20")
def change_hotspots(spark, sf_dir):
    return H.hotspots(H.frequency(changes(spark, sf_dir), AS_OF), 3, 20).select("path", "n_changes", "volatility")


@query(f"WITH {_RECENT}, p AS (SELECT path, author, count(*) AS n, max(ts) AS last FROM w GROUP BY ALL) SELECT *, round(n * 1.0 / sum(n) OVER (PARTITION BY path), 6) AS share FROM p")
def change_contributors(spark, sf_dir):
    return H.contributors(changes(spark, sf_dir), AS_OF)


@query(f"WITH {_RECENT}, p AS (SELECT path, author, count(*) AS n, max(ts) AS last FROM w GROUP BY ALL), g AS (SELECT path, count(*) AS n_authors, CAST(coalesce(sum(n) FILTER (last >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS), 0) AS BIGINT) AS recent, list(n ORDER BY n DESC) AS t FROM p GROUP BY path HAVING count(*) >= 2), s AS (SELECT path, n_authors, recent, round(t[2] * 1.0 / t[1], 6) AS ratio, round(0.4 * least((n_authors - 1) / 4.0, 1) + 0.4 * least(recent / 10.0, 1) + 0.2 * (t[2] * 1.0 / t[1]), 6) AS score FROM g) SELECT *, CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.4 THEN 'warning' ELSE 'info' END AS severity FROM s")
def change_collisions(spark, sf_dir):
    return H.collisions(changes(spark, sf_dir), AS_OF)


@query(f"WITH {_RECENT}, p AS (SELECT array_to_string(string_split(path, '/')[1:2], '/') AS module, author, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY module) AS share, sum(n) OVER (PARTITION BY module) AS total, row_number() OVER (PARTITION BY module ORDER BY n DESC, author) AS r FROM p) SELECT module, CAST(max(total) AS BIGINT) AS total, max(author) FILTER (r = 1) AS owner, round(max(share) FILTER (r = 1), 6) AS owner_share, count(*) FILTER (r > 1 AND share >= 0.1) AS n_secondary FROM r GROUP BY module")
def module_ownership(spark, sf_dir):
    return H.ownership(changes(spark, sf_dir), AS_OF)


@query(f"WITH {_RECENT} SELECT author, count(*) AS n FROM w GROUP BY author ORDER BY n DESC, author LIMIT 1")
def most_active_author(spark, sf_dir):
    return H.most_active(changes(spark, sf_dir), AS_OF)


@query(f"WITH {CHANGES} SELECT path, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM ch GROUP BY ALL")
def change_buckets(spark, sf_dir):
    return H.buckets(changes(spark, sf_dir), "7 days")


@query(f"WITH {FUNCTIONS}, a AS (SELECT id, cc, n_lines, n_in AS nesting, n_out % 5 AS purity FROM f), b AS (SELECT id, cc * 2 % 23 AS old_cc, n_lines // 2 AS old_lines, n_out % 4 AS old_purity FROM f WHERE id % 3 <> 0), j AS (SELECT * FROM a LEFT JOIN b USING (id)) SELECT id, 'complexity' AS issue, CASE WHEN cc > 20 THEN 'critical' ELSE 'warning' END AS severity FROM j WHERE cc > 10 UNION ALL SELECT id, 'length', CASE WHEN n_lines > 200 THEN 'critical' ELSE 'warning' END FROM j WHERE n_lines > 100 UNION ALL SELECT id, 'nesting', CASE WHEN nesting > 8 THEN 'critical' ELSE 'warning' END FROM j WHERE nesting > 4 UNION ALL SELECT id, 'complexity_growth', 'warning' FROM j WHERE cc > old_cc * 1.5 UNION ALL SELECT id, 'length_growth', 'warning' FROM j WHERE n_lines > old_lines * 1.5 UNION ALL SELECT id, 'purity_loss', 'warning' FROM j WHERE purity > old_purity")
def change_metric_issues(spark, sf_dir):
    after = functions(spark, sf_dir).select("id", "cc", "n_lines", F.col("n_in").alias("nesting"), (F.col("n_out") % 5).alias("purity"))
    before = functions(spark, sf_dir).where("id % 3 != 0").select("id", (F.col("cc") * 2 % 23).alias("cc"), F.floor(F.col("n_lines") / 2).alias("n_lines"), (F.col("n_out") % 4).alias("purity"))
    return H.metric_issues(before, after)


@query(f"WITH {FUNCTIONS} SELECT n_in AS change_set, round(least(1.0, count(*) FILTER (cc > 25) * 0.3 + count(*) FILTER (cc > 24 AND cc <= 25) * 0.1), 6)::DOUBLE AS risk FROM f WHERE cc > 24 GROUP BY n_in")
def change_report_risk(spark, sf_dir):
    severity = F.when(F.col("cc") > 25, "critical").otherwise("warning")
    return H.report_risk(functions(spark, sf_dir).where("cc > 24").select(F.col("n_in").alias("change_set"), severity.alias("severity")), "change_set")


@query("WITH n AS (SELECT p_brand AS kind, CASE p_size % 3 WHEN 0 THEN 'get_' || lower(p_type) WHEN 1 THEN 'get' || p_type ELSE 'Get' || p_type END AS name FROM part), s AS (SELECT kind, CASE WHEN regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(name, '^[A-Z0-9]+(_[A-Z0-9]+)+$') THEN 'screaming' WHEN regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab' WHEN regexp_matches(name, '^[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*$') THEN 'pascal' WHEN regexp_matches(name, '^[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*$') THEN 'camel' ELSE 'unknown' END AS style, count(*) AS n FROM n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, style) AS r FROM s WHERE style <> 'unknown') SELECT kind, style, n FROM r WHERE r = 1 AND n >= 3")
def dominant_case_styles(spark, sf_dir):
    k = F.col("p_size") % 3
    name = F.when(k == 0, F.concat(F.lit("get_"), F.lower("p_type"))).when(k == 1, F.concat(F.lit("get"), "p_type")).otherwise(F.concat(F.lit("Get"), "p_type"))
    return H.dominant_styles(table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), name.alias("name")), N.case_style(F.col("name")))
